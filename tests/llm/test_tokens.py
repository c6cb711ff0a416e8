"""BPE encoding, token counts and shards against the tokenizers library."""

import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from harvestry.llm import bpe, counts, shared, sst
from harvestry.llm import text as T
from harvestry.llm.pretokens import PretokenCache, library_encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = ["Hello world", "", None, "don't we'll 'S it's", "a <|endoftext|>  b<|endoftext|>", "  spaces \n\n end  ", "ünï çödé 中文 \U0001f600", "x" * 5000, "<|endoftext|>", " \t\r\n", "1234 ½²", "word " * 3000]


def want(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(), st.text(alphabet="ab 's\n\tlredT.!1é中<|endoftext>")), max_size=8))
def test_backtracking_and_cached_library_give_the_librarys_ids(texts):
    for cache in (bpe.encoder(PATH)[1], PretokenCache(library_encoder(PATH), 50256, 50)):
        got = []
        for rows in T.chunks(pa.array(texts, pa.string()), 64):
            ids, before = cache.encode_texts(rows)
            got += [ids[i:j].tolist() for i, j in zip(before[:-1], before[1:], strict=True)]
        assert got == [want(t) for t in texts]


def test_all_tokens_decode_to_what_the_library_gives():
    encoder = bpe.encoder(PATH)[0]
    rng = random.Random(3)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 8))]
        assert encoder.decode(np.array(ids, np.int64)).tobytes().decode("utf-8", "replace") == LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 7, "clash") for i, t in enumerate(TEXTS)] + [(None, "no id", 7, "c"), (3, "again", 7, "c"), (-5, "minus", 7, "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")


def test_encode_documents(docs):
    rows = {(r.doc_id, r.decoded): r.ids for r in bpe.encode_documents(docs, PATH).collect()}
    for r in docs.collect():
        assert rows[(r.doc_id, r.text or "")] == want(r.text)


def test_digests(docs):
    rows = sorted(map(tuple, bpe.encode_digests(docs, PATH).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert rows == sorted(((r.doc_id, len(want(r.text)), sha(",".join(map(str, want(r.text)))), sha(r.text or "")) for r in docs.collect()), key=str)


def test_counts(docs, spark):
    rows = sorted(map(tuple, counts.count_tokens(docs, PATH, limit=4, entries=8).collect()), key=str)
    assert rows == sorted(((r.doc_id, len((r.text or "").encode()), n := len(want(r.text)), n > 4) for r in docs.collect()), key=str)
    assert counts.count_tokens(docs.limit(0), PATH).collect() == []


def test_shards_round_trip(docs, spark):
    at = shared.scratch_dir(spark, "sst")
    manifest = sst.write_shards(docs, at, PATH, end_id=2)
    rows = sorted(map(tuple, sst.read_shards(manifest).collect()), key=lambda r: r[1])
    assert [r[0] for r in rows] == sorted((r.doc_id for r in docs.collect()), key=lambda d: (d is not None, d))
    start = 0
    of = {}
    for r in docs.collect():
        of.setdefault(r.doc_id, []).append(zlib.crc32(np.array([*want(r.text), 2], "<u4").tobytes()))
    for doc_id, at_, n, crc in rows:
        assert at_ == start
        assert crc in of[doc_id]
        start += n
    found = {(r.doc_id, tuple(r.ids)) for r in sst.lookup(spark, manifest, [3, 0, 99, -5]).collect()}
    assert found == {(3, (*want(TEXTS[3]), 2)), (3, (*want("again"), 2)), (0, (*want(TEXTS[0]), 2)), (-5, (*want("minus"), 2))}
    empty = sst.write_shards(docs.limit(0), shared.scratch_dir(spark, "sst"), PATH, end_id=2)
    assert sst.read_shards(empty).collect() == []


def test_lookup_bisects_many_blocks():
    out = io.BytesIO()
    writer = sst.ShardWriter(out, 2, block_bytes=64)
    keys = sorted(random.Random(1).sample(range(-(10**12), 10**12), 500))
    for k in keys:
        writer.add(sst.key_of(k), np.array([k % 1000, 5]))
    writer.close()
    reader = sst.ShardReader(io.BytesIO(out.getvalue()))
    assert len(reader.blocks) > 50
    for k in keys:
        assert [x.tolist() for x in reader.lookup(k)] == [[k % 1000, 5]]
    absent = [k + 1 for k in keys if k + 1 not in keys]
    assert not any(reader.lookup(k) for k in absent)
    assert sum(reader.may_hold(sst.key_of(k)) for k in absent) < 30
