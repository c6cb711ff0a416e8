"""Aligned tokens against both libraries and plain loops."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from harvestry.llm import alignment
from harvestry.llm import text as T
from harvestry.llm.bpe import byte_alphabet

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A, B = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
A.encode_special_tokens = True
ALPHABET = byte_alphabet()


def tokens(text):
    """Both sides' (id, bytes), or none where their bytes differ from those of the text."""
    if not text:
        return [], []
    a = [(i, bytes(ALPHABET[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()) for i in B.encode(text) for p in [B.id_to_piece(i)]]
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


def plain(text):
    """Groups and links by loops over all pairs of tokens."""
    a, b = tokens(text)
    ends = lambda side: np.cumsum([len(x) for _, x in side]).tolist()
    ends_a, ends_b = ends(a), ends(b)
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(cut) + 1, ends_b.index(cut) + 1
        groups.append(([x for x, _ in a[i:k]], [x for x, _ in b[j:m]]))
        i, j = k, m
    links = [(k, m) for k in range(len(a)) for m in range(len(b)) if ends_a[k] - len(a[k][1]) < ends_b[m] and ends_b[m] - len(b[m][1]) < ends_a[k]]
    return a, b, groups, links


def digest(groups):
    return hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest() if groups else ""


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet="ab  's\n\tlredT.!1é中▁\x00<s>0x", max_size=30)), min_size=1, max_size=6))
def test_chunks(texts):
    a, b = alignment._sides(A_PATH, B_PATH)
    for i, j, data, offsets in T.chunks(pa.array(texts, pa.string()), 64):
        rows, found = alignment.align_chunk(a, b, data, offsets)
        want = [plain(t) for t in texts[i:j]]
        assert rows.tolist() == [k for k, w in enumerate(want) if w[0]]
        want = [w for w in want if w[0]]
        assert found.a.tolist() == [x for w in want for x, _ in w[0]] and found.b.tolist() == [x for w in want for x, _ in w[1]]
        assert found.digests(50257) == [digest(w[2]) for w in want]
        assert [found.n_groups.tolist(), found.n_links.tolist()] == [[len(w[2]) for w in want], [len(w[3]) for w in want]]


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 300)), st.sets(st.integers(0, 300)))
def test_bits(x, y):
    p, q = (alignment.Bits.of(np.array(sorted(s), np.int64), 301) for s in (x, y))
    assert (p & q).select().tolist() == sorted(x & y) and (p | q).select().tolist() == sorted(x | y)
    assert p.rank(np.arange(302)).tolist() == [sum(k < at for k in x) for at in range(302)]


TEXTS = ["Hello world, unbelievable tokenization!", "", None, "don't  we'll\n\n\tgo", "<s> </s> <|endoftext|> <unk> <0x41>", "ünï çödé 中文 \U0001f600 ½", " ", "   leading", "meta▁mark", "x" * 3000, "a\x00b", "many words in a text " * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "clash") for i, t in enumerate(TEXTS)] + [(None, "no id", 1, "c"), (0, "Hello world", 1, "c")] + [(3, "don't  we'll\n\n\tgo", 1, "c")] * 3
    return spark.createDataFrame(rows, "doc_id long, text string, row int, pairs string")


@pytest.mark.parametrize("held", [1 << 19, 5, 0])
def test_counted(docs, held):
    rows = docs.collect()
    short = {r.text: plain(r.text) if len(r.text or "") < 4000 else None for r in rows}
    kinds = {}
    for text, w in short.items():
        if w is None:  # too long for all pairs: the same groups, links by the ends
            a, b = tokens(text)
            ends_a, ends_b = (np.cumsum([len(x) for _, x in s]) for s in (a, b))
            cuts = np.union1d(ends_a, ends_b)
            links = list(zip(np.searchsorted(ends_a, cuts).tolist(), np.searchsorted(ends_b, cuts).tolist(), strict=True))
            shared = np.intersect1d(ends_a, ends_b)
            pa_, pb_ = np.searchsorted(ends_a, shared) + 1, np.searchsorted(ends_b, shared) + 1
            groups = [([x for x, _ in a[i:k]], [x for x, _ in b[j:m]]) for i, k, j, m in zip([0, *pa_[:-1]], pa_, [0, *pb_[:-1]], pb_, strict=True)]
            w = a, b, groups, links
        kinds[text] = (*w[:3], [(w[0][i][0], w[1][j][0]) for i, j in w[3]])
    counts = Counter(p for r in rows for p in set(kinds[r.text][3]))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    want = []
    for r in rows:
        a, b, groups, links = kinds[r.text]
        want.append((r.doc_id, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), digest(groups)))
    got = alignment.align_counted(docs, A_PATH, B_PATH, held=held)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_align(docs):
    for r in alignment.align(docs.where("length(text) < 4000 or text is null"), A_PATH, B_PATH).collect():
        wanted = [plain(x.text) for x in docs.collect() if x.doc_id == r.doc_id and len(x.text or "") < 4000]
        assert ([(x.a, x.b) for x in r.groups], sorted((x.a, x.b) for x in r.links)) in [(w[2], sorted(w[3])) for w in wanted]


def test_empty_table(docs):
    assert alignment.align_counted(docs.limit(0), A_PATH, B_PATH).collect() == []
