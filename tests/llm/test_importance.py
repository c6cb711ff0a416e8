"""Resampling towards a target's words against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from harvestry.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest=1):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, percent, least_words, buckets, longest):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(of(f) for text in texts for f in features(text, longest)[1]) for texts in ([d[1] for d in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for doc_id, text in docs:
        n_words, found = features(text, longest)
        weight = sum(gain(of(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    eligible = sorted((r for r in rows if r[4] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = eligible[: percent * len(eligible) // 100]
    rest = Counter(r[:4] for r in rows) - Counter(r[:4] for r in drawn)
    return sorted([(*r[:4], k + 1) for k, r in enumerate(drawn)] + [(*r, None) for r, n in rest.items() for _ in range(n)], key=str)


TEXTS = ["The cat sat on THE mat, 3 times; Ünïted çat 中文", "", None, "cat " * 30, "a-b_c d\x00e\x7ff 'g' " * 5, "x" * 500 + " " + "y" * 70, " .,;: ", "word " * 20_000 + "end"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 5, "clash") for i, t in enumerate(TEXTS)] + [(None, "no id here " * 9, 5, "c"), (3, "cat " * 30, 5, "c")]
    rows += [(7, "equal rows of one id and more words " * 4, 5, "c")] * 6 + [(100 + i, f"the cat sat {i} times on mat {i % 3} " * 5, 5, "c") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, rank int, score string")


@pytest.mark.parametrize(("percent", "least", "buckets", "longest"), [(10, 20, 10_000, 1), (60, 3, 7, 1), (100, 0, 50, 3)])
def test_resample(spark, docs, percent, least, buckets, longest):
    target = spark.createDataFrame([("mat cat times",), ("the mat " * 9,), (None,)], "text string")
    got = importance.resample(docs, target, percent, least, buckets=buckets, longest=longest)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, [r.text for r in target.collect()], percent, least, buckets, longest)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert importance.resample(none, docs).collect() == []
    rows = importance.resample(docs, none.select("text"), percent=50).collect()
    assert len(rows) == docs.count() and sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, sum(r["rank"] is not None for r in rows) + 1))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aZ9 é中.-", max_size=90), min_size=1, max_size=9))
def test_crcs_of_spans(texts):
    data = [t.encode() for t in texts]
    joined, starts, ends, before = importance._spans(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]))
    crcs = importance.span_crcs(joined, starts, ends - starts).tolist()
    assert crcs == [zlib.crc32(w.encode()) for t in texts for w in features(t)[1]]
    assert np.diff(before).tolist() == [features(t)[0] for t in texts]
