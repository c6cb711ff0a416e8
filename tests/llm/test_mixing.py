"""Mixing sources: targets and permutations against plain versions, and what the mix takes, counted again."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from harvestry.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**63))
def test_permutations(n, key):
    x = np.arange(n)
    assert sorted(mixing.permute(x, np.full(n, n), np.full(n, key, np.uint64)).tolist()) == x.tolist()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=8))
def test_targets(sizes):
    weights = [1 + i % 3 for i in range(len(sizes))]
    got = mixing.targets(sizes, weights, 1.0, 3)
    assert math.isclose(sum(got), sum(sizes), abs_tol=1e-6)
    # one unit of weight gives every source its target, or its limit
    units = [g / w for g, w, s in zip(got, weights, sizes, strict=True) if g < 3 * s - 1e-9]
    assert not units or max(units) - min(units) < 1e-6
    assert all(g <= 3 * s + 1e-9 for g, s in zip(got, sizes, strict=True))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "w%d " % i * (i % 40), f"src{i % 5}", 1, "x") for i in range(300)]
    rows += [(1000 + i, "hot " * 200, "hot", 1, "x") for i in range(150)] + [(7, "same row " * 30, "src1", 1, "x")] * 50
    rows += [(None, "no id at all", None, 1, "x"), (5, None, None, 1, "x"), (6, "", "blank", 1, "x"), (8, "long " * 30_000, "é", 1, "x"), (9, "tiny", "Z", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, taken string")


@pytest.mark.parametrize(("length", "per_shard"), [(1024, 8192), (16, 50), (1, 1000)])
def test_taken(spark, docs, length, per_shard):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # sources go on from batch to batch
    try:
        check_taken(docs, length, per_shard)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def check_taken(docs, length, per_shard):
    got = [tuple(r) for r in mixing.taken(docs, length=length, per_shard=per_shard).collect()]
    assert Counter(got) == Counter(tuple(r) for r in mixing.taken(docs, length=length, per_shard=per_shard).collect())
    rows = docs.collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    goal = dict(zip(names, mixing.targets([sizes[s] for s in names], [1 + i % 3 for i in range(len(names))], 1.0, 3), strict=True))
    want = Counter((r.doc_id, n := len(WORD.findall(r.text or "")), sizes[r.source], round(goal[r.source], 6)) for r in rows)
    assert Counter((*r[:3], round(r[3], 6)) for r in got) == want
    assert all(0 <= taken <= 3 * size for _, size, _, _, taken in got)
    took = defaultdict(int)
    for _, _, source_size, target, taken in got:
        took[source_size, round(target, 6)] += taken
    alike = Counter((sizes[s], round(t, 6)) for s, t in goal.items())  # sources of one size and target can't be told apart
    assert all(abs(took[key] - n * key[1]) <= n for key, n in alike.items())


def test_slots_hold_each_block_equally_often(spark):
    quotas = mixing.Quotas(10, np.array([95, 1000, 7, 0]), np.array([250, 333, 21, 0]))
    rows = mixing.fill_slots(spark, quotas, 16, 5).collect()
    assert len({(r.shard, r.slot) for r in rows}) == len(rows) == quotas.slots.sum()
    shards = Counter(r.shard for r in rows)
    assert sorted(shards) == list(range(-(-len(rows) // 16))) and max(shards.values()) == 16
    for source, take in enumerate(quotas.take):
        assert sum(r.words for r in rows if r.source_no == source) == take
        times = Counter(r.block for r in rows if r.source_no == source)
        assert not times or (take < quotas.size[source] or len(times) == quotas.blocks[source]) and max(times.values()) - min(times.values()) <= 1


def test_mixed_texts_are_the_documents_words(spark, docs):
    rows = mixing.mixed_texts(docs, length=64, per_shard=100).collect()
    words = defaultdict(set)
    for r in docs.collect():
        words[r.source] |= set(WORD.findall(r.text or ""))
    assert all(len(r.text.split(" ")) == r.words for r in rows)
    assert all(set(r.text.split(" ")) <= set().union(*words.values()) for r in rows)
    assert sum(r.words for r in rows) == sum(r.taken for r in mixing.taken(docs, length=64, per_shard=100).collect())


def test_empty_tables_and_limits(spark, docs):
    assert mixing.taken(docs.limit(0)).collect() == []
    blank = spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert sorted(map(tuple, mixing.taken(blank).collect())) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    with pytest.raises(ValueError, match="sources"):
        mixing.taken(docs, most_sources=3)
