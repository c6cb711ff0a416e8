"""The registered query scores by contexts of two words."""

import zlib

import pytest
from test_lm import brute, tokens

from harvestry.llm import queries

TEXTS = ["a b c d", "x b e d", "a b c e", "x b e c", "a b c d x b e d"] * 6


def test_op1_scores_by_trigrams(spark, tmp_path):
    rows = list(enumerate(TEXTS))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 10]
    two, three = (brute(train, order)[1] for order in (2, 3))
    got = {r.doc_id: r.score for r in queries.op1_lm_score(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        slack = 0.02 * len(tokens(text))
        assert abs(two(text) - three(text)) > 2 * slack
        assert got[i] == pytest.approx(three(text), abs=slack)
