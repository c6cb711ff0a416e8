"""Ranks and quantiles against plain counting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from harvestry.functions import ranks
from harvestry.operators import feedback


@pytest.mark.parametrize("cuts", [[], [3.0], [-5.0, 1.0, 2.0, 7.5, 99.0]])
def test_running_sums_and_quantiles(spark, cuts):
    rng = random.Random(7)
    rows = [(rng.choice([1, 2, None]), rng.choice([None, *(x / 2 for x in range(20))]), rng.randint(1, 3)) for _ in range(300)]
    df = spark.createDataFrame(rows, "g int, v double, w int")
    at = ranks.running(df, "v", cuts, ["g"], "w")
    got = {r["g"]: r for r in at.groupBy("g").agg(ranks.quantile("v", 0.3).alias("q"), ranks.at_rank("v", F.lit(5)).alias("sixth"), F.max("upto").alias("last"), F.max("n").alias("n")).collect()}
    for g in (1, 2, None):
        copies = sorted(v for k, v, w in rows if k == g and v is not None for _ in range(w))
        assert got[g]["q"] == pytest.approx(np.quantile(copies, 0.3)) and got[g]["sixth"] == copies[5]
        assert got[g]["last"] == got[g]["n"] == len(copies)


def test_an_empty_table_has_no_ranks(spark):
    df = spark.createDataFrame([], "v double")
    assert ranks.edges(df, "v") == [] and ranks.running(df, "v", []).count() == 0


def test_a_market_without_gaps_keeps_its_row(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 9.0), (2, None)], "mandi_id int, gap_pct double")
    got = {r["mandi_id"]: (r["reports"], r["median_gap_pct"]) for r in feedback.demo_scores(df).collect()}
    assert got == {1: (2, 9.0), 2: (1, None)}
