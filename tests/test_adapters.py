"""The adapters keep every row, against brute force."""

import math

import pytest
from pyspark.sql import functions as F

from harvestry.operators import features as X
from harvestry.plans import catalog
from harvestry.sources import adapters

SF = "/root/testdata/sf0.001"


def test_every_urgent_order_is_a_shock(spark):
    orders = adapters.table(spark, SF, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"), "o_orderstatus", "o_totalprice").collect()
    events = adapters.shocks(spark, SF)
    assert {r["event_id"] for r in events.collect()} == {r["o_orderkey"] for r in orders}
    days = sorted({r["d"] for r in orders})[::40]
    rows = {r["obs_date"]: r for r in X.shock(spark.createDataFrame([(d,) for d in days], "obs_date date"), events).collect()}
    assert len(rows) == len(days)
    for day in days:
        want = {-1: 0.0, 1: 0.0}
        for r in orders:
            if r["d"] <= day:
                want[-1 if r["o_orderstatus"] == "F" else 1] += (math.floor(r["o_totalprice"]) % 3 + 1) * math.exp(-(day - r["d"]).days / 10)
        assert rows[day]["shock_active_bearish"] == pytest.approx(want[-1])
        assert rows[day]["shock_active_bullish"] == pytest.approx(want[1])
        assert rows[day]["days_since_shock"] == min((day - r["d"]).days for r in orders if r["d"] <= day)


def test_weather_lies_on_the_price_years(spark):
    events = adapters.table(spark, SF, "events").select("user_id", F.col("ts").cast("date").alias("d")).distinct()
    rows = adapters.market_weather(spark, SF).collect()
    first, last = adapters.table(spark, SF, "lineitem").select(F.min("l_shipdate").cast("date"), F.max("l_shipdate").cast("date")).first()
    assert all(first <= r["obs_date"] <= last for r in rows)
    assert {(r["mandi_id"], r["obs_date"].month, r["obs_date"].day) for r in rows} == {(r["user_id"], r["d"].month, r["d"].day) for r in events.collect()}
    assert len(rows) == events.count()


def test_the_matrix_has_weather(spark):
    rows = catalog.QUERIES["feature_matrix"](spark, SF)
    names = X.GROUPS["weather"]
    filled = rows.select(*(F.count(c).alias(c) for c in names)).first()
    assert all(filled[c] > 0 for c in names), filled


def test_the_weather_grid_covers_all_events(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-02 10:00:00", 5.0), (1, "2024-06-04 10:00:00", 7.0)], "user_id long, ts string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/events.parquet")
    rows = {str(r["obs_date"]): r["rain_7d_sum"] for r in catalog.QUERIES["feat_weather"](spark, str(tmp_path)).collect()}
    assert (rows["2024-01-02"], rows["2024-06-04"]) == (5.0, 7.0)
