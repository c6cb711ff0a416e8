"""Sums, limits and alerts that pages of results show."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.errors import IngestionError
from harvestry.operators.asof import asof, latest
from harvestry.operators.features import SERIES


def history_totals(history: DataFrame) -> DataFrame:
    """decisions, expected_gain (their sum), crops (how many there are); history: gain, crop."""
    return history.agg(F.count("*").alias("decisions"), F.coalesce(F.sum("gain"), F.lit(0)).alias("expected_gain"), F.count_distinct("crop").alias("crops"))


def flips(ranked: DataFrame) -> DataFrame:
    """markets, flips: how many markets stand elsewhere by net than by gross price."""
    return ranked.agg(F.count("*").alias("markets"), F.count_if("rank_flipped").alias("flips"))


def community_totals(pools: DataFrame, members: DataFrame) -> DataFrame:
    """pools, farmers (distinct), saved (over all members); pools: pool_economics() rows; members: pool_id, farmer_id."""
    size = members.groupBy("pool_id").agg(F.count("*").alias("members"))
    saved = pools.join(size, "pool_id").agg(F.count("*").alias("pools"), F.sum(F.col("saving_each") * F.col("members")).alias("saved"))
    return saved.crossJoin(members.agg(F.count_distinct("farmer_id").alias("farmers")))


def chart_domain(points: DataFrame, by: list[str], pad: float = 0.12) -> DataFrame:
    """by, low, high (of all prices and quantiles, with a margin), bands: how many points have both p10 and p90; points: modal, p10, p90."""
    lo, hi = F.min(F.least("modal", "p10", "p90")), F.max(F.greatest("modal", "p10", "p90"))
    both = F.count_if(F.col("p10").isNotNull() & F.col("p90").isNotNull())
    return points.groupBy(*by).agg((lo - (hi - lo) * pad).alias("low"), (hi + (hi - lo) * pad).alias("high"), both.alias("bands"))


def window_bounds(obs: DataFrame, today: dt.date, end: dt.date | None = None, lag_days: int = 5) -> DataFrame:
    """start (the first price's day), end (not later than the archive's last day): one row."""
    last = min(end or today, today - dt.timedelta(days=lag_days))
    return obs.agg(F.min("obs_date").alias("start")).withColumn("end", F.lit(last))


def weather_window(obs: DataFrame, today: dt.date, start: dt.date | None = None, end: dt.date | None = None, lag_days: int = 5, lookback_days: int = 400) -> tuple[dt.date, dt.date]:
    """The days to ask weather for; without prices from lookback_days ago. Raises IngestionError if there are none."""
    first, last = window_bounds(obs, today, end, lag_days).first()
    first = start or first or today - dt.timedelta(days=lookback_days)
    if last < first:
        raise IngestionError(f"no days of weather between {first} and {last}")
    return first, last


def price_alerts(obs: DataFrame, least: float, days: int = 3, tolerance: int = 2) -> DataFrame:
    """commodity_id, mandi_id, obs_date, price_now, price_before, change, kind (rise or fall): series whose last price moved by `least` or more.

    The price before is the last one within the tolerance of `days` days earlier; a series without one gives no row.
    """
    now = latest(obs.where("modal_price is not null"), SERIES, "obs_date", ["modal_price"]).withColumnsRenamed({"obs_date": "on_date", "modal_price": "price_now"})
    was = asof(now.withColumn("obs_date", F.date_sub("on_date", days)), obs.where("modal_price is not null"), SERIES, "obs_date", ["modal_price"], tolerance)
    change = F.col("price_now") - F.col("modal_price")
    out = was.select(*SERIES, F.col("on_date").alias("obs_date"), "price_now", F.col("modal_price").alias("price_before"), change.alias("change"))
    return out.where(F.abs("change") >= least).withColumn("kind", F.when(F.col("change") > 0, "rise").otherwise("fall"))
