"""Data-quality audit and profiling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harvestry.config import SETTINGS, Audit
from harvestry.functions.dates import business_days_between
from harvestry.operators.cleaning import longest_gap


def audit(daily: DataFrame, cfg: Audit = SETTINGS.audit) -> DataFrame:
    """A row for each market: rows, span, coverage, shares, prices, arrivals, longest gap, verdict; daily: cleaned rows of one commodity."""
    share = lambda c: F.avg(F.col(c).cast("double")) * 100
    stats = daily.groupBy("mandi_id").agg(
        F.count("*").alias("rows"), F.min("obs_date").alias("first_date"), F.max("obs_date").alias("last_date"), share("is_imputed").alias("imputed_pct"), share("suspect").alias("suspect_pct"),
        *(f(c).alias(f"{p}_{n}") for c, p in (("modal_price", "price"), ("arrival_qtl", "arrival")) for f, n in ((F.min, "min"), (F.median, "median"), (F.max, "max"))),
    )
    days = business_days_between(F.date_sub("first_date", 1), F.col("last_date"))
    stats = stats.withColumn("business_days", days).withColumn("coverage", F.least(F.lit(1.0), F.col("rows") / F.greatest("business_days", F.lit(1))))
    verdict = F.when((F.col("rows") >= cfg.usable[0]) & (F.col("coverage") >= cfg.usable[1]), "USABLE").when((F.col("rows") >= cfg.thin[0]) & (F.col("coverage") >= cfg.thin[1]), "THIN").otherwise("UNUSABLE")
    gaps = longest_gap(daily.where("not is_imputed")).select("mandi_id", "longest_gap_days")
    return stats.withColumn("verdict", verdict).join(gaps, "mandi_id", "left")


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def densest(rows: DataFrame, by: str, market: str, day: str, n: int) -> DataFrame:
    """by, market, days, rank: the markets with the most distinct days in each group."""
    counts = rows.groupBy(by, market).agg(F.count_distinct(day).alias("days"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("days"), market))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def span(rows: DataFrame, day: str) -> DataFrame:
    return rows.agg(F.min(day).alias("first_date"), F.max(day).alias("last_date"), (F.datediff(F.max(day), F.min(day)) + 1).alias("span_days"), F.count_distinct(day).alias("days"))
