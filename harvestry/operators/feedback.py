"""Sale reports: gaps between what was quoted and received, and markets' transparency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestry.functions import ranks
from harvestry.functions.maths import clip


def gap_pct(quoted: Column, received: Column) -> Column:
    return (quoted - received) / F.when(quoted != 0, quoted) * 100


def plausible(price: Column, official: Column) -> Column:
    """Whether a reported price lies between 0.3 and 2 times the official one."""
    return price.between(0.3 * official, 2.0 * official)


def demo_scores(reports: DataFrame) -> DataFrame:
    """mandi_id, reports, median_gap_pct (the upper median), score, trend."""
    at = ranks.running(reports, "gap_pct", ranks.edges(reports, "gap_pct"), ["mandi_id"])
    middle = at.groupBy("mandi_id").agg(ranks.at_rank("gap_pct", F.floor(F.col("n") / 2)).alias("median_gap_pct"))
    counts = reports.groupBy(F.col("mandi_id").alias("__mandi")).agg(F.count("*").alias("reports"))
    g = counts.join(middle, F.col("__mandi").eqNullSafe(F.col("mandi_id")), "left").select(F.col("__mandi").alias("mandi_id"), "reports", "median_gap_pct")
    score = clip(10 - (F.col("median_gap_pct") - 6) * 0.9, 0.0, 10.0)
    return g.withColumn("score", score).withColumn("trend", F.when(F.col("median_gap_pct") < 11, "up").when(F.col("median_gap_pct") > 14, "down").otherwise("flat"))


def totals(reports: DataFrame) -> DataFrame:
    """reports, farmers, villages, median_gap, followed; the upper median is the value of one rank, so no task holds all of them."""
    whole = reports.agg(F.count("*").alias("reports"), F.count_distinct("farmer_id").alias("farmers"), F.count_distinct("village").alias("villages"), F.count_if("followed").alias("followed"))
    at = ranks.running(reports, "gap_pct", ranks.edges(reports, "gap_pct"))
    middle = at.agg(ranks.at_rank("gap_pct", F.floor(F.col("n") / 2)).alias("median_gap"))
    return whole.crossJoin(middle)


def transparency(reports: DataFrame, window_end: Column, days: int = 90, least: int = 10, k: int = 15) -> DataFrame:
    """mandi_id, n_reports, raw_gap, shrunk_gap, score (null below `least` reports).

    One report for each farmer, market and week (the last); verified ones count three times; a tenth is trimmed at
    each end; the median is shrunk to that of all markets. Reports without a gap count for n_reports only.
    """
    rows = reports.where((F.col("sale_date") > F.date_sub(window_end, days)) & (F.col("sale_date") <= window_end))
    w = Window.partitionBy("farmer_id", "mandi_id", F.trunc("sale_date", "week")).orderBy(F.desc("sale_date"), F.desc("report_id"))
    rows = rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").withColumn("weight", F.when(F.col("verification").isin("slip_photo", "fpo_verified"), 3).otherwise(1))
    cuts = ranks.edges(rows, "gap")

    def trimmed(by: list[str]) -> DataFrame:
        at = ranks.running(rows, "gap", cuts, by, "weight")
        share = F.when(F.col("n") > 1, (F.col("upto") - F.col("k")) / (F.col("n") - 1)).otherwise(0.0)
        kept = at.where(share.between(0.1, 0.9))
        return ranks.running(kept, "gap", cuts, by, "k").groupBy(*by).agg(ranks.quantile("gap", 0.5).alias("gap"))

    counts = rows.groupBy("mandi_id").agg(F.count("*").alias("n_reports"))
    overall = trimmed([]).select(F.col("gap").alias("global_gap"))
    out = counts.join(trimmed(["mandi_id"]), "mandi_id").crossJoin(F.broadcast(overall))
    shrunk = (F.col("n_reports") * F.col("gap") + k * F.col("global_gap")) / (F.col("n_reports") + k)
    score = F.when(F.col("n_reports") >= least, clip(10 * (1 - shrunk / 0.25), 0.0, 10.0))
    return out.select("mandi_id", "n_reports", F.col("gap").alias("raw_gap"), shrunk.alias("shrunk_gap"), score.alias("score"))
