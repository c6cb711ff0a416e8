"""Ranks and quantiles of a column, without a task that holds all its values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256  # ranges of values at most; more only makes each smaller


def edges(rows: DataFrame, value: str) -> list[float]:
    """Values that cut the column in ranges of about as many rows; they decide how the work is split, not the result."""
    n = min(RANGES, max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    found = rows.agg(F.percentile_approx(F.col(value).cast("double"), [i / n for i in range(1, n)])).first()[0]
    return sorted(set(found or []))


def running(rows: DataFrame, value: str, cuts: list[float], by: list[str] = (), weight: str | None = None) -> DataFrame:
    """by, value, k (its rows or their weight), upto (the k of all values up to it), n (the k of the group).

    A row for each distinct value of a group; null values are left out. Values are counted first, then summed within
    ranges, and a range's sum is carried to those after it.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg((F.sum(weight) if weight else F.count("*")).alias("k"))
    place = F.size(F.filter(F.lit(cuts), lambda e: e < F.col(value).cast("double"))) if cuts else F.lit(0)
    ranged = counts.withColumn("__range", place)
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))  # a row for each range
    sums = ranged.groupBy(*by, "__range").agg(F.sum("k").alias("__sum"))
    sums = sums.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__range").alias("__of"), (F.sum("__sum").over(group.orderBy("__range")) - F.col("__sum")).alias("__before"), F.sum("__sum").over(group).alias("n"))
    same = F.col("__range") == F.col("__of")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    within = F.sum("k").over(Window.partitionBy(*by, "__range").orderBy(value))
    return ranged.withColumn("__within", within).join(sums, same).select(*by, value, "k", (F.col("__before") + F.col("__within")).alias("upto"), "n")


def at_rank(value: str, rank: Column) -> Column:
    """The value of a rank that counts from 0: an aggregate over running()."""
    return F.min(F.when(F.col("upto") > rank, F.col(value)))


def quantile(value: str, q: float) -> Column:
    """The interpolated quantile: an aggregate over running()."""
    place = q * (F.col("n") - 1)
    share = F.max(place - F.floor(place))
    return at_rank(value, F.floor(place)) * (1 - share) + at_rank(value, F.ceil(place)) * share
