"""As-of lookups by one sort of both sides, never by a range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: list[str], day: str, values: list[str], tolerance_days: int | None = None, forward: bool = False, found: str = "settled_on") -> DataFrame:
    """left with the values of right's latest row at or before each day (forward: the first at or after it), and the day found.

    Of several rows of one key and day the greatest values count. Null if there is none, or none within the tolerance.
    """
    value = F.struct(F.col(day).alias(found), *(F.col(v) for v in values))
    r = right.select(*keys, day, value.alias("__value")).groupBy(*keys, day).agg(F.max("__value").alias("__value"))
    both = left.withColumn("__left", F.lit(True)).unionByName(r.withColumn("__left", F.lit(False)), allowMissingColumns=True)
    # Forward goes back from the last day: Spark keeps a frame that grows, but computes one that shrinks anew for each row.
    frame = Window.partitionBy(*keys).orderBy(F.desc(day) if forward else F.asc(day)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    pick = F.last("__value", ignorenulls=True).over(frame)
    out = both.withColumn("__found", pick).where("__left")
    if tolerance_days is not None:
        out = out.withColumn("__found", F.when(F.abs(F.datediff(F.col(day), F.col(f"__found.{found}"))) <= tolerance_days, F.col("__found")))
    return out.select(*left.columns, *(F.col(f"__found.{v}").alias(v) for v in values), F.col(f"__found.{found}").alias(found))


def latest(rows: DataFrame, keys: list[str], day: str, values: list[str]) -> DataFrame:
    """The values of the last row of each key."""
    return rows.groupBy(*keys).agg(F.max(F.struct(day, *values)).alias("v")).select(*keys, F.col(f"v.{day}").alias(day), *(F.col(f"v.{v}").alias(v) for v in values))


def keep_last(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) if isinstance(c, str) else c for c in order))
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def asof_known(left: DataFrame, right: DataFrame, keys: list[str], day: str, known: str, values: list[str], tolerance_days: int | None = None, found: str = "settled_on", version: str = "known_since") -> DataFrame:
    """left with the values of right's latest day up to each row's day, as they were known on it: the last version known by then.

    right has a row for each version: `day` is the day it is about, `known` the day it came to be known. A version counts
    from the later of both, so in that order the greatest (day, known, values) so far is the answer: one sort, no range join.
    Versions without a day or a known day never count. Null if nothing was known, or nothing within the tolerance.
    """
    value = F.struct(F.col(day).alias(found), F.col(known).cast("date").alias(version), *(F.col(v) for v in values))
    since = F.greatest(F.col(day), F.col(known).cast("date"))
    r = right.where(F.col(day).isNotNull() & F.col(known).isNotNull()).select(*keys, since.alias(day), value.alias("__value")).groupBy(*keys, day).agg(F.max("__value").alias("__value"))
    both = left.withColumn("__left", F.lit(True)).unionByName(r.withColumn("__left", F.lit(False)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(day).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("__found", F.when(F.col(day).isNotNull(), F.max("__value").over(w))).where("__left")
    if tolerance_days is not None:
        out = out.withColumn("__found", F.when(F.datediff(F.col(day), F.col(f"__found.{found}")) <= tolerance_days, F.col("__found")))
    return out.select(*left.columns, *(F.col(f"__found.{c}").alias(c) for c in (*values, found, version)))


def known_on(versions: DataFrame, keys: list[str], day: str, known: str, on: Column | str) -> DataFrame:
    """The table as it was on a day: of each key and day up to it the last version known by then; of equal ones the greatest."""
    on = F.lit(on).cast("date") if isinstance(on, str) else on
    rows = versions.where((F.col(day) <= on) & (F.col(known).cast("date") <= on))
    rest = [c for c in versions.columns if c not in (*keys, day)]
    last = rows.groupBy(*keys, day).agg(F.max(F.struct(known, *(c for c in rest if c != known))).alias("__last"))
    return last.select(*keys, day, *(F.col(f"__last.{c}").alias(c) for c in rest))
