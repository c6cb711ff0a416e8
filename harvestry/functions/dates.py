"""Days, business days and day-of-year windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day_number(d: Column) -> Column:
    """Days since 1970-01-01."""
    return F.datediff(d, F.lit("1970-01-01").cast("date"))


def is_business_day(d: Column) -> Column:
    return F.weekday(d) < 5


def business_days(series: DataFrame, keys: list[str], day: str = "obs_date") -> DataFrame:
    """A row for each Monday to Friday between the first and the last day of each series."""
    span = series.groupBy(*keys).agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    return span.select(*keys, F.explode(F.sequence("lo", "hi")).alias(day)).where(is_business_day(F.col(day)))


def business_days_between(a: Column, b: Column) -> Column:
    """Mondays to Fridays after a, up to b."""
    through = lambda d: F.floor((day_number(d) + 3) / 7) * 5 + F.least(F.pmod(day_number(d) + 3, F.lit(7)) + 1, F.lit(5))
    return (through(b) - through(a)).cast("long")


def parse_date(text: Column, formats: list[str]) -> Column:
    """The first of the formats that the text has; null if none."""
    return F.coalesce(*(F.try_to_date(text, f) for f in formats))


def in_windows(day: Column, windows) -> Column:
    """Whether a day lies in one of (name, from, to), each MM-dd, both included; one may go over the new year."""
    md = F.date_format(day, "MM-dd")
    found = F.lit(False)
    for _, lo, hi in windows:
        found |= md.between(lo, hi) if lo <= hi else (md >= lo) | (md <= hi)
    return found


def calendar(day: Column) -> list[Column]:
    """dow (Monday 0), month, week_of_year."""
    return [F.weekday(day).alias("dow"), F.month(day).alias("month"), F.weekofyear(day).alias("week_of_year")]


def days_of(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("dn")
