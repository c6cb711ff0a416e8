"""Cleaning of price reports: reject with a reason, collapse to days, flag, fill short gaps."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestry.config import SETTINGS, Cleaning
from harvestry.functions.dates import business_days_between, is_business_day
from harvestry.operators.series import day_numbers, number

SERIES = ["mandi_id", "commodity_id"]


def nonpositive(cfg: Cleaning = SETTINGS.cleaning) -> Column:
    return F.col("modal_price").isNull() | (F.col("modal_price") <= cfg.min_modal_price)


def inconsistent() -> Column:
    return F.coalesce(F.col("min_price") > F.col("modal_price"), F.lit(False)) | F.coalesce(F.col("modal_price") > F.col("max_price"), F.lit(False))


def tag_rejected(rows: DataFrame, cfg: Cleaning = SETTINGS.cleaning) -> DataFrame:
    """rejected_by: the first rule that a row breaks, null if none."""
    first = F.when(F.col("obs_date").isNull(), "unparseable_date").when(nonpositive(cfg), "nonpositive").when(inconsistent(), "inconsistent")
    return rows.withColumn("rejected_by", first)


def collapse_daily(rows: DataFrame) -> DataFrame:
    """A row for each market, commodity and day: modal price weighted by arrivals (a plain mean if none), widest range, labels seen."""
    weight = F.greatest(F.coalesce("arrival_qtl", F.lit(0.0)), F.lit(0.0))
    label = lambda c: F.sort_array(F.collect_set(F.when(F.col(c) != "", F.col(c))))
    daily = rows.groupBy("obs_date", *SERIES).agg(
        F.sum(weight).alias("weight"), F.sum(F.col("modal_price") * weight).alias("weighted"), F.avg("modal_price").alias("mean"), F.min("min_price").alias("min_price"), F.max("max_price").alias("max_price"),
        F.sum("arrival_qtl").alias("arrival_qtl"), label("variety").alias("varieties"), label("grade").alias("grades"), F.count("*").alias("n_source_rows"),
    )
    modal = F.when(F.col("weight") > 0, F.col("weighted") / F.col("weight")).otherwise(F.col("mean"))
    return daily.select("obs_date", *SERIES, "min_price", "max_price", modal.alias("modal_price"), "arrival_qtl", "varieties", "grades", "n_source_rows")


def _past(cfg_rows: int) -> Window:
    return Window.partitionBy(*SERIES).orderBy("obs_date").rowsBetween(-cfg_rows, -1)


def tag_absurd(daily: DataFrame, cfg: Cleaning = SETTINGS.cleaning) -> DataFrame:
    """trailing_median of the last rows before each, and absurd: whether the price is a multiple of it."""
    past = _past(cfg.trailing_window)
    median = F.when(F.count("modal_price").over(past) >= cfg.least_history, F.percentile("modal_price", 0.5).over(past))
    return daily.withColumn("trailing_median", median).withColumn("absurd", F.coalesce(F.col("modal_price") > cfg.absurd_multiple * F.col("trailing_median"), F.lit(False)))


def mark_absurd(daily: DataFrame, cfg: Cleaning = SETTINGS.cleaning) -> DataFrame:
    """absurd as in tag_absurd; only prices that may be absurd are held against a median.

    Rows are dealt into pieces as long as the frame, so the last rows before one are the first ones of its piece and what
    the piece before had from the same place on. With less than a quarter of the frame below a price in either piece, the
    median isn't below it.
    """
    n, prices = cfg.trailing_window, F.col("modal_price")
    series = Window.partitionBy(*SERIES).orderBy("obs_date")
    rows = daily.withColumn("__piece", F.floor((F.row_number().over(series) - 1) / n))
    piece = Window.partitionBy(*SERIES, "__piece").orderBy("obs_date")
    whole = piece.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    low = F.percentile("modal_price", max(0.0, (n / 4 - 1.01) / max(n - 1, 1))).over(whole)
    seen = F.count("modal_price").over(piece.rowsBetween(Window.unboundedPreceding, -1)).cast("int")
    rows = rows.withColumn("__own", F.struct(F.collect_list("modal_price").over(whole).alias("p"), seen.alias("n"), low.alias("low")))
    rows = rows.withColumn("__before", F.lag("__own", n).over(Window.partitionBy(*SERIES).orderBy("__piece", "obs_date")))
    earlier = F.coalesce(F.slice("__before.p", F.col("__before.n") + 1, F.lit(n)), F.array().cast("array<double>"))
    count = F.coalesce(F.size("__before.p") - F.col("__before.n"), F.lit(0)) + F.col("__own.n")
    past = F.sort_array(F.concat(earlier, F.slice("__own.p", F.lit(1), F.col("__own.n"))))
    odd = count % 2
    # The middle one, or both middle ones by half.
    median = F.aggregate(F.slice(past, F.floor((count + 1) / 2).cast("int"), 2 - odd), F.lit(0.0), lambda a, x: a + x * F.when(odd == 1, 1.0).otherwise(0.5))
    may_be = (count >= cfg.least_history) & ((count < n) | F.coalesce(prices > cfg.absurd_multiple * F.least("__own.low", "__before.low"), F.lit(False)))
    absurd = F.when(may_be, F.coalesce(prices > cfg.absurd_multiple * median, F.lit(False))).otherwise(False)
    return rows.withColumn("absurd", absurd).drop("__piece", "__own", "__before")


def flag_suspect(daily: DataFrame, cfg: Cleaning = SETTINGS.cleaning) -> DataFrame:
    """zscore of each log return against the returns before it, and suspect."""
    series = Window.partitionBy(*SERIES).orderBy("obs_date")
    past = _past(cfg.suspect_window)
    rows = daily.withColumn("log_return", F.ln("modal_price") - F.lag(F.ln("modal_price")).over(series))
    spread = F.when(F.count("log_return").over(past) >= cfg.least_history, F.nullif(F.stddev_samp("log_return").over(past), F.lit(0.0)))
    rows = rows.withColumn("zscore", (F.col("log_return") - F.avg("log_return").over(past)) / spread)
    return rows.withColumn("suspect", F.coalesce(F.abs("zscore") > cfg.suspect_zscore, F.lit(False)))


def impute_gaps(daily: DataFrame, cfg: Cleaning = SETTINGS.cleaning, strict_business_days: bool = False) -> DataFrame:
    """Adds the missing business days of gaps of at most max_impute_gap of them, with the prices before the gap.

    Added rows have no arrivals, aren't suspect and are marked is_imputed. Weekend rows stay; with strict_business_days they go first.
    """
    rows = daily.where(is_business_day(F.col("obs_date"))) if strict_business_days else daily
    after = F.lead("obs_date").over(Window.partitionBy(*SERIES).orderBy("obs_date"))
    rows = rows.withColumn("next_date", after)
    gap = business_days_between(F.col("obs_date"), F.date_sub("next_date", 1))
    # Each row brings itself and what it fills: a union would clean everything twice.
    filled = F.when(gap.between(1, cfg.max_impute_gap), F.filter(F.sequence(F.date_add("obs_date", 1), F.date_sub("next_date", 1)), is_business_day))
    rows = rows.withColumn("__day", F.explode(F.concat(F.array("obs_date"), F.coalesce(filled, F.array().cast("array<date>")))))
    rows = rows.withColumn("is_imputed", F.coalesce(F.col("__day") != F.col("obs_date"), F.lit(False)))
    changes = {"obs_date": F.col("__day"), "arrival_qtl": F.when(~F.col("is_imputed"), F.col("arrival_qtl"))} | ({"suspect": F.col("suspect") & ~F.col("is_imputed")} if "suspect" in daily.columns else {})
    return rows.withColumns(changes).drop("next_date", "__day")


def kept_rows(daily: pa.Table, cfg: Cleaning = SETTINGS.cleaning) -> pa.Table:
    """A series' cleaned rows from its collapsed ones, in a task that has them all: absurd days out as by mark_absurd, short gaps filled as by impute_gaps.

    daily: obs_date, min_price, max_price, modal_price, arrival_qtl; out come these and is_imputed.
    """
    daily = daily.filter(daily.column("obs_date").is_valid())
    daily = daily.take(np.argsort(day_numbers(daily, "obs_date"), kind="stable"))
    prices, known = number(daily, "modal_price")
    value = np.where(known, prices, np.inf)
    # No median is below the least of its frame, so only these prices are held against one.
    least = np.concatenate([np.full(cfg.trailing_window, np.inf), value])
    least = np.lib.stride_tricks.sliding_window_view(least, cfg.trailing_window)[: len(value)].min(axis=1)
    absurd = np.zeros(len(value), bool)
    for i in np.flatnonzero(known & ~(prices <= cfg.absurd_multiple * least)):
        past = prices[max(i - cfg.trailing_window, 0) : i][known[max(i - cfg.trailing_window, 0) : i]]
        if len(past) >= cfg.least_history:
            # The middle one, or both middle ones by half; what is no number comes last.
            past = np.sort(past)
            median = (past[(len(past) - 1) // 2] + past[len(past) // 2]) / 2
            absurd[i] = prices[i] > cfg.absurd_multiple * median
    if absurd.any():
        daily = daily.filter(pa.array(~absurd))
    dn = day_numbers(daily, "obs_date")
    through = lambda d: (d + 3) // 7 * 5 + np.minimum((d + 3) % 7 + 1, 5)
    gap = np.diff(dn, append=dn[-1:])
    holes = np.concatenate([through(dn[1:] - 1) - through(dn[:-1]), [0] * (len(dn) > 0)]).astype(np.int64)
    fills = (holes >= 1) & (holes <= cfg.max_impute_gap)
    # Each row brings itself and the days after it that it fills.
    times = np.where(fills, gap, 1)
    place = np.repeat(np.arange(len(dn)), times)
    ahead = np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times)
    day = dn[place] + ahead
    kept = (ahead == 0) | ((day + 3) % 7 < 5)
    place, day, imputed = place[kept], day[kept], ahead[kept] > 0
    arrival, has = number(daily, "arrival_qtl")
    out = {c: daily.column(c).take(place) for c in ("min_price", "max_price", "modal_price")}
    return pa.table({"obs_date": pa.array(day.astype(np.int32)).cast(pa.date32())} | out | {"arrival_qtl": pa.array(arrival[place], mask=imputed | ~has[place]), "is_imputed": pa.array(imputed)})


def kept_series(rows: DataFrame, cfg: Cleaning = SETTINGS.cleaning) -> DataFrame:
    """The columns of kept_rows and SERIES of clean(rows).kept, each series in one step."""
    daily = collapsed_series(rows, cfg)
    keys = ", ".join(f"{c} {t}" for c, t in daily.select(*SERIES).dtypes)

    def made(key: tuple, table: pa.Table) -> pa.Table:
        kept = kept_rows(table, cfg)
        return pa.table([*(pa.repeat(k, len(kept)) for k in key), *kept.columns], [*SERIES, *kept.column_names])

    return daily.groupBy(*SERIES).applyInArrow(made, f"{keys}, obs_date date, min_price double, max_price double, modal_price double, arrival_qtl double, is_imputed boolean")


def collapsed_series(rows: DataFrame, cfg: Cleaning = SETTINGS.cleaning) -> DataFrame:
    """The accepted rows by day, each market in one place already: what collapses them, and then takes a series as a group, moves nothing again."""
    good = tag_rejected(rows, cfg).where("rejected_by is null").repartition("mandi_id")
    return collapse_daily(good).select(*SERIES, "obs_date", "min_price", "max_price", "modal_price", "arrival_qtl")


def longest_gap(daily: DataFrame) -> DataFrame:
    """mandi_id, commodity_id, longest_gap_days: most business days without a row between two rows."""
    after = F.lead("obs_date").over(Window.partitionBy(*SERIES).orderBy("obs_date"))
    gaps = daily.withColumn("gap", F.greatest(business_days_between(F.col("obs_date"), F.date_sub(after, 1)), F.lit(0)))
    return gaps.groupBy(*SERIES).agg(F.coalesce(F.max("gap"), F.lit(0)).cast("long").alias("longest_gap_days"))


def islands(rows: DataFrame, flag: str) -> DataFrame:
    """Longest run of rows with a flag in each series, by the difference of row numbers."""
    series = Window.partitionBy(*SERIES).orderBy("obs_date")
    flagged = Window.partitionBy(*SERIES, flag).orderBy("obs_date")
    runs = rows.withColumn("island", F.row_number().over(series) - F.row_number().over(flagged)).where(flag)
    return runs.groupBy(*SERIES, "island").count().groupBy(*SERIES).agg(F.max("count").alias("longest_run"))


@dataclass
class Cleaned:
    kept: DataFrame
    quarantine: DataFrame

    def report(self) -> DataFrame:
        """Rejected rows for each rule."""
        return self.quarantine.groupBy("rejected_by").agg(F.count("*").alias("n"))


def clean(rows: DataFrame, cfg: Cleaning = SETTINGS.cleaning) -> Cleaned:
    """Row rules, then collapse, then absurd days out, then suspect days flagged, then short gaps filled."""
    tagged = tag_rejected(rows, cfg)
    daily = mark_absurd(collapse_daily(tagged.where("rejected_by is null")), cfg)
    kept = impute_gaps(flag_suspect(daily.where("not absurd").drop("absurd"), cfg).drop("zscore", "log_return"), cfg)
    bad_rows = tagged.where("rejected_by is not null").select("obs_date", *SERIES, "modal_price", "rejected_by")
    bad_days = daily.where("absurd").select("obs_date", *SERIES, "modal_price", F.lit("absurd").alias("rejected_by"))
    return Cleaned(kept, bad_rows.unionByName(bad_days))
