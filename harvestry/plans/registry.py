"""Where queries are registered, and the parts that their SQL shares."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestry.operators import cleaning
from harvestry.sources import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NEARLY_HALF = 0.500001


def query(sql: str | None):
    """Registers a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame, places: int = 4, *columns: str) -> DataFrame:
    """df with its double columns, or the given ones, rounded alike in both engines.

    A little more than a half is added, so that sums whose last bits differ fall on the same side of a tie.
    """
    chosen = columns or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.floor(F.col(c) * 10**places + NEARLY_HALF) / 10**places for c in chosen})


def rounded_values(x: np.ndarray, places: int = 4) -> np.ndarray:
    """The same rounding in a task that has a column's values."""
    return np.floor(x * 10**places + NEARLY_HALF) / 10**places


def r(x: str, places: int = 4) -> str:
    """The same rounding in SQL."""
    return f"floor(({x})*{10**places}+{NEARLY_HALF})/{10**places}"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clean row for each market and day."""
    tagged = cleaning.tag_rejected(adapters.raw_observations(spark, sf_dir))
    return cleaning.collapse_daily(tagged.where("rejected_by is null"))


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned series with filled gaps."""
    return cleaning.clean(adapters.raw_observations(spark, sf_dir)).kept


UNIT = "l_extendedprice/l_quantity"
RAW = f"""raw AS (SELECT CAST(l_shipdate AS DATE) AS obs_date, l_suppkey AS mandi_id, 1 AS commodity_id, l_returnflag AS variety, l_linestatus AS grade,
  CASE WHEN l_orderkey%97=3 THEN {UNIT}*2 ELSE {UNIT}*(1-l_discount) END AS min_price,
  CASE WHEN l_orderkey%97=2 THEN {UNIT}*41 ELSE {UNIT}*(1+l_tax) END AS max_price,
  CASE WHEN l_orderkey%97=0 THEN 0.0 WHEN l_orderkey%97=1 THEN NULL WHEN l_orderkey%97=2 THEN {UNIT}*40 ELSE {UNIT} END AS modal_price,
  l_quantity AS arrival_qtl FROM lineitem)"""
TAGGED = f"""{RAW}, tagged AS (SELECT *, CASE WHEN obs_date IS NULL THEN 'unparseable_date' WHEN modal_price IS NULL OR modal_price<=10 THEN 'nonpositive'
  WHEN coalesce(min_price>modal_price,false) OR coalesce(modal_price>max_price,false) THEN 'inconsistent' END AS rejected_by FROM raw)"""
DAILY = f"""{TAGGED}, daily AS (SELECT obs_date, mandi_id, commodity_id, min(min_price) AS min_price, max(max_price) AS max_price,
  CASE WHEN sum(greatest(coalesce(arrival_qtl,0),0))>0 THEN sum(modal_price*greatest(coalesce(arrival_qtl,0),0))/sum(greatest(coalesce(arrival_qtl,0),0)) ELSE avg(modal_price) END AS modal_price,
  sum(arrival_qtl) AS arrival_qtl, count(*) AS n_source_rows FROM tagged WHERE rejected_by IS NULL GROUP BY obs_date, mandi_id, commodity_id)"""
SERIES = "PARTITION BY mandi_id, commodity_id ORDER BY obs_date"
ABSURD = f"""{DAILY}, absurd AS (SELECT *, CASE WHEN count(modal_price) OVER p>=10 THEN quantile_cont(modal_price,0.5) OVER p END AS trailing_median FROM daily
  WINDOW p AS ({SERIES} ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING))"""
SUSPECT = f"""{ABSURD}, good AS (SELECT * FROM absurd WHERE NOT coalesce(modal_price>20*trailing_median,false)),
 rets AS (SELECT *, ln(modal_price)-lag(ln(modal_price)) OVER ({SERIES}) AS log_return FROM good),
 zed AS (SELECT *, (log_return-avg(log_return) OVER p)/CASE WHEN count(log_return) OVER p>=10 THEN nullif(stddev_samp(log_return) OVER p,0) END AS zscore FROM rets
  WINDOW p AS ({SERIES} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
 flagged AS (SELECT *, coalesce(abs(zscore)>6,false) AS suspect FROM zed)"""


def busdays(a: str, b: str) -> str:
    """Business days after a, up to b, in SQL, counted one by one."""
    return f"(SELECT count(*) FROM (SELECT unnest(generate_series({a}+1,{b},INTERVAL 1 DAY)) AS g) WHERE isodow(g)<6)"


#: Series with the next row's day, and gaps filled.
CLEAN = f"""{SUSPECT}, nexts AS (SELECT *, lead(obs_date) OVER ({SERIES}) AS next_date FROM flagged),
 holes AS (SELECT n.*, CAST(unnest(generate_series(n.obs_date+1,n.next_date-1,INTERVAL 1 DAY)) AS DATE) AS hole FROM nexts n WHERE next_date>obs_date+1 AND next_date<obs_date+8),
 weekdays AS (SELECT *, count(*) OVER (PARTITION BY mandi_id,commodity_id,obs_date) AS k FROM holes WHERE isodow(hole)<6),
 observed AS (SELECT obs_date,mandi_id,commodity_id,min_price,max_price,modal_price,arrival_qtl,suspect,false AS is_imputed FROM flagged
  UNION ALL SELECT hole,mandi_id,commodity_id,min_price,max_price,modal_price,NULL,false,true FROM weekdays WHERE k<=3)"""
