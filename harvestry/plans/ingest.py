"""Queries of ingest: cleaning, units, merging, auditing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from harvestry.functions import dates
from harvestry.operators import cleaning, profile
from harvestry.operators.asof import keep_last
from harvestry.plans.registry import ABSURD, CLEAN, DAILY, RAW, SERIES, SUSPECT, TAGGED, daily, observed, query, r, rounded
from harvestry.sources import adapters, readers, scratch
from harvestry.sources.sinks import upsert

KEY = ["obs_date", "mandi_id", "commodity_id"]


@query(f"""WITH {DAILY}, l AS (SELECT obs_date, mandi_id, string_agg(DISTINCT variety, ',' ORDER BY variety) AS varieties FROM tagged WHERE rejected_by IS NULL GROUP BY ALL)
SELECT obs_date, mandi_id, commodity_id, {r("min_price")} AS min_price, {r("max_price")} AS max_price, {r("modal_price")} AS modal_price, arrival_qtl, n_source_rows, varieties FROM daily JOIN l USING (obs_date, mandi_id)""")
def collapse_daily(spark, sf_dir):
    rows = rounded(daily(spark, sf_dir), 4, "min_price", "max_price", "modal_price")
    return rows.select(*KEY, "min_price", "max_price", "modal_price", "arrival_qtl", "n_source_rows", F.array_join("varieties", ",").alias("varieties"))


@query(f"WITH {TAGGED} SELECT rejected_by, count(*) AS n FROM tagged WHERE rejected_by IS NOT NULL GROUP BY 1")
def reject_rules_count(spark, sf_dir):
    tagged = cleaning.tag_rejected(adapters.raw_observations(spark, sf_dir))
    return tagged.where("rejected_by is not null").groupBy("rejected_by").agg(F.count("*").alias("n"))


@query(f"WITH {ABSURD} SELECT obs_date, mandi_id, {r('modal_price')} AS modal_price, {r('trailing_median')} AS trailing_median, coalesce(modal_price>20*trailing_median,false) AS absurd FROM absurd")
def absurd_filter(spark, sf_dir):
    rows = cleaning.tag_absurd(daily(spark, sf_dir)).select("obs_date", "mandi_id", "modal_price", "trailing_median", "absurd")
    return rounded(rows)


@query(f"WITH {SUSPECT} SELECT obs_date, mandi_id, {r('log_return')} AS log_return, {r('zscore')} AS zscore, suspect FROM flagged")
def suspect_flag(spark, sf_dir):
    rows = cleaning.flag_suspect(cleaning.mark_absurd(daily(spark, sf_dir)).where("not absurd"))
    return rounded(rows.select("obs_date", "mandi_id", "log_return", "zscore", "suspect"))


@query(f"WITH {CLEAN} SELECT obs_date, mandi_id, commodity_id, {r('modal_price')} AS modal_price, arrival_qtl, suspect, is_imputed FROM observed")
def clean_pipeline(spark, sf_dir):
    return rounded(observed(spark, sf_dir).select(*KEY, "modal_price", "arrival_qtl", "suspect", "is_imputed"), 4, "modal_price")


@query(f"""WITH {DAILY.replace("daily AS (", "daily0 AS (")}, daily AS (SELECT * FROM daily0 WHERE isodow(obs_date)<6), n AS (SELECT *, lead(obs_date) OVER ({SERIES}) AS next_date FROM daily),
 h AS (SELECT mandi_id, commodity_id, obs_date AS base, modal_price, CAST(unnest(generate_series(obs_date+1,next_date-1,INTERVAL 1 DAY)) AS DATE) AS obs_date FROM n WHERE next_date>obs_date+1),
 w AS (SELECT *, count(*) OVER (PARTITION BY mandi_id,commodity_id,base) AS k FROM h WHERE isodow(obs_date)<6)
SELECT obs_date, mandi_id, {r("modal_price")} AS modal_price FROM w WHERE k<=3""")
def impute_gaps(spark, sf_dir):
    """Only the rows that are added, business days only."""
    filled = cleaning.impute_gaps(daily(spark, sf_dir), strict_business_days=True).where("is_imputed")
    return rounded(filled.select("obs_date", "mandi_id", "modal_price"))


@query(f"""WITH {DAILY}, n AS (SELECT *, lead(obs_date) OVER ({SERIES}) AS next_date FROM daily),
 h AS (SELECT mandi_id, obs_date, CAST(unnest(generate_series(obs_date+1,next_date-1,INTERVAL 1 DAY)) AS DATE) AS d FROM n WHERE next_date>obs_date+1),
 g AS (SELECT mandi_id, obs_date, count(*) AS k FROM h WHERE isodow(d)<6 GROUP BY ALL)
SELECT m.mandi_id, m.commodity_id, coalesce(max(k),0)::BIGINT AS longest_gap_days FROM (SELECT DISTINCT mandi_id, commodity_id FROM daily) m LEFT JOIN g USING (mandi_id) GROUP BY ALL""")
def longest_gap(spark, sf_dir):
    return cleaning.longest_gap(daily(spark, sf_dir))


@query(f"""WITH {CLEAN}, x AS (SELECT *, row_number() OVER ({SERIES}) - row_number() OVER (PARTITION BY mandi_id, commodity_id, is_imputed ORDER BY obs_date) AS island FROM observed),
 s AS (SELECT mandi_id, commodity_id, island, count(*) AS k FROM x WHERE is_imputed GROUP BY ALL) SELECT mandi_id, commodity_id, max(k) AS longest_run FROM s GROUP BY ALL""")
def islands_imputed(spark, sf_dir):
    return cleaning.islands(observed(spark, sf_dir), "is_imputed")


@query(f"""WITH {DAILY}, s AS (SELECT mandi_id, min(obs_date) AS lo, max(obs_date) AS hi FROM daily GROUP BY 1),
 c AS (SELECT mandi_id, CAST(unnest(generate_series(lo,hi,INTERVAL 1 DAY)) AS DATE) AS obs_date FROM s)
SELECT c.mandi_id, count(*) AS business_days, count(d.obs_date) AS present, count(*)-count(d.obs_date) AS missing FROM c LEFT JOIN daily d USING (mandi_id, obs_date) WHERE isodow(c.obs_date)<6 GROUP BY 1""")
def calendar_reindex(spark, sf_dir):
    rows = daily(spark, sf_dir)
    joined = dates.business_days(rows, ["mandi_id"]).join(rows.select("mandi_id", "obs_date", F.lit(1).alias("there")), ["mandi_id", "obs_date"], "left")
    return joined.groupBy("mandi_id").agg(F.count("*").alias("business_days"), F.count("there").alias("present"), (F.count("*") - F.count("there")).alias("missing"))


@query(f"""WITH {RAW} SELECT variety, {r("sum(modal_price*100)", 2)} AS price_sum, {r("sum(arrival_qtl*10)", 2)} AS arrival_sum, count(modal_price) AS n FROM raw GROUP BY 1""")
def normalise_units(spark, sf_dir):
    rows = readers.normalise_units(adapters.raw_observations(spark, sf_dir), "rupees_per_kg", "tonne")
    return rounded(rows.groupBy("variety").agg(F.sum("modal_price").alias("price_sum"), F.sum("arrival_qtl").alias("arrival_sum"), F.count("modal_price").alias("n")), 2)


@query("SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, max(o_orderkey) AS o_orderkey, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY 1, 2")
def dedupe_keep_last(spark, sf_dir):
    rows = adapters.table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"), "o_orderkey", "o_orderpriority")
    return keep_last(rows, ["o_custkey", "day"], ["o_orderkey"])


@query(f"""WITH {CLEAN}, inc AS (SELECT obs_date, mandi_id, commodity_id, modal_price+1 AS modal_price, (mandi_id%2=0) AS is_imputed, 1 AS n FROM observed WHERE mandi_id%3<2),
 b AS (SELECT obs_date, mandi_id, commodity_id, modal_price, is_imputed, 0 AS n FROM observed UNION ALL SELECT * FROM inc)
SELECT obs_date, mandi_id, commodity_id, {r("modal_price")} AS modal_price, is_imputed FROM b QUALIFY row_number() OVER (PARTITION BY obs_date, mandi_id, commodity_id ORDER BY is_imputed, n DESC)=1""")
def upsert_guarded(spark, sf_dir):
    """Imputed rows never replace real ones."""
    rows = scratch.stored(observed(spark, sf_dir).select(*KEY, "modal_price", "is_imputed"), "observed")
    incoming = rows.where("mandi_id % 3 < 2").withColumn("modal_price", F.col("modal_price") + 1).withColumn("is_imputed", F.col("mandi_id") % 2 == 0)
    return rounded(upsert(rows, incoming, KEY, weak="is_imputed"))


WEATHER = "wx AS (SELECT user_id AS mandi_id, CAST(ts AS DATE) AS obs_date, sum(value) AS rainfall_mm, max(value) AS tmax_c, min(value) AS tmin_c, day(CAST(ts AS DATE))%2=1 AS is_forecast FROM events GROUP BY 1,2,6)"


@query(f"""WITH {WEATHER}, inc AS (SELECT mandi_id, obs_date, rainfall_mm*2 AS rainfall_mm, NOT is_forecast AS is_forecast FROM wx),
 b AS (SELECT mandi_id, obs_date, rainfall_mm, is_forecast, 0 AS n FROM wx UNION ALL SELECT *, 1 FROM inc)
SELECT mandi_id, obs_date, {r("rainfall_mm")} AS rainfall_mm, is_forecast FROM b QUALIFY row_number() OVER (PARTITION BY mandi_id, obs_date ORDER BY is_forecast, n DESC)=1""")
def upsert_weather(spark, sf_dir):
    """Forecasts never replace what was measured."""
    rows = adapters.weather(spark, sf_dir).select("mandi_id", "obs_date", "rainfall_mm", "is_forecast")
    incoming = rows.withColumn("rainfall_mm", F.col("rainfall_mm") * 2).withColumn("is_forecast", ~F.col("is_forecast"))
    return rounded(upsert(rows, incoming, ["mandi_id", "obs_date"], weak="is_forecast"))


@query("SELECT s_suppkey AS mandi_id, s_name AS name FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id=s.s_suppkey AND e.event_type='purchase')")
def anti_missing_weather(spark, sf_dir):
    seen = adapters.table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("mandi_id"))
    return adapters.mandis(spark, sf_dir).select("mandi_id", "name").join(seen, "mandi_id", "left_anti")


@query("SELECT n_name AS district, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey=n_nationkey AND c_acctbal>9000 GROUP BY 1")
def left_count_zero(spark, sf_dir):
    n, c = (adapters.table(spark, sf_dir, t) for t in ("nation", "customer"))
    joined = n.join(c.where("c_acctbal > 9000"), n["n_nationkey"] == c["c_nationkey"], "left")
    return joined.groupBy(F.col("n_name").alias("district")).agg(F.count("c_custkey").alias("n"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal>5000")
def set_difference(spark, sf_dir):
    c, s = adapters.table(spark, sf_dir, "customer"), adapters.table(spark, sf_dir, "supplier")
    return c.select(F.col("c_nationkey").alias("k")).subtract(s.where("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersection(spark, sf_dir):
    c, s = adapters.table(spark, sf_dir, "customer"), adapters.table(spark, sf_dir, "supplier")
    return c.select(F.col("c_nationkey").alias("k")).intersect(s.select("s_nationkey"))


@query(f"""WITH {CLEAN}, st AS (SELECT mandi_id, count(*) AS "rows", min(obs_date) AS first_date, max(obs_date) AS last_date, avg(is_imputed::INT)*100 AS imputed_pct, avg(suspect::INT)*100 AS suspect_pct,
  min(modal_price) AS price_min, median(modal_price) AS price_median, max(modal_price) AS price_max FROM observed GROUP BY 1),
 bd AS (SELECT mandi_id, count(*) AS business_days FROM (SELECT mandi_id, unnest(generate_series(first_date,last_date,INTERVAL 1 DAY)) AS d FROM st) WHERE isodow(d)<6 GROUP BY 1),
 c AS (SELECT *, least(1.0, "rows"/greatest(business_days,1)) AS coverage FROM st JOIN bd USING (mandi_id))
SELECT mandi_id, "rows", first_date, last_date, business_days, {r("imputed_pct")} AS imputed_pct, {r("suspect_pct")} AS suspect_pct, {r("coverage")} AS coverage, {r("price_min")} AS price_min, {r("price_median")} AS price_median, {r("price_max")} AS price_max,
 CASE WHEN "rows">=500 AND coverage>=0.6 THEN 'USABLE' WHEN "rows">=200 AND coverage>=0.35 THEN 'THIN' ELSE 'UNUSABLE' END AS verdict FROM c""")
def audit_verdict(spark, sf_dir):
    rows = profile.audit(observed(spark, sf_dir))
    return rounded(rows.select("mandi_id", "rows", "first_date", "last_date", "business_days", "imputed_pct", "suspect_pct", "coverage", "price_min", "price_median", "price_max", "verdict"))


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 12")
def topn_values(spark, sf_dir):
    return profile.top_values(adapters.table(spark, sf_dir, "part"), "p_type", 12)


@query(f"""WITH {RAW}, d AS (SELECT variety, mandi_id, count(DISTINCT obs_date) AS days FROM raw GROUP BY 1,2)
SELECT variety, mandi_id, days, row_number() OVER (PARTITION BY variety ORDER BY days DESC, mandi_id) AS rank FROM d QUALIFY rank<=5""")
def densest_markets(spark, sf_dir):
    return profile.densest(adapters.raw_observations(spark, sf_dir), "variety", "mandi_id", "obs_date", 5)


@query(f"WITH {RAW} SELECT min(obs_date) AS first_date, max(obs_date) AS last_date, (max(obs_date)-min(obs_date)+1)::INT AS span_days, count(DISTINCT obs_date) AS days FROM raw")
def coverage_span(spark, sf_dir):
    return profile.span(adapters.raw_observations(spark, sf_dir), "obs_date")


@query(f"""WITH {RAW}, p AS (SELECT obs_date, mandi_id, min(min_price) AS lo, max(max_price) AS hi, avg(modal_price) AS mean, count(DISTINCT variety) AS varieties FROM raw GROUP BY 1,2),
 q AS (SELECT obs_date, mandi_id, coalesce(sum(arrival_qtl),0) AS qty FROM raw WHERE grade='O' GROUP BY 1,2)
SELECT obs_date, mandi_id, {r("lo")} AS lo, {r("hi")} AS hi, {r("mean")} AS mean, varieties, qty FROM p LEFT JOIN q USING (obs_date, mandi_id)""")
def prices_with_arrivals(spark, sf_dir):
    """Daily prices, unweighted over varieties, left-joined with daily arrivals."""
    raw = adapters.raw_observations(spark, sf_dir)
    prices = raw.groupBy("obs_date", "mandi_id").agg(F.min("min_price").alias("lo"), F.max("max_price").alias("hi"), F.avg("modal_price").alias("mean"), F.count_distinct("variety").alias("varieties"))
    qty = raw.where("grade = 'O'").groupBy("obs_date", "mandi_id").agg(F.coalesce(F.sum("arrival_qtl"), F.lit(0.0)).alias("qty"))
    return rounded(prices.join(qty, ["obs_date", "mandi_id"], "left"), 4, "lo", "hi", "mean")


@query(f"""WITH {DAILY}, x AS (SELECT *, modal_price-lag(modal_price) OVER ({SERIES}) AS change, row_number() OVER (PARTITION BY mandi_id ORDER BY obs_date DESC) AS back FROM daily)
SELECT mandi_id, obs_date, {r("modal_price")} AS modal_price, {r("change")} AS change, back FROM x WHERE back<=30""")
def mini_series(spark, sf_dir):
    """Day-over-day change in the last 30 rows of each market."""
    rows = daily(spark, sf_dir)
    change = F.col("modal_price") - F.lag("modal_price").over(Window.partitionBy("mandi_id", "commodity_id").orderBy("obs_date"))
    back = F.row_number().over(Window.partitionBy("mandi_id").orderBy(F.desc("obs_date")))
    return rounded(rows.select("mandi_id", "obs_date", "modal_price", change.alias("change"), back.alias("back")).where("back <= 30"))


@query("""SELECT json_extract_string(props,'$.k') AS k, count(*) AS n, sum(coalesce(TRY_CAST(json_extract_string(props,'$.k') AS DOUBLE),0)) AS total FROM events GROUP BY 1""")
def json_effect(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return adapters.table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.sum(F.coalesce(k.try_cast("double"), F.lit(0.0))).alias("total"))


@query("""SELECT event_type, count(*) AS n, string_agg(DISTINCT CAST(user_id%7 AS VARCHAR), ',' ORDER BY CAST(user_id%7 AS VARCHAR)) AS users FROM events GROUP BY 1""")
def label_lists(spark, sf_dir):
    text = (F.col("user_id") % 7).cast("string")
    return adapters.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set(text)), ",").alias("users"))
