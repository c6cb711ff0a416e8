"""Queries of distances, seeds, and what pages of results show."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from harvestry.functions import strings
from harvestry.operators import distances, reports
from harvestry.plans import decisions
from harvestry.plans.registry import DAILY, ORACLE_SQL, daily, query, r, rounded
from harvestry.sources import adapters, seeds

HAVERSINE = "2*6371.0088*asin(sqrt(pow(sin(radians(to_lat-from_lat)/2),2)+cos(radians(from_lat))*cos(radians(to_lat))*pow(sin(radians(to_lon-from_lon)/2),2)))"


@query(f"""WITH v AS (SELECT n_nationkey AS origin_id, 18.5::DOUBLE+n_nationkey%7/10.0::DOUBLE AS from_lat, 74.0::DOUBLE+n_nationkey%11/10.0::DOUBLE AS from_lon FROM nation),
 m AS (SELECT s_suppkey AS mandi_id, 19.0::DOUBLE+s_suppkey%37/20.0::DOUBLE AS to_lat, 73.0::DOUBLE+s_suppkey%41/20.0::DOUBLE AS to_lon FROM supplier), p AS (SELECT * FROM v, m),
 c AS (SELECT CAST(from_lat AS DECIMAL(9,4)) AS a, CAST(from_lon AS DECIMAL(9,4)) AS b, CAST(to_lat AS DECIMAL(9,4)) AS c, CAST(to_lon AS DECIMAL(9,4)) AS d, max((origin_id*7+mandi_id)%200+0.5::DOUBLE) AS km FROM p WHERE (origin_id+mandi_id)%3=0 GROUP BY ALL)
SELECT origin_id, mandi_id, coalesce(km, {r(HAVERSINE + "*1.3", 2)}) AS road_km, CASE WHEN km IS NULL THEN 'haversine_fallback' ELSE 'cache' END AS source
FROM p LEFT JOIN c ON CAST(from_lat AS DECIMAL(9,4))=a AND CAST(from_lon AS DECIMAL(9,4))=b AND CAST(to_lat AS DECIMAL(9,4))=c.c AND CAST(to_lon AS DECIMAL(9,4))=d""")
def road_distances(spark, sf_dir):
    """From each of 25 villages (the nations) to each market, by the cache where it has the pair."""
    k = F.col("n_nationkey")
    villages = adapters.table(spark, sf_dir, "nation").select(k.alias("origin_id"), (18.5 + k % 7 / 10.0).alias("lat"), (74.0 + k % 11 / 10.0).alias("lon"))
    rows = distances.pairs(villages, adapters.mandis(spark, sf_dir))
    km = ((F.col("origin_id") * 7 + F.col("mandi_id")) % 200 + 0.5).alias("road_km")
    cache = rows.where((F.col("origin_id") + F.col("mandi_id")) % 3 == 0).select(*distances.KEY, km, F.lit(None).cast("double").alias("duration_min"), F.lit(0).alias("cached_at"))
    found = distances.road_distances(rows, cache)
    return rounded(found.select("origin_id", "mandi_id", "road_km", "source"), 2)


@query("SELECT count(*) AS decisions, sum(o_totalprice::DECIMAL(14,2))::DOUBLE AS expected_gain, count(DISTINCT o_orderpriority) AS crops FROM orders")
def history_totals(spark, sf_dir):
    history = adapters.table(spark, sf_dir, "orders").select(F.col("o_totalprice").cast("decimal(14,2)").alias("gain"), F.col("o_orderpriority").alias("crop"))
    return reports.history_totals(history).withColumn("expected_gain", F.col("expected_gain").cast("double"))


@query(f"SELECT count(*) AS markets, count_if(rank_flipped)::BIGINT AS flips FROM ({ORACLE_SQL['compare_markets']})")
def flip_count(spark, sf_dir):
    return reports.flips(decisions.compare_markets(spark, sf_dir))


@query(f"SELECT count(*) AS pools, {r('sum(saving_each*members)', 2)} AS saved, (SELECT count(DISTINCT o_orderkey%5000) FROM orders) AS farmers FROM (SELECT o_custkey, count(*) AS members, (max(o_custkey%120+3)*42.0::DOUBLE)*(1-1.0::DOUBLE/count(*)) AS saving_each FROM orders GROUP BY 1)")
def community_totals(spark, sf_dir):
    from harvestry.operators import economics

    orders = adapters.table(spark, sf_dir, "orders")
    members = orders.select(F.col("o_custkey").alias("pool_id"), (F.col("o_orderkey") % 5000).alias("farmer_id"), (F.col("o_custkey") % 120 + 3).cast("double").alias("distance_km"), (F.col("o_orderkey") % 40 + 5).cast("double").alias("qty"), F.lit(90.0).alias("truck_qtl"))
    return rounded(reports.community_totals(economics.pool_economics(members), members), 2)


@query(f"""WITH {DAILY}, p AS (SELECT mandi_id, modal_price AS modal, CASE WHEN day(obs_date)%2=0 THEN modal_price*0.9 END AS p10, CASE WHEN day(obs_date)%3=0 THEN modal_price*1.1 END AS p90 FROM daily),
 d AS (SELECT mandi_id, min(least(modal,p10,p90)) AS lo, max(greatest(modal,p10,p90)) AS hi, count_if(p10 IS NOT NULL AND p90 IS NOT NULL)::BIGINT AS bands FROM p GROUP BY 1)
SELECT mandi_id, {r('lo-(hi-lo)*0.12')} AS low, {r('hi+(hi-lo)*0.12')} AS high, bands FROM d""")
def chart_domain(spark, sf_dir):
    m, d = F.col("modal_price"), F.dayofmonth("obs_date")
    points = daily(spark, sf_dir).select("mandi_id", m.alias("modal"), F.when(d % 2 == 0, m * 0.9).alias("p10"), F.when(d % 3 == 0, m * 1.1).alias("p90"))
    return rounded(reports.chart_domain(points, ["mandi_id"]))


@query(f"WITH {DAILY} SELECT min(obs_date) AS start, DATE '2001-12-26' AS \"end\" FROM daily")
def weather_bounds(spark, sf_dir):
    return reports.window_bounds(daily(spark, sf_dir), dt.date(2001, 12, 31))


@query(f"""WITH {DAILY}, n AS (SELECT commodity_id, mandi_id, max(obs_date) AS obs_date, arg_max(modal_price,obs_date) AS price_now FROM daily GROUP BY 1,2), b AS (SELECT commodity_id, mandi_id, obs_date AS was, modal_price FROM daily),
 x AS (SELECT n.*, modal_price AS price_before, price_now-modal_price AS change FROM n ASOF JOIN b ON n.commodity_id=b.commodity_id AND n.mandi_id=b.mandi_id AND n.obs_date-3>=b.was WHERE n.obs_date-3-b.was<=2)
SELECT commodity_id, mandi_id, obs_date, {r('price_now')} AS price_now, {r('price_before')} AS price_before, {r('change')} AS change, CASE WHEN change>0 THEN 'rise' ELSE 'fall' END AS kind FROM x WHERE abs(change)>=100""")
def price_alerts(spark, sf_dir):
    return rounded(reports.price_alerts(daily(spark, sf_dir), 100.0))


@query(r"""WITH s AS (SELECT s_suppkey AS mandi_id, unnest([s_name, upper(s_name), n_name, lower(s_name)]) AS a, unnest([0,1,2,3]) AS pos FROM supplier JOIN nation ON s_nationkey=n_nationkey),
 t AS (SELECT mandi_id, pos, trim(regexp_replace(regexp_replace(lower(a),'[^a-z0-9_\s]',' ','g'),'\s+',' ','g')) AS alias FROM s), u AS (SELECT mandi_id, alias, min(pos) AS pos FROM t WHERE alias<>'' GROUP BY 1,2)
SELECT mandi_id, (row_number() OVER (PARTITION BY mandi_id ORDER BY pos)-1)::INT AS position, alias FROM u""")
def market_aliases(spark, sf_dir):
    """The spellings of each market, numbered, each once."""
    names = F.transform(F.array("name", F.upper("name"), "district", F.lower("name")), strings.normalise)
    return adapters.mandis(spark, sf_dir).select("mandi_id", *seeds.aliases(names))


SEEDS = ["FRANCE", "Vidarbha", "KENYA", "Konkan", "FRANCE", "Vidarbha"]


@query(f"""WITH s AS (SELECT unnest({SEEDS}) AS name, unnest(range({len(SEEDS)})) AS pos), f AS (SELECT name, min(pos) AS pos FROM s GROUP BY 1), j AS (SELECT name, pos, n_nationkey AS id FROM f LEFT JOIN nation ON n_name=name)
SELECT name, coalesce(id, (SELECT max(n_nationkey) FROM nation)+sum((id IS NULL)::INT) OVER (ORDER BY pos))::BIGINT AS state_id, id IS NULL AS is_new FROM j""")
def seed_states(spark, sf_dir):
    """Names of the settings with the ids they have or get."""
    states = adapters.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("state_id"))
    return seeds.with_ids(states, SEEDS, "name", "state_id")
