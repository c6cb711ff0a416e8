"""Queries of paged sources and of tables with late revisions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from harvestry.operators.asof import asof_known, known_on
from harvestry.plans.registry import RAW, query, r, rounded
from harvestry.sources import adapters, paged, scratch

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(f"""SELECT o_orderpriority AS district, CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS month, count(*) AS n, {r("sum(o_totalprice)", 2)} AS total FROM orders
WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '2001-12-31' AND o_orderpriority IN ({", ".join(f"'{p}'" for p in PRIORITIES)}) GROUP BY 1, 2""")
def paged_source(spark, sf_dir):
    """Orders that came as pages, by district and windows of half a year; what two windows both have is there once."""
    rows = adapters.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").cast("double").alias("price"))
    landing, first, last = scratch.new_folder(spark, "pages"), date(1995, 1, 1), date(2001, 12, 31)
    url = "http://localhost/orders"
    paged.land(rows, landing, url, "o_orderpriority", "day", ["o_orderkey"], PRIORITIES, first, last)
    pages = paged.read_paged(spark, ["o_orderkey", "day", "price", "district"], url=url, landing=landing, districts=PRIORITIES, from_=first.isoformat(), to=last.isoformat(), offline="true")
    once = pages.dropDuplicates(["district", "o_orderkey"])
    out = once.groupBy("district", F.trunc(F.col("day").cast("date"), "month").alias("month")).agg(F.count("*").alias("n"), F.sum(F.col("price").cast("double")).alias("total"))
    return rounded(out, 2, "total")


#: Each report is known up to ten days after its day; reports of one market and day are each other's revisions.
VERSIONS = f"""{RAW.replace("SELECT CAST(l_shipdate", "SELECT (l_orderkey+l_linenumber)%3*5 AS late, CAST(l_shipdate", 1)},
 ver AS (SELECT mandi_id, obs_date, CAST(obs_date+late::INT AS DATE) AS known, modal_price FROM raw WHERE modal_price>10)"""


def _versions(spark, sf_dir):
    late = ((F.col("l_orderkey") + F.col("l_linenumber")) % 3 * 5).cast("int")
    rows = adapters.raw_observations(spark, sf_dir, late.alias("late")).where("modal_price > 10")
    return rows.select("mandi_id", "obs_date", F.date_add("obs_date", F.col("late")).alias("known"), "modal_price")


@query(f"""WITH {VERSIONS}, mk AS (SELECT count(*) AS n FROM supplier), o AS (SELECT o_orderkey, o_custkey%(SELECT n FROM mk)+1 AS mandi_id, CAST(o_orderdate AS DATE) AS obs_date FROM orders),
 j AS (SELECT o.*, modal_price, ver.obs_date AS settled_on, known AS known_since FROM o LEFT JOIN ver ON ver.mandi_id=o.mandi_id AND ver.obs_date<=o.obs_date AND ver.known<=o.obs_date
  QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY ver.obs_date DESC NULLS LAST, known DESC, modal_price DESC)=1)
SELECT o_orderkey, mandi_id, obs_date, {r("modal_price")} AS modal_price, settled_on, known_since FROM j""")
def asof_revised(spark, sf_dir):
    """Each order's last price, as it was known on the order's day."""
    markets = adapters.table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    orders = adapters.table(spark, sf_dir, "orders").crossJoin(F.broadcast(markets))  # one row
    orders = orders.select("o_orderkey", (F.col("o_custkey") % F.col("n") + 1).alias("mandi_id"), F.col("o_orderdate").cast("date").alias("obs_date"))
    return rounded(asof_known(orders, _versions(spark, sf_dir), ["mandi_id"], "obs_date", "known", ["modal_price"]))


@query(f"""WITH {VERSIONS} SELECT mandi_id, obs_date, max(known) AS known, {r("arg_max(modal_price, (known, modal_price))")} AS modal_price FROM ver WHERE obs_date<=DATE '1998-06-30' AND known<=DATE '1998-06-30' GROUP BY 1, 2""")
def prices_known_on(spark, sf_dir):
    """The table of prices as it was on a day."""
    return rounded(known_on(_versions(spark, sf_dir), ["mandi_id"], "obs_date", "known", "1998-06-30"))
