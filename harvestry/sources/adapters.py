"""The driver's tables seen as market data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Festivals within the tables' years.
FESTIVALS = [(f"{year}-{md}", name, effect) for year in range(1995, 2002) for md, name, effect in (("01-14", "Sankranti", 0.5), ("03-20", "Gudi Padwa", 0.8), ("08-29", "Ganesh Chaturthi", 1.0), ("10-24", "Diwali", 1.0))]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_observations(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Price reports from lineitem: mandi = supplier, variety and grade = flags; some rows are made faulty, so that cleaning has work."""
    lines = table(spark, sf_dir, "lineitem")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    fault = F.col("l_orderkey") % 97
    modal = F.when(fault == 0, 0.0).when(fault == 1, None).when(fault == 2, unit * 40).otherwise(unit)
    low = F.when(fault == 3, unit * 2).otherwise(unit * (1 - F.col("l_discount")))
    high = F.when(fault == 2, unit * 41).otherwise(unit * (1 + F.col("l_tax")))
    return lines.select(
        F.col("l_shipdate").cast("date").alias("obs_date"), F.col("l_suppkey").alias("mandi_id"), F.lit(1).alias("commodity_id"), F.col("l_returnflag").alias("variety"), F.col("l_linestatus").alias("grade"),
        low.alias("min_price"), high.alias("max_price"), modal.alias("modal_price"), F.col("l_quantity").alias("arrival_qtl"), *more,
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily weather from events, on the events' own days: mandi = user, rain = sum of values, odd days are forecasts."""
    day = F.col("ts").cast("date")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("mandi_id"), day.alias("obs_date"), "value")
    daily = events.groupBy("mandi_id", "obs_date").agg(F.sum("value").alias("rainfall_mm"), F.max("value").alias("tmax_c"), F.min("value").alias("tmin_c"))
    return daily.withColumn("is_forecast", F.dayofmonth("obs_date") % 2 == 1)


def market_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily weather moved back by the fewest whole leap cycles of four years that bring its last day to the last price's or before.

    Months and days stay, so seasons, forecasts and the distances between days do too.
    """
    last_price = table(spark, sf_dir, "lineitem").agg(F.max(F.col("l_shipdate").cast("date")).alias("p"))
    last_event = table(spark, sf_dir, "events").agg(F.max(F.col("ts").cast("date")).alias("e"))
    later_in_year = (F.date_format("e", "MMdd") > F.date_format("p", "MMdd")).cast("int")
    years = F.greatest(F.ceil((F.year("e") - F.year("p") + later_in_year) / 4) * 4, F.lit(0))
    back = last_price.crossJoin(last_event).select(F.coalesce(years, F.lit(0)).cast("int").alias("years"))
    return weather(spark, sf_dir).crossJoin(F.broadcast(back)).withColumn("obs_date", F.add_months("obs_date", F.col("years") * -12)).drop("years")


def shocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy events from all urgent orders: direction by status, magnitude by price."""
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return orders.select(
        F.col("o_orderdate").cast("date").alias("obs_date"), F.when(F.col("o_orderstatus") == "F", -1).otherwise(1).alias("direction"),
        (F.floor(F.col("o_totalprice")) % 3 + 1).cast("int").alias("magnitude"), F.lit(30).alias("decay_days"), F.col("o_orderkey").alias("event_id"),
    )


def festivals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FESTIVALS, "d string, name string, demand_effect double").select(F.to_date("d").alias("fest_date"), "name", "demand_effect")


def mandis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets from suppliers: nation = district, region = state; coordinates and road distances by rule."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return joined.select(
        F.col("s_suppkey").alias("mandi_id"), F.col("s_name").alias("name"), F.col("n_name").alias("district"), F.col("r_name").alias("state"),
        (19.0 + F.col("s_suppkey") % 37 / 20.0).alias("lat"), (73.0 + F.col("s_suppkey") % 41 / 20.0).alias("lon"), (F.col("s_suppkey") * 7 % 120 + 3).cast("double").alias("distance_km"),
    )
