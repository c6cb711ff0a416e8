"""Seed rows of the small tables, merged by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestry.errors import ConfigError


def active(markets: DataFrame) -> DataFrame:
    return markets.where("active")


def with_ids(existing: DataFrame, names: list[str], key: str, id_col: str) -> DataFrame:
    """key, id_col, is_new of the given names, in whose order new ones take the ids after the greatest; names: a list in the settings."""
    spark = existing.sparkSession
    seeds = spark.createDataFrame(list(enumerate(dict.fromkeys(names))), f"at int, `{key}` string")
    known = existing.groupBy(key).agg(F.min(id_col).cast("long").alias("__id"))
    top = existing.agg(F.coalesce(F.max(id_col).cast("long"), F.lit(0)).alias("__top"))
    found = seeds.join(known, key, "left").crossJoin(F.broadcast(top)).withColumn("is_new", F.col("__id").isNull())
    nth = F.sum(F.col("is_new").cast("long")).over(Window.orderBy("at"))  # as many rows as the settings have names
    return found.select(key, F.coalesce("__id", F.col("__top") + nth).alias(id_col), "is_new")


def lookup_id(table: DataFrame, key: str, value: str, id_col: str) -> int:
    """The id of a name. Raises ConfigError if it isn't there."""
    row = table.where(F.col(key) == value).agg(F.min(id_col)).first()
    if row[0] is None:
        raise ConfigError(f"{value!r} isn't among {key}")
    return int(row[0])


def aliases(names: Column) -> list[Column]:
    """position, alias: distinct names in the order in which they first stand."""
    return [F.posexplode(F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != "")))).alias("position", "alias")]
