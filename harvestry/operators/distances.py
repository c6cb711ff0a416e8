"""Road distances: looked up by rounded coordinates, else a multiple of the great circle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry.functions.maths import haversine_km
from harvestry.operators.asof import keep_last

FALLBACK_FACTOR = 1.3
KEY = ["from_lat", "from_lon", "to_lat", "to_lon"]


def coordinate(x: Column) -> Column:
    """A coordinate as a key: four places, half to even; null if it is none."""
    return F.bround(x.cast("decimal(14,8)"), 4).cast("decimal(9,4)")


def keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: coordinate(F.col(c)) for c in KEY})


def pairs(origins: DataFrame, markets: DataFrame) -> DataFrame:
    """origin_id, mandi_id and the four coordinates of each origin with each market; origins: a bounded list (origin_id, lat, lon)."""
    o = origins.select("origin_id", F.col("lat").alias("from_lat"), F.col("lon").alias("from_lon"))
    m = markets.select("mandi_id", F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"))
    return m.crossJoin(o)


def road_distances(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """rows with road_km, duration_min and source: `cache`, or `haversine_fallback` where the cache lacks the pair.

    cache: the four coordinates, road_km, duration_min, cached_at; of several rows of one pair the last one counts.
    """
    known = keep_last(keyed(cache.select(*KEY, "road_km", "duration_min", "cached_at")), KEY, ["cached_at", "road_km"])
    known = known.select(*(F.col(c).alias(f"__{c}") for c in KEY), "road_km", "duration_min")
    same = [coordinate(rows[c]) == known[f"__{c}"] for c in KEY]
    straight = F.bround(haversine_km(*(F.col(c).cast("double") for c in KEY)) * FALLBACK_FACTOR, 2)
    source = F.when(F.col("road_km").isNotNull(), "cache").otherwise("haversine_fallback")
    out = rows.join(known, same, "left").withColumn("source", source).withColumn("road_km", F.coalesce("road_km", straight))
    return out.select(*rows.columns, "road_km", "duration_min", "source")


def refreshed(cache: DataFrame, found: DataFrame) -> DataFrame:
    """The cache with distances found anew, each at the time it was found; the old row of a pair goes."""
    new = found.withColumn("cached_at", F.current_timestamp()).select(cache.columns)
    both = keyed(cache).withColumn("__new", F.lit(0)).unionByName(keyed(new).withColumn("__new", F.lit(1)))
    return keep_last(both, KEY, ["__new", "cached_at", "road_km"]).drop("__new")
