"""The nearest markets by road, found over cells of the sphere, and their prices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestry.config import SETTINGS, Features
from harvestry.functions.maths import haversine_km
from harvestry.operators.distances import FALLBACK_FACTOR, road_distances
from harvestry.operators.series import Series

EARTH_KM = 6371.0088
KEYS = ["mandi_id", "commodity_id"]
#: Sides of cells halve from level to level: 4 radii (all in one cell) down to about 0.8 km.
LEVELS = 16
CELL = ["level", "cx", "cy", "cz"]


def _cell(level: Column, *shift: Column) -> list[Column]:
    """The cube of a level in which a point of the unit sphere (x, y, z) lies, moved by so many cubes."""
    side = 4.0 / F.pow(F.lit(2.0), level)
    moved = shift or (F.lit(0),) * 3
    return [(F.floor((F.col(c) + 1.0) / side) + s).alias(f"c{c}") for c, s in zip("xyz", moved, strict=True)]


def nearest(markets: DataFrame, k: int = 5, cache: DataFrame | None = None) -> DataFrame:
    """mandi_id, other, road_km, rank (1 to k): the k other markets of the least road distance, of equal ones those with the least id.

    markets: mandi_id, lat, lon; of several rows of one id the least coordinates count, rows that lack an id or a coordinate have no
    neighbours and are none. cache: see road_distances; a road is never shorter than the great circle. Fewer than k others: all of them.

    Each market takes the smallest cell around it that holds more than k; the k-th road to those bounds how far any of the k nearest
    lies, and the cells of at least that side beside its own hold them all. So no market meets all others unless they lie as near.
    """
    points = markets.where("mandi_id is not null and lat is not null and lon is not null").groupBy("mandi_id").agg(F.min(F.struct("lat", "lon")).alias("p"))
    lat, lon = F.radians("p.lat"), F.radians("p.lon")
    points = points.select("mandi_id", "p.lat", "p.lon", (F.cos(lat) * F.cos(lon)).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), F.sin(lat).alias("z"))
    # Of markets in one place no more than the k + 1 least ids can be anyone's neighbours.
    place = F.row_number().over(Window.partitionBy("lat", "lon").orderBy("mandi_id"))
    others = points.withColumn("place", place).where(F.col("place") <= k + 1).drop("place")
    levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level")
    placed = others.select("*", levels).select(F.col("mandi_id").alias("other"), F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"), "level", *_cell(F.col("level")))
    counts = placed.groupBy(*CELL).agg(F.count("*").alias("n")).where((F.col("n") > k) | (F.col("level") == 0))
    own = points.select("*", levels).select("*", *_cell(F.col("level"))).join(counts, CELL).groupBy("mandi_id", "lat", "lon", "x", "y", "z").agg(F.max("level").alias("level"))

    def ranked(rows: DataFrame) -> DataFrame:
        pairs = rows.where("mandi_id <> other").withColumnsRenamed({"lat": "from_lat", "lon": "from_lon"})
        if cache is None:
            road = F.bround(haversine_km(*map(F.col, ("from_lat", "from_lon", "to_lat", "to_lon"))) * FALLBACK_FACTOR, 2)
            pairs = pairs.withColumn("road_km", road)
        else:
            pairs = road_distances(pairs, cache)
        rank = F.row_number().over(Window.partitionBy("mandi_id").orderBy("road_km", "other"))
        return pairs.withColumn("rank", rank).where(F.col("rank") <= k)

    around = ranked(own.select("*", *_cell(F.col("level"))).join(placed, CELL))
    reach = around.groupBy("mandi_id").agg(F.max("road_km").alias("km"), F.count("*").alias("n"))
    # Roads are rounded to a hundredth. A market that met fewer than k others has met all there are, in the one cell of level 0.
    angle = F.least((F.col("km") + 0.01) / EARTH_KM, F.lit(3.141592653589793))
    fits = F.floor(F.log2(4.0 / (2 * F.sin(angle / 2))) - 1e-9)
    level = F.when(F.col("n") < k, 0).otherwise(F.greatest(F.least(fits, F.lit(LEVELS - 1)), F.lit(0))).cast("int")
    shifts = F.explode(F.expr("flatten(transform(array(-1, 0, 1), i -> flatten(transform(array(-1, 0, 1), j -> transform(array(-1, 0, 1), l -> struct(i as i, j as j, l as l))))))"))
    wide = points.join(reach, "mandi_id").select("mandi_id", "lat", "lon", "x", "y", "z", level.alias("level"), shifts.alias("s"))
    probes = wide.select("mandi_id", "lat", "lon", "level", *_cell(F.col("level"), F.col("s.i"), F.col("s.j"), F.col("s.l")))
    return ranked(probes.join(placed, CELL)).select("mandi_id", "other", "road_km", "rank")


def packed(obs: DataFrame, prepare=None) -> DataFrame:
    """commodity_id, mandi_id and each series' days and prices packed into one row; obs, prepare: as in features.base."""
    types = dict(obs.select(*KEYS).dtypes)
    # The first and the last row also without a price: they bound the days.
    schema = ", ".join(f"{c} {t}" for c, t in types.items()) + ", days binary, prices binary, known binary"

    def made(key: tuple, rows: pa.Table) -> pa.Table:
        series = Series(prepare(rows) if prepare else rows, np.zeros(0, np.int64), SETTINGS.features)
        price, known = series.modal
        parts = (series.dn.astype(np.int32), price, known)
        return pa.table([*(pa.repeat(k, 1) for k in key), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], [*KEYS, "days", "prices", "known"])

    return obs.groupBy(*KEYS).applyInArrow(made, schema)


def nearest_prices(series: DataFrame, near: DataFrame, cfg: Features = SETTINGS.features, each=None) -> DataFrame:
    """commodity_id, mandi_id, obs_date of all business days of each series with nbr_price_mean_k5: the mean of the near markets' last
    prices that are not stale on that day (null: none), and price_vs_near, the log of the own price to it. series: rows of packed().
    each: as in features.base.

    A near market's series travels as one row, and only its reports, not a price for each day.
    """
    types = dict(series.select(*KEYS).dtypes)
    schema = ", ".join(f"{c} {t}" for c, t in types.items()) + ", obs_date date, nbr_price_mean_k5 double, price_vs_near double"

    def unpacked(rows: pa.Table, i: int, of: str = "") -> Series:
        dn, price, known = (np.frombuffer(rows.column(of + c)[i].as_py(), t) for c, t in (("days", np.int32), ("prices", np.float64), ("known", bool)))
        return Series(pa.table({"obs_date": pa.array(dn).cast(pa.date32()), "modal_price": pa.array(price, mask=~known)}), None, cfg)

    def made(key: tuple, own: pa.Table, others: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip((*KEYS, "obs_date", "nbr_price_mean_k5", "price_vs_near"), (*(k.type for k in key), pa.date32(), pa.float64(), pa.float64()), strict=True)})
        market = unpacked(own, 0)
        days, now, known = market.days, *market.last("modal")
        total, n = np.zeros(len(days)), np.zeros(len(days))
        for i in range(others.num_rows):
            other = unpacked(others, i, "__")
            # Its price is seen on its own business days only, from its first row to its last.
            within = (days >= other.dn[0]) & (days <= other.dn[-1]) if len(other.dn) else np.zeros(len(days), bool)
            other.days = days
            age, ok = other.value("days_since_observation")
            price, priced = other.last("modal")
            fresh = within & ok & (age <= cfg.neighbour_staleness_days) & priced
            total, n = total + np.where(fresh, price, 0.0), n + fresh
        mean, met = total / np.maximum(n, 1), n > 0
        both = met & known & (now > 0) & (mean > 0)
        ratio = np.log(np.where(both, now, 1.0) / np.where(both, mean, 1.0))
        values = [pa.array(each(x) if each else x, mask=~ok) for x, ok in ((mean, met), (ratio, both))]
        return pa.table([*(pa.repeat(k, len(days)) for k in key), pa.array(days.astype(np.int32)).cast(pa.date32()), *values], [*KEYS, "obs_date", "nbr_price_mean_k5", "price_vs_near"])

    sent = near.select(F.col("mandi_id").alias("to"), F.col("other").alias("mandi_id")).join(series, "mandi_id")
    sent = sent.select(F.col("to").alias("__mandi_id"), F.col("commodity_id").alias("__commodity_id"), *(F.col(c).alias(f"__{c}") for c in ("days", "prices", "known")))
    return series.groupBy(*KEYS).cogroup(sent.groupBy(*(f"__{c}" for c in KEYS))).applyInArrow(made, schema)
