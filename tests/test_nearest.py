"""Nearest markets against every pair: clusters, one place, poles, the date line, lacking coordinates, known roads."""

import datetime as dt
import math
import random

import pytest

from harvestry.operators.nearest import nearest, nearest_prices, packed
from harvestry.plans import names

SCHEMA = "mandi_id int, lat double, lon double"


def straight(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))


def brute(points, k, roads=None):
    out = set()
    for a in points:
        found = sorted(((roads or {}).get((a[0], b[0]), round(straight(a, b) * 1.3, 2)), b[0]) for b in points if b[0] != a[0])[:k]
        out |= {(a[0], other, round(km, 2), n) for n, (km, other) in enumerate(found, 1)}
    return out


def rows(frame):
    return {(r["mandi_id"], r["other"], round(r["road_km"], 2), r["rank"]) for r in frame.collect()}


def clustered():
    rng = random.Random(5)
    points = [(i, 20 + rng.random() / 50, 74 + rng.random() / 50) for i in range(60)]
    points += [(100 + i, 18.5, 73.5) for i in range(12)]
    points += [(200 + i, rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(30)]
    return points + [(300, 90.0, 0.0), (301, 89.99, 170.0), (302, -90.0, 3.0), (303, 0.0, 179.999), (304, 0.0, -179.999)]


def test_clusters_places_poles_and_date_line(spark):
    points = clustered()
    given = points + [(400, None, 74.0), (401, 20.0, None), (None, 20.0, 74.0), points[0], (points[1][0], 80.0, 100.0)]
    assert rows(nearest(spark.createDataFrame(given, SCHEMA), 5)) == brute(points, 5)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_fewer_markets_than_asked_for(spark, n):
    points = [(i, 20.0 + i * 30, 74.0) for i in range(n)]
    assert rows(nearest(spark.createDataFrame(points, SCHEMA), 5)) == brute(points, 5)


def test_known_roads_count_before_straight_lines(spark):
    rng = random.Random(6)
    points = [(i, round(20 + rng.random(), 4), round(74 + rng.random(), 4)) for i in range(25)]
    roads = {(a[0], b[0]): round(straight(a, b) * rng.choice([1.01, 1.5, 4.0]) + 0.01, 2) for a in points for b in points if a != b and rng.random() < 0.5}
    at = {p[0]: p[1:] for p in points}
    cache = spark.createDataFrame([(*at[a], *at[b], km, 1.0, 1) for (a, b), km in roads.items()], "from_lat double, from_lon double, to_lat double, to_lon double, road_km double, duration_min double, cached_at int")
    assert rows(nearest(spark.createDataFrame(points, SCHEMA), 3, cache)) == brute(points, 3, roads)


def test_all_pairs_are_dealt_by_blocks(spark):
    rows = names.haversine_pairs(spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_means_of_near_markets_against_each_day(spark):
    rng, first = random.Random(8), dt.date(2024, 1, 1)
    rows = {(m, i): rng.uniform(900, 1100) for m in range(1, 7) for i in range(m * 3, 60) if rng.random() < 0.4}
    obs = spark.createDataFrame([(1, m, first + dt.timedelta(days=i), p, p, p, 1.0, False) for (m, i), p in rows.items()], "commodity_id int, mandi_id int, obs_date date, modal_price double, min_price double, max_price double, arrival_qtl double, is_imputed boolean")
    near = spark.createDataFrame([(m, o) for m in range(1, 6) for o in range(1, 7) if o != m and (m + o) % 3], "mandi_id int, other int")
    made = nearest_prices(packed(obs), near)
    assert "obs_date" not in made._jdf.queryExecution().analyzed().toString().split("Join")[1].split("\n")[0]
    pairs, seen = [(r["mandi_id"], r["other"]) for r in near.collect()], 0
    span = {m: [i for k, i in rows if k == m] for m in range(1, 7)}
    for r in made.collect():
        m, day, found = r["mandi_id"], (r["obs_date"] - first).days, []
        last = lambda k: max((i for i in span[k] if i <= day), default=None)  # noqa: E731, B023
        for o in (o for k, o in pairs if k == m):
            if min(span[o]) <= day <= max(span[o]) and day - last(o) <= 7:
                found.append(rows[o, last(o)])
        assert r["nbr_price_mean_k5"] == (pytest.approx(sum(found) / len(found)) if found else None)
        assert r["price_vs_near"] == (pytest.approx(math.log(rows[m, last(m)] * len(found) / sum(found))) if found else None)
        seen += 1
    assert seen == sum((first + dt.timedelta(days=i)).weekday() < 5 for m in range(1, 7) for i in range(min(span[m]), max(span[m]) + 1))
