"""Regressions for each group against numpy, with dependent terms, few rows and gaps."""

import math
import random

import numpy as np

from harvestry.operators import glut


def seasons(spark, regions=("a", "b"), n=40, seed=3):
    rng, rows = random.Random(seed), []
    for region in regions:
        price = 1000.0
        for s in range(n):
            area = 50 * math.exp(rng.gauss(0, 0.3))
            price = 900 * math.exp(-0.5 * math.log(area / 50) + rng.gauss(0, 0.05))
            rows.append((1, region, s, price, area, rng.uniform(0, 100), area * rng.uniform(0.1, 0.5)))
    return spark.createDataFrame(rows, "commodity_id int, region string, season int, price double, area double, rain double, stock double")


def test_coefficients_are_those_of_numpy(spark):
    rows = glut.season_rows(seasons(spark)).cache()
    found = {r.region: r for r in glut.fit(rows).collect()}
    for region, part in rows.toPandas().dropna(subset=["log_price", *glut.TERMS]).groupby("region"):
        x = np.column_stack([np.ones(len(part)), part[glut.TERMS].to_numpy(float)])
        b, rss = np.linalg.lstsq(x, part.log_price.to_numpy(), rcond=None)[:2]
        got = found[region]
        assert got.n == len(part) == 39 and got.problem is None
        assert np.allclose([got.intercept, *(got[f"b_{t}"] for t in glut.TERMS)], b, rtol=1e-7, atol=1e-9)
        assert math.isclose(got.sigma, math.sqrt(rss[0] / (39 - 6)), rel_tol=1e-7)
        assert math.isclose(got.r2, 1 - rss[0] / ((part.log_price - part.log_price.mean()) ** 2).sum(), rel_tol=1e-7)
        assert -0.6 < got.b_log_area < -0.4


def test_large_means_cost_no_digits(spark):
    rows = spark.createDataFrame([(1, 1e9 + i, 3.0 * i + (i % 3)) for i in range(50)], "g int, x double, y double")
    got = glut.least_squares(rows, ["g"], "y", ["x"]).first()
    i = np.arange(50)
    assert math.isclose(got.b_x, np.polyfit(i, 3.0 * i + i % 3, 1)[0], rel_tol=1e-6)


def test_dependent_terms_are_named_and_few_rows_too(spark):
    rows = [("twice", float(i), 2.0 * i + 1, float(i)) for i in range(20)]
    rows += [("same", 5.0, float(i * i), float(i)) for i in range(20)]
    rows += [("few", float(i), float(i * i), float(i)) for i in range(3)]
    rows += [(None, float(i), float(i * i), 1.0 + 2 * i - 0.5 * i * i) for i in range(9)]
    rows += [("none", None, 1.0, 1.0), ("none", float("nan"), 1.0, 1.0), ("none", float("inf"), 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "g string, u double, v double, y double")
    got = {r.g: r for r in glut.least_squares(frame, ["g"], "y", ["u", "v"]).collect()}
    assert {g: r.problem for g, r in got.items()} == {"twice": "dependent:v", "same": "dependent:u", "few": "too_few_rows", None: None}
    assert all(got[g].b_u is None and got[g].intercept is None and got[g].sigma is None for g in ("twice", "same", "few"))
    assert np.allclose([got[None].intercept, got[None].b_u, got[None].b_v, got[None].sigma], [1, 2, -0.5, 0], atol=1e-6)
    assert glut.least_squares(frame.limit(0), ["g"], "y", ["u", "v"]).collect() == []


def test_seasons_before_are_those_just_before(spark):
    rows = [(1, "a", s, p, 10.0, float(s), 1.0) for s, p in ((0, 100.0), (1, 110.0), (3, 130.0), (4, 0.0), (5, 150.0))]
    found = {r.season: r for r in glut.season_rows(spark.createDataFrame(rows, "commodity_id int, region string, season int, price double, area double, rain double, stock double")).collect()}
    assert [found[s].log_price_before for s in (0, 3)] == [None, None]
    assert math.isclose(found[1].log_price_before, math.log(100)) and math.isclose(found[4].log_price_before, math.log(130))
    assert found[4].log_price is None and found[5].log_price_before is None
    assert found[4].price_last_year == 100 and found[5].price_last_year == 110 and found[3].price_last_year is None
    assert found[0].rain_anomaly == -2 and found[4].rain_anomaly == 2 and found[3].rain_anomaly == 0


def test_more_area_warns(spark):
    rows = seasons(spark, n=40).collect()
    late = [(1, g, 40, 1.0, 200.0, 50.0, 60.0) for g in "ab"]
    frame = glut.season_rows(spark.createDataFrame(rows + late, "commodity_id int, region string, season int, price double, area double, rain double, stock double"))
    fits = glut.fit(frame.where("season < 40"))
    for w in glut.warnings(frame, fits).collect():
        assert w.season == 40 and w.low < w.high and w.warn
    assert [w.warn for w in glut.warnings(frame.where("season < 40"), fits.where("region = 'a'")).orderBy("region").collect()][1] is None
