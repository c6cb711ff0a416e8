"""As-of lookups over tables with late revisions, against plain loops."""

import datetime as dt
import random

from harvestry.operators import features as X
from harvestry.operators.asof import asof_known, known_on


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def test_the_last_version_known_on_the_day(spark):
    rng = random.Random(4)
    versions = [(rng.randrange(3), day(d := rng.randrange(40)), day(d + rng.choice([0, 0, 1, 5, 20])), float(rng.randrange(9))) for _ in range(150)]
    versions += [(0, day(3), None, 1.0), (1, None, day(3), 1.0), versions[0], (2, day(30), day(2), 7.5)]  # known before its day
    asked = [(i, rng.randrange(4), day(rng.randrange(60))) for i in range(80)] + [(99, 1, None)]
    right = spark.createDataFrame(versions, "k int, day date, known date, v double")
    left = spark.createDataFrame(asked, "i int, k int, day date")

    def best(k, on, tolerance=None):
        if on is None:
            return (None, None, None)
        seen = [(d, n, v) for kk, d, n, v in versions if kk == k and d is not None and n is not None and d <= on and n <= on]
        d, n, v = max(seen) if seen else (None, None, None)
        return (v, d, n) if d is not None and (tolerance is None or (on - d).days <= tolerance) else (None, None, None)

    for tolerance in (None, 2):
        got = asof_known(left, right, ["k"], "day", "known", ["v"], tolerance)
        assert sorted((r.i, r.v, r.settled_on, r.known_since) for r in got.collect()) == sorted((i, *best(k, on, tolerance)) for i, k, on in asked)
    assert asof_known(left, right.limit(0), ["k"], "day", "known", ["v"]).where("v is not null").count() == 0


def test_features_of_a_day_do_not_see_later_revisions(spark):
    rows = [(1, 1, day(i), day(i), 100.0 + i % 7, 90.0, 110.0, 5.0, False) for i in range(120)]
    schema = "commodity_id int, mandi_id int, obs_date date, known date, modal_price double, min_price double, max_price double, arrival_qtl double, is_imputed boolean"
    late = [(1, 1, day(95), day(101), 500.0, 1.0, 600.0, 1.0, False), (1, 1, day(50), day(101), 900.0, 1.0, 999.0, 1.0, False)]

    def seen(versions, on):
        obs = known_on(spark.createDataFrame(versions, schema), X.SERIES, "obs_date", "known", on)
        grid = spark.createDataFrame([(1, 1, dt.date.fromisoformat(on))], "commodity_id int, mandi_id int, obs_date date")
        return X.base(obs, grid).drop("dn").collect()

    assert seen(rows, str(day(100))) == seen(rows + late, str(day(100)))
    assert seen(rows, str(day(102))) != seen(rows + late, str(day(102)))
