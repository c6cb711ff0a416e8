"""As-of lookups."""

import datetime as dt

from harvestry.operators.asof import asof


def test_a_lookup_ahead_keeps_what_it_has_seen(spark):
    day = dt.date(2024, 1, 1)
    left = spark.createDataFrame([(1, day), (1, day + dt.timedelta(days=2)), (1, day + dt.timedelta(days=3))], "mandi_id int, obs_date date")
    right = spark.createDataFrame([(1, day + dt.timedelta(days=1), 5.0), (1, day + dt.timedelta(days=2), 6.0)], "mandi_id int, obs_date date, modal_price double")
    found = asof(left, right, ["mandi_id"], "obs_date", ["modal_price"], forward=True)
    assert {r["obs_date"].day: r["modal_price"] for r in found.collect()} == {1: 5.0, 3: 6.0, 4: None}
    # Spark computes a frame that shrinks anew for each row.
    assert "unboundedfollowing" not in found._jdf.queryExecution().analyzed().toString().lower()
