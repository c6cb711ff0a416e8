"""The training matrix from its tables, and files of policy events."""

import datetime as dt

import pytest

from harvestry.errors import IngestionError
from harvestry.operators import dataset
from harvestry.sources import readers

DAY = dt.date(2024, 1, 1)
START, END = "2024-03-01", "2024-03-12"
PRICES = "commodity_id int, mandi_id int, obs_date date, min_price double, max_price double, modal_price double, arrival_qtl double, is_imputed boolean"


def tables(spark):
    days = [DAY + dt.timedelta(days=i) for i in range(75)]
    rows = [(c, m, d, p * 0.9, p * 1.1, p, 100.0 + i % 7, False) for c, m in ((1, 1), (1, 2), (2, 1), (9, 1)) for i, d in enumerate(days) for p in [1000.0 * c + i]]
    return {
        "prices": spark.createDataFrame(rows, PRICES),
        "weather": spark.createDataFrame([(1, d, 2.0, 30.0, 20.0, False) for d in days], "mandi_id int, obs_date date, rainfall_mm double, tmax_c double, tmin_c double, is_forecast boolean"),
        "festivals": spark.createDataFrame([(dt.date(2024, 3, 20), 0.8)], "fest_date date, demand_effect double"),
        "shocks": spark.createDataFrame([(dt.date(2024, 2, 28), -1, 3, 30, 2)], "obs_date date, direction int, magnitude int, decay_days int, commodity_id int"),
        "commodities": spark.createDataFrame([(1, 2), (2, 4)], "commodity_id int, perishability_class int"),
    }


def test_training_matrix_of_all_series(spark):
    matrix, stats = dataset.build_training_matrix(tables(spark), START, END, (1, 3))
    rows = matrix.collect()
    weekdays = [d for d in (dt.date(2024, 3, 1) + dt.timedelta(days=i) for i in range(12)) if d.weekday() < 5]
    assert {(int(r["commodity_id"]), int(r["mandi_id"]), r["as_of"], r["horizon"]) for r in rows} == {(c, m, d, h) for c, m in ((1, 1), (1, 2), (2, 1)) for d in weekdays for h in (1, 3)}
    assert len(rows) == 3 * len(weekdays) * 2
    assert {(r["commodity_id"], r["perishability_class"]) for r in rows} == {(1.0, 2.0), (2.0, 4.0)}
    assert {r["commodity_id"] for r in rows if r["shock_active_bearish"] > 0} == {2.0}
    assert {r["shock_active_bearish"] for r in rows if r["commodity_id"] == 1.0} == {0.0}
    assert all(r["price_now"] == 1000 * r["commodity_id"] + (r["as_of"] - DAY).days for r in rows)
    assert {r["mandi_id"]: r["rows"] for r in stats.collect()} == {1: 4 * len(weekdays), 2: 2 * len(weekdays)}


def test_one_commodity_and_missing_tables(spark):
    matrix, _ = dataset.build_training_matrix(tables(spark), START, END, (1,), [1, 9])
    assert {r[0] for r in matrix.select("commodity_id").distinct().collect()} == {1.0}
    with pytest.raises(IngestionError, match="festivals"):
        dataset.build_training_matrix({k: v for k, v in tables(spark).items() if k != "festivals"}, START, END)


HEADER = "event_date,event_type,commodity,scope,direction,magnitude,decay_days,title,source_url"


def shocks(spark, tmp_path, *lines, name="a.csv"):
    (tmp_path / name).write_text("\n".join(lines), encoding="utf-8")
    return readers.read_shocks(spark, str(tmp_path / name))


def test_policy_events_of_a_file(spark, tmp_path):
    got = shocks(spark, tmp_path, "﻿# by hand", HEADER, "", '2024-01-05,export_ban,onion,national,-1,3,45,"Ban, total",http://x', "  # none", "2024-02-01,buffer_release,onion,state,-1,2,,Release,").collect()
    assert [(r["line"], r["obs_date"], r["direction"], r["magnitude"], r["decay_days"], r["title"]) for r in sorted(got, key=lambda r: r["line"])] == [
        (4, dt.date(2024, 1, 5), -1, 3, 45, "Ban, total"), (6, dt.date(2024, 2, 1), -1, 2, 30, "Release"),
    ]


@pytest.mark.parametrize("row", ["2024-01-05,x,onion,n,0,3,45,t,u", "2024-01-05,x,onion,n,1,4,45,t,u", "2024-01-05,x,onion,n,1,one,45,t,u", "2024-01-05,x,onion,n,1,1,0,t,u", "05/01/2024,x,onion,n,1,1,9,t,u", "2024-02-31,x,onion,n,1,1,9,t,u", "2024-01-05"])
def test_what_is_not_allowed_is_named_by_its_line(spark, tmp_path, row):
    with pytest.raises(IngestionError, match="a.csv line 3"):
        shocks(spark, tmp_path, HEADER, "2024-01-05,x,onion,n,1,1,,t,u", row)


def test_empty_files_and_missing_columns(spark, tmp_path):
    with pytest.raises(IngestionError, match="empty"):
        shocks(spark, tmp_path, "# nothing")
    with pytest.raises(IngestionError, match="magnitude"):
        shocks(spark, tmp_path, HEADER.replace("magnitude,", ""), name="b.csv")


def test_labels_look_ahead_by_rows_and_not_by_a_sort_for_each_horizon(spark):
    obs = spark.createDataFrame([(1, 1, dt.date(2024, 1, d), p, False) for d, p in ((1, 10.0), (4, 20.0), (11, 40.0))], "commodity_id int, mandi_id int, obs_date date, modal_price double, is_imputed boolean")
    grid = spark.createDataFrame([(1, 1, dt.date(2024, 1, d)) for d in (2, 5, 13)], "commodity_id int, mandi_id int, obs_date date")
    found = dataset.labels(grid, obs, (1, 7))
    rows = {(r["as_of"].day, r["horizon"]): (r["price_now"], r["price_target"], r["target_date"] and r["target_date"].day) for r in found.collect()}
    assert rows == {(2, 1): (10.0, 10.0, 1), (2, 7): (10.0, None, None), (5, 1): (20.0, 20.0, 4), (5, 7): (20.0, 40.0, 11), (13, 1): (40.0, None, None), (13, 7): (40.0, None, None)}
    plan = found._jdf.queryExecution().analyzed().toString()
    # The horizons come after the last window, so none of them is sorted.
    assert plan.index("horizon") < plan.index("Window [") and "Window [" not in plan[: plan.index("Generate")]
