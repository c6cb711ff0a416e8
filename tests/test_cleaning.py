"""Closed-form cases of cleaning, as-of lookups, merging and the small functions."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from harvestry import schemas
from harvestry.errors import ConfigError, IngestionError
from harvestry.functions import dates, maths, strings
from harvestry.operators import cleaning, decision, economics
from harvestry.operators.asof import asof
from harvestry.operators.bot import advance, conversation_steps
from harvestry.operators.resolve import resolve
from harvestry.sources import readers, sinks

DAY = dt.date(2024, 1, 1)


def series(spark, modal, start=DAY):
    rows = [(start + dt.timedelta(days=i), 1, 1, "", "", None if m is None else m * 0.9, None if m is None else m * 1.1, m, 100.0) for i, m in enumerate(modal)]
    return spark.createDataFrame(rows, "obs_date date, mandi_id int, commodity_id int, variety string, grade string, min_price double, max_price double, modal_price double, arrival_qtl double")


def test_rules(spark):
    got = [r[0] for r in cleaning.tag_rejected(series(spark, [1500.0, 0.0, 10.0, None])).orderBy("obs_date").select("rejected_by").collect()]
    assert got == [None, "nonpositive", "nonpositive", "nonpositive"]
    bad = series(spark, [1500.0]).withColumn("min_price", F.lit(1600.0))
    assert cleaning.tag_rejected(bad).first()["rejected_by"] == "inconsistent"


@pytest.mark.parametrize(("last", "found"), [(45000.0, 1), (4500.0, 0)])
def test_absurd(spark, last, found):
    assert cleaning.tag_absurd(series(spark, [1500.0] * 39 + [last])).where("absurd").count() == found


def test_suspect_flags_only_the_jump(spark):
    rows = cleaning.flag_suspect(series(spark, [1500.0 + 5 * (i % 3) for i in range(59)] + [4200.0]))
    assert [r["obs_date"] for r in rows.where("suspect").collect()] == [DAY + dt.timedelta(days=59)]


def test_impute_fills_short_gaps_only(spark):
    business = [d for d in (DAY + dt.timedelta(days=i) for i in range(19)) if d.weekday() < 5]
    missing = {dt.date(2024, 1, 3), dt.date(2024, 1, 4), *(dt.date(2024, 1, d) for d in (9, 10, 11, 12, 15, 16))}
    rows = series(spark, [1500.0] * 19).where(F.col("obs_date").isin([d for d in business if d not in missing]))
    filled = cleaning.impute_gaps(rows).where("is_imputed").orderBy("obs_date").collect()
    assert [r["obs_date"] for r in filled] == [dt.date(2024, 1, 3), dt.date(2024, 1, 4)]
    assert {r["arrival_qtl"] for r in filled} == {None}
    assert cleaning.longest_gap(rows).first()["longest_gap_days"] == 6


def test_collapse_weights_by_arrivals(spark):
    rows = spark.createDataFrame([(DAY, 1, 1, "Red", "", None, 1100.0, 1000.0, 900.0), (DAY, 1, 1, "Local", "", 1000.0, 2200.0, 2000.0, 100.0)], series(spark, [1.0]).schema)
    r = cleaning.collapse_daily(rows).first()
    assert (r["modal_price"], r["arrival_qtl"], r["min_price"], r["max_price"], r["varieties"]) == (1100.0, 1000.0, 1000.0, 2200.0, ["Local", "Red"])


def test_bad_rows_go_before_the_collapse(spark):
    rows = series(spark, [1500.0]).unionByName(series(spark, [0.0]))
    got = cleaning.clean(rows)
    assert [r["modal_price"] for r in got.kept.collect()] == [1500.0]
    assert [tuple(r) for r in got.report().collect()] == [("nonpositive", 1)]


def test_units(spark):
    rows = series(spark, [18.6]).withColumn("arrival_qtl", F.lit(9.0))
    r = readers.normalise_units(rows, "rupees_per_kg", "tonne").first()
    assert (round(r["modal_price"], 6), r["arrival_qtl"]) == (1860.0, 90.0)
    with pytest.raises(IngestionError):
        readers.normalise_units(rows, "rupees_per_kg", "bale")


def test_normalise_and_ratio(spark):
    names = spark.createDataFrame([("Onion(Big)",), ("  PIMPALGAON  BASWANT ",), ("Éclair-Naïve",)], "n string")
    assert [r[0] for r in names.select(strings.normalise(F.col("n"))).collect()] == ["onion big", "pimpalgaon baswant", "eclair naive"]
    pair = spark.createDataFrame([("lasalgaon", "lasalgoan"), ("a b", "b a"), ("", "")], "a string, b string")
    assert [round(r[0], 1) for r in pair.select(strings.token_sort_ratio(F.col("a"), F.col("b"))).collect()] == [88.9, 100.0, 100.0]


def test_haversine_and_digits(spark):
    r = spark.range(1).select(maths.haversine_km(F.lit(20.1436), F.lit(74.2372), F.lit(19.9975), F.lit(73.7898)), strings.indian_digits(F.lit(18273558)), strings.indian_digits(F.lit(-123)), strings.compact_rupees(F.lit(12345678.0))).first()
    assert 45 < r[0] < 65
    assert tuple(r)[1:] == ("1,82,73,558", "-123", "₹1.23 Cr")


def test_business_days_between(spark):
    rows = [(a, b) for a in (DAY + dt.timedelta(days=i) for i in range(9)) for b in (a + dt.timedelta(days=j) for j in range(12))]
    got = spark.createDataFrame(rows, "a date, b date").select("a", "b", dates.business_days_between(F.col("a"), F.col("b")).alias("k")).collect()
    for r in got:
        assert r["k"] == sum((r["a"] + dt.timedelta(days=i)).weekday() < 5 for i in range(1, (r["b"] - r["a"]).days + 1))


def test_asof_with_tolerance_and_forward(spark):
    right = spark.createDataFrame([(1, dt.date(2024, 1, 1), 1000.0), (1, dt.date(2024, 1, 5), 1100.0), (1, dt.date(2024, 1, 20), 900.0), (1, dt.date(2024, 1, 5), 1050.0)], "k int, d date, p double")
    left = spark.createDataFrame([(1, dt.date(2024, 1, 6)), (1, dt.date(2024, 1, 10)), (1, dt.date(2023, 12, 1)), (2, dt.date(2024, 1, 6))], "k int, d date")
    got = {(r["k"], r["d"]): r["p"] for r in asof(left, right, ["k"], "d", ["p"], 2).collect()}
    assert got == {(1, dt.date(2024, 1, 6)): 1100.0, (1, dt.date(2024, 1, 10)): None, (1, dt.date(2023, 12, 1)): None, (2, dt.date(2024, 1, 6)): None}
    ahead = {(r["k"], r["d"]): r["p"] for r in asof(left, right, ["k"], "d", ["p"], forward=True).collect()}
    assert ahead[(1, dt.date(2024, 1, 10))] == 900.0


@pytest.mark.parametrize(("old", "new", "kept"), [(True, True, 2.0), (False, False, 2.0), (False, True, 1.0), (True, False, 2.0)])
def test_upsert_guard(spark, old, new, kept):
    a = spark.createDataFrame([("k", None, 1.0, old)], "k string, v string, x double, is_imputed boolean")
    b = spark.createDataFrame([("k", "", 2.0, new)], "k string, v string, x double, is_imputed boolean")
    assert [r["x"] for r in sinks.upsert(a, b, ["k", "v"], weak="is_imputed").collect()] == [kept]


def test_run_bookkeeping(spark, tmp_path):
    at = str(tmp_path / "runs")
    with sinks.ingestion_run(spark, "prices", at) as c:
        c.rows_in, c.rows_kept, c.rows_rejected = 3, 2, 1
    with pytest.raises(ValueError), sinks.ingestion_run(spark, "weather", at):
        raise ValueError("no file")
    assert {(r["job"], r["status"]) for r in spark.read.parquet(at).collect()} == {("prices", "partial"), ("weather", "failed")}
    assert sinks.run_status(5, 0, 5) == "failed"


def test_tables_and_keys(spark, tmp_path):
    assert len(schemas.TABLES) == 19
    for name in schemas.TABLES:
        assert set(schemas.key(name)) <= set(schemas.schema(name).names)
    with pytest.raises(ConfigError):
        schemas.assert_unique(spark.createDataFrame([(1,), (1,)], "id int"), ["id"])
    sinks.create_table(spark, str(tmp_path / "t"), "mandis")
    with pytest.raises(Exception, match="exists"):
        sinks.create_table(spark, str(tmp_path / "t"), "mandis")


def test_csv_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Price Date,Market Name,Commodity,Modal Price\n# note\n01/02/2024,X,Onion,100\n05/02/2024,Y,Onion,200\n")
    df = readers.read_csv(spark, str(tmp_path / "*.csv"), comment="#")
    assert df.count() == 2
    assert readers.detect_columns(df.columns) == {"obs_date": "Price Date", "mandi": "Market Name", "commodity": "Commodity", "modal_price": "Modal Price"}
    assert readers.detect_date_format(df, "Price Date") == "d/M/yyyy"
    with pytest.raises(ConfigError):
        readers.read_csv(spark, str(tmp_path / "a.csv"), required=["State"])


def test_json_readers(spark, tmp_path):
    (tmp_path / "w.json").write_text('{"mandi_id": 1, "daily": {"time": ["2024-01-01", "2024-01-02"], "precipitation_sum": [1.0, 2.0], "temperature_2m_max": [30.0, 31.0]}}')
    rows = readers.read_columnar_json(spark, str(tmp_path / "w.json")).orderBy("obs_date").collect()
    assert [(r["rainfall_mm"], r["tmax_c"], r["tmin_c"]) for r in rows] == [(1.0, 30.0, None), (2.0, 31.0, None)]
    (tmp_path / "p1.json").write_text('{"total": 2, "records": [{"market": "X", "modal_price": "5"}, {"market": "Y"}]}')
    got = readers.read_json_pages(spark, str(tmp_path / "p*.json"), ["market", "modal_price"]).orderBy("market").collect()
    assert [tuple(r) for r in got] == [("X", "5"), ("Y", None)]


def test_resolution_order(spark):
    pool = spark.createDataFrame([(1, "Lasalgaon", "Nashik"), (2, "Lasalgaon Vinchur", "Nashik"), (3, "Yeola", "Pune")], "entity_id int, name string, district string")
    names = spark.createDataFrame([("LASALGAON", "Nashik"), ("Lasalgaon (Niphad)", "Nashik"), ("Lasalgaon Vinchurr", None), ("Yeola", "Nashik"), ("Mumbai", None)], "raw string, district string")
    got = {r["raw"]: (r["entity_id"], r["method"]) for r in resolve(names, pool).collect()}
    assert got == {"LASALGAON": (1, "exact"), "Lasalgaon (Niphad)": (1, "prefix"), "Lasalgaon Vinchurr": (1, "prefix"), "Yeola": (None, "none"), "Mumbai": (None, "none")}


def test_net_in_hand(spark):
    lot = spark.createDataFrame([(2000.0, 90.0, 0, 10.0, "B", "ambient", 3.0, 1.05, 0.3)], "price double, qty double, days int, distance_km double, grade string, storage string, commission_pct double, cess_pct double, other_pct double")
    r = economics.net_in_hand(lot).select("net_total", "net_per_qtl", economics.waterfall_total(economics.breakdown()).alias("total")).first()
    assert r["net_total"] == pytest.approx(180000 - 180000 * 0.0435 - 90 * 23 - 420)
    assert r["total"] == pytest.approx(r["net_total"])


def test_reasons_and_confidence(spark):
    r = spark.range(1).select(
        decision.reasons(F.expr("array(named_struct('name','a','weight',0.1D), named_struct('name','b','weight',-0.5D), named_struct('name','c','weight',0.3D))"), F.expr("map('a','first','b','second','c','third')")),
        decision.confidence(F.lit(90.0), F.lit(100.0), F.lit(110.0), F.lit(1.0), F.lit(1.0)),
    ).first()
    assert r[0] == "second and third"
    assert r[1] == pytest.approx(0.5 * (1 - 0.1 / 0.3) + 0.5)


def test_conversation_is_the_same_step_by_step(spark):
    texts = ["hi", "onion 80 quintal", "pool", "shed", "what", "A", "1500", "hello"]
    want, cursor = [], 0
    for t in texts:
        cursor, step = advance(cursor, t)
        want.append(step)
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "conv_id long, turn long, text string")
    assert [r["step"] for r in conversation_steps(rows).orderBy("turn").collect()] == want


def test_gaps_are_filled_without_cleaning_twice(spark):
    """A union of rows and filled rows would read, and clean, what is before it once for each."""
    plan = cleaning.impute_gaps(series(spark, [1500.0] * 5))._jdf.queryExecution().analyzed().toString()
    assert "Union" not in plan


def test_absurd_days_are_marked_without_a_median_for_each_row(spark):
    rng = random.Random(5)
    rows = [(1, m, dt.date(2024, 1, 1) + dt.timedelta(days=i), rng.choice([None, 50.0, 60.0, 70.0, 900.0, 1250.0, 1300.0, 1400.0, 26000.0])) for m in (1, 2) for i in range(230)]
    daily = spark.createDataFrame(rows, "commodity_id int, mandi_id int, obs_date date, modal_price double")
    marked = cleaning.mark_absurd(daily)
    plan = marked._jdf.queryExecution().analyzed().toString().lower()
    assert not re.search(r"rowframe, -\d+, -1", plan)  # no row meets a frame of its own
    key = ["mandi_id", "obs_date", "absurd"]
    got, want = (sorted(map(tuple, df.select(*key).collect())) for df in (marked, cleaning.tag_absurd(daily)))
    assert got == want
    assert 0 < sum(r[2] for r in want) < len(want)
