"""Settings, stored matrices, distances, seeds and the sums of result pages on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from harvestry import config
from harvestry.errors import ConfigError, FeatureSetMismatch, IngestionError, InsufficientData, LeakageError
from harvestry.operators import dataset, distances, reports
from harvestry.sources import seeds


def test_settings_come_from_files_then_variables(tmp_path):
    (tmp_path / "costs.yaml").write_text("per_km: 40\ninterest: 0.2\n")
    (tmp_path / "decision.yaml").write_text("hold_days: [1, 2]\n")
    got = config.load(str(tmp_path), {"HARVESTRY_COSTS__PER_KM": "55", "OTHER": "1"})
    assert (got.costs.per_km, got.costs.interest, got.decision.hold_days) == (55, 0.2, (1, 2))
    assert got.cleaning == config.SETTINGS.cleaning and config.load(None, {}) == config.SETTINGS
    assert isinstance(config.load(None, {"HARVESTRY_AUDIT__THIN": "[1, 0.5]"}).audit.thin, tuple)


@pytest.mark.parametrize("name, text", [("costs", "per_kmm: 1"), ("nothing", "a: 1"), ("costs", "per_km: far"), ("costs", "per_km: true"), ("costs", "truck_qtl: [1]"), ("costs", "- 1"), ("costs", "a: [")])
def test_wrong_settings_are_refused(tmp_path, name, text):
    (tmp_path / f"{name}.yaml").write_text(text)
    with pytest.raises(ConfigError):
        config.load(str(tmp_path), {})


def matrix(spark, first, last):
    return spark.sql(f"SELECT explode(sequence(DATE '{first}', DATE '{last}')) AS as_of").withColumn("horizon", F.explode(F.array(*map(F.lit, config.HORIZONS))))


def test_a_stored_matrix_is_used_while_it_covers(spark, tmp_path):
    path, built = str(tmp_path / "m"), []

    def build(first, last):
        def run():
            built.append((first, last))
            return matrix(spark, first, last)

        return run

    load = lambda *days, **k: dataset.load_or_build(spark, path, build(*days), *days, **k).count()
    assert load("2020-01-01", "2020-01-20") == 80 and load("2020-01-05", "2020-01-27") == 80 and len(built) == 1
    assert load("2020-01-01", "2020-01-28") == 112 and load("2020-01-02", "2020-01-28") == 112 and len(built) == 2
    assert load("2020-01-02", "2020-01-20", refresh=True) == 76 and len(built) == 3
    with pytest.raises(InsufficientData):
        dataset.load_or_build(spark, path, lambda: matrix(spark, "2020-01-01", "2020-01-01").limit(0), "2021-01-01", "2021-01-02")
    assert spark.read.parquet(path).count() == 76  # what was stored stays


def test_leakage_is_raised(spark):
    rows = spark.sql("SELECT DATE '2020-01-02' AS as_of, explode(array(DATE '2020-01-01', DATE '2020-01-02', NULL)) AS obs_date")
    assert dataset.checked(rows).count() == 3
    with pytest.raises(LeakageError):
        dataset.checked(rows.withColumn("as_of", F.date_sub("as_of", 1)))


def test_ablation_keeps_the_keys(spark):
    rows = spark.sql("SELECT 1 AS mandi_id, 2 AS commodity_id, 3 AS mandi_liquidity, 4 AS lag_1")
    assert dataset.without_group(rows, "entity").columns == ["mandi_id", "commodity_id", "lag_1"]
    with pytest.raises(FeatureSetMismatch):
        dataset.without_group(rows, "stars")


def test_distances_come_from_the_cache_by_rounded_coordinates(spark):
    columns = "from_lat double, from_lon double, to_lat double, to_lon double"
    rows = spark.createDataFrame([(19.00001, 73.0, 20.0, 74.0), (19.0002, 73.0, 20.0, 74.0), (None, 73.0, 20.0, 74.0)], columns)
    cache = spark.createDataFrame([(19.0, 73.0, 20.0, 74.0, 1.0, 2.0, 1), (19.00002, 73.0, 20.0, 74.0, 150.0, 90.0, 2)], f"{columns}, road_km double, duration_min double, cached_at int")
    got = sorted(((r["from_lat"], r["road_km"], r["duration_min"], r["source"]) for r in distances.road_distances(rows, cache).collect()), key=repr)
    assert got[0] == (19.00001, 150.0, 90.0, "cache") and got[1][0::3] == (19.0002, "haversine_fallback") and got[1][1] == pytest.approx(198.87, abs=0.5)
    assert got[2] == (None, None, None, "haversine_fallback")
    stamped = cache.withColumn("cached_at", F.timestamp_seconds("cached_at"))
    fresh = distances.refreshed(stamped, rows.limit(1).withColumns({"road_km": F.lit(7.0), "duration_min": F.lit(None).cast("double")}))
    assert [(r["road_km"], r["cached_at"].year > 2000) for r in fresh.collect()] == [(7.0, True)]


def test_seeds_and_lookups(spark):
    known = spark.createDataFrame([("a", 4), ("b", 9)], "name string, id int")
    assert [tuple(r) for r in seeds.with_ids(known, ["c", "a", "c", "d"], "name", "id").orderBy("id").collect()] == [("a", 4, False), ("c", 10, True), ("d", 11, True)]
    assert [r["id"] for r in seeds.with_ids(known.limit(0), ["x"], "name", "id").collect()] == [1]
    assert seeds.lookup_id(known, "name", "b", "id") == 9
    with pytest.raises(ConfigError):
        seeds.lookup_id(known, "name", "z", "id")
    got = spark.sql("SELECT array('x', 'y', NULL, 'x', '') AS n").select(*seeds.aliases(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(0, "x"), (1, "y")]


def test_the_weather_window_ends_with_the_archive(spark):
    obs = spark.sql("SELECT DATE '2020-03-01' AS obs_date")
    today = dt.date(2020, 3, 20)
    assert reports.weather_window(obs, today) == (dt.date(2020, 3, 1), dt.date(2020, 3, 15))
    assert reports.weather_window(obs.limit(0), today, lookback_days=10) == (dt.date(2020, 3, 10), dt.date(2020, 3, 15))
    with pytest.raises(IngestionError):
        reports.weather_window(obs, today, start=dt.date(2020, 3, 18))


def test_alerts_need_a_price_before(spark):
    rows = [(1, 1, "2020-01-10", 500.0), (1, 1, "2020-01-06", 380.0), (1, 2, "2020-01-10", 500.0), (1, 2, "2020-01-01", 1.0), (1, 3, "2020-01-10", 300.0), (1, 3, "2020-01-07", 420.0), (1, 4, "2020-01-10", None)]
    obs = spark.createDataFrame(rows, "commodity_id int, mandi_id int, d string, modal_price double").withColumn("obs_date", F.to_date("d")).drop("d")
    got = {r["mandi_id"]: (r["change"], r["kind"]) for r in reports.price_alerts(obs, 100.0).collect()}
    assert got == {1: (120.0, "rise"), 3: (-120.0, "fall")}
