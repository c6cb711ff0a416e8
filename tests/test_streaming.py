"""Streams over files that are there now."""

import datetime as dt

import pytest

from harvestry.operators.bot import advance
from harvestry.sources import sinks
from harvestry.streaming import incremental


def test_ingest_merges_each_batch_once(spark, tmp_path):
    landing, table, check = (str(tmp_path / x) for x in ("landing", "table", "check"))
    schema = "k string, x double, is_imputed boolean"
    spark.createDataFrame([("a", 1.0, False), ("b", 1.0, True)], schema).coalesce(1).write.parquet(landing)
    for _ in range(2):
        incremental.ingest(incremental.read_landing(spark, landing, spark.read.parquet(landing).schema), table, check, ["k"], weak="is_imputed").awaitTermination()
    spark.createDataFrame([("a", 2.0, True), ("b", 2.0, False)], schema).coalesce(1).write.mode("append").parquet(landing)
    incremental.ingest(incremental.read_landing(spark, landing, spark.read.parquet(landing).schema), table, check, ["k"], weak="is_imputed").awaitTermination()
    assert {(r["k"], r["x"]) for r in spark.read.parquet(table).collect()} == {("a", 1.0), ("b", 2.0)}


def test_windowed_counts(spark, tmp_path):
    at = str(tmp_path / "events")
    spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, m), "buy", 1.0) for m in (0, 1, 2, 59)], "ts timestamp, event_type string, value double").coalesce(1).write.parquet(at)
    stream = incremental.windowed(incremental.read_landing(spark, at, spark.read.parquet(at).schema), length="10 minutes", slide="10 minutes")
    stream.writeStream.outputMode("append").format("memory").queryName("counts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination(120)
    assert [r["n"] for r in spark.sql("SELECT n FROM counts ORDER BY window.start").collect()][:1] == [3]


def steps(spark, tmp_path, messages, name):
    at = str(tmp_path / name)
    for k, part in enumerate(messages):
        spark.createDataFrame(part, "phone string, turn long, text string, ts timestamp").coalesce(1).write.mode("append").parquet(at)
        stream = incremental.conversations(incremental.read_landing(spark, at, spark.read.parquet(at).schema))
        out = stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / f"{name}-out")).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"{name}-c")).start()
        assert out.awaitTermination(120), k
    return {(r["phone"], r["turn"]): r["step"] for r in spark.read.parquet(str(tmp_path / f"{name}-out")).collect()}


def want(texts):
    cursor, out = 0, []
    for t in texts:
        cursor, step = advance(cursor, t)
        out.append(step)
    return out


def test_conversations(spark, tmp_path):
    texts = ["hi", "onion 80 quintal", "A", "shed"]
    at = [dt.datetime(2024, 1, 1, 10, m) for m in range(4)]
    rows = [("p", i, t, at[i]) for i, t in enumerate(texts)]
    got = steps(spark, tmp_path, [[*rows[2:], *rows[:2]]], "one")  # in any order
    assert [got["p", i] for i in range(4)] == want(texts)
    got = steps(spark, tmp_path, [rows[:2], rows[2:]], "two")  # the state goes on with the next run
    assert [got["p", i] for i in range(4)] == want(texts)


def test_an_idle_conversation_begins_anew(spark, tmp_path):
    rows = [("p", 0, "hi", dt.datetime(2024, 1, 1)), ("p", 1, "onion 80 quintal", dt.datetime(2024, 1, 1, 1)), ("p", 2, "hi", dt.datetime(2024, 1, 2, 1)), ("p", 3, "onion", dt.datetime(2024, 1, 2, 2))]
    got = steps(spark, tmp_path, [rows], "idle")
    assert [got["p", i] for i in range(4)] == want(["hi", "onion 80 quintal"]) + want(["hi", "onion"])


def test_a_table_survives_a_replacement_that_breaks_off(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    move = sinks._rename

    def broken(spark, old, new):
        if ".next-" in old:
            raise OSError("lost")
        move(spark, old, new)

    monkeypatch.setattr(sinks, "_rename", broken)
    with pytest.raises(OSError, match="lost"):
        sinks.replace_table(spark.range(5), path)
    monkeypatch.setattr(sinks, "_rename", move)
    sinks.recover(spark, path)
    assert spark.read.parquet(path).count() == 3
    sinks.replace_table(spark.read.parquet(path).union(spark.range(2)), path)
    assert spark.read.parquet(path).count() == 5
    assert sorted(p.name for p in tmp_path.iterdir() if ".old-" in p.name) == []
