"""Conversations in a stream: the steps don't depend on how messages fall into batches."""

import datetime as dt

import pytest

from harvestry.operators.bot import advance
from harvestry.streaming import incremental
from harvestry.streaming.ordered import ordered_conversations

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
START = dt.datetime(2024, 1, 1, 10)


@pytest.fixture
def rocks(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(PROVIDER)


def steps(spark, folder, batches):
    at = str(folder / "in")
    for part in batches:
        spark.createDataFrame(part, "phone string, turn long, text string, ts timestamp").coalesce(1).write.mode("append").parquet(at)
        stream = ordered_conversations(incremental.read_landing(spark, at, spark.read.parquet(at).schema))
        out = stream.writeStream.outputMode("append").format("parquet").option("path", str(folder / "out")).trigger(availableNow=True).option("checkpointLocation", str(folder / "c")).start()
        assert out.awaitTermination(120)
    return sorted((r["phone"], r["turn"], r["step"]) for r in spark.read.parquet(str(folder / "out")).collect())


def want(phone, texts, first=0):
    cursor, out = 0, []
    for k, text in enumerate(texts):
        cursor, step = advance(cursor, text)
        out.append((phone, first + k, step))
    return out


def test_messages_out_of_order_across_batches(rocks, tmp_path):
    texts = ["hi", "onion 80 quintal", "A", None]
    p = [("p", i, t, START + dt.timedelta(minutes=i)) for i, t in enumerate(texts)]
    q = [("q", 0, "hi", START), ("q", 1, "pool", START)]
    anew = [("p", 4, "hi", START + dt.timedelta(days=2)), ("p", 5, "onion", START + dt.timedelta(days=2, minutes=1))]
    end = [("z", 0, "hi", START + dt.timedelta(days=9))]
    expected = want("p", texts) + want("p", ["hi", "onion"], 4) + want("q", ["hi", "pool"])
    got = steps(rocks, tmp_path, [[p[2], p[0], q[1]], [p[3], p[1], q[0]], anew, end])
    # The last message waits for the watermark.
    assert got == sorted(expected)
