"""Incremental ingest and conversations as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from harvestry.operators.bot import advance
from harvestry.sources.sinks import exists, recover, replace_table, upsert


def ingest(source: DataFrame, path: str, checkpoint: str, keys: list[str], weak: str | None = None, order: str | None = None, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Merges each batch of a stream into a table, once for all that is there now.

    A batch that is run again gives the same table, since the merge is by key.
    """
    spark, schema = source.sparkSession, source.schema

    def merge(batch: DataFrame, _: int) -> None:
        recover(spark, path)
        there = exists(spark, path)
        rows = prepare(batch)
        existing = spark.read.schema(rows.schema).parquet(path) if there else spark.createDataFrame([], rows.schema if rows.schema else schema)
        replace_table(upsert(existing, rows, keys, weak, order), path)

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_landing(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", **options: str) -> DataFrame:
    return spark.readStream.format(kind).schema(schema).options(**options).load(path)


def windowed(events: DataFrame, time: str = "ts", late: str = "10 minutes", length: str = "5 minutes", slide: str = "1 minute", by: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums in sliding windows; rows later than `late` are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, length, slide), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def conversations(messages: DataFrame, timeout: str = "1 day", late: str = "1 hour") -> DataFrame:
    """phone, turn, step of each message of a stream (phone, turn, text, ts); a conversation idle for the timeout begins anew.

    Idleness is measured by the messages' own times, so that the same messages give the same steps whenever they are run. The watermark
    follows the latest message by `late`; a message later than that is left out, and a conversation's state goes when it has passed the timeout.
    """
    idle = int(pd.Timedelta(timeout).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        cursor, last = state.get if state.exists else (0, None)
        # All of a batch's messages of one phone, as they may come in several pieces.
        rows, out = pd.concat(list(batches)).sort_values("turn", kind="stable"), []
        for turn, text, at in zip(rows["turn"], rows["text"], rows["at"], strict=True):
            if last is not None and at - last >= idle:
                cursor = 0
            cursor, reply = advance(cursor, text)
            last = at if last is None else max(last, at)
            out.append((key[0], turn, reply))
        state.update((cursor, int(last)))
        state.setTimeoutTimestamp(max(int(last) + idle, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["phone", "turn", "step"])

    timed = messages.withWatermark("ts", late).select("phone", "turn", "text", "ts", F.unix_millis("ts").alias("at"))
    return timed.groupBy("phone").applyInPandasWithState(run, "phone string, turn long, step string", "cursor int, last long", "append", GroupStateTimeout.EventTimeTimeout)
