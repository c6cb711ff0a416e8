"""Conversations whose messages may come out of order, as a stream with state and timers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from harvestry.operators.bot import advance


class Conversation(StatefulProcessor):
    """Messages wait until the watermark has passed them, so none before them can still come, and are answered in the order of time and turn."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "cursor int, last long, timer long")
        self.waiting = handle.getListState("waiting", "at long, turn long, text string")

    def _wake(self, at: int, cursor: int, last: int | None, timer: int | None) -> None:
        """One timer for each conversation: the first message that waits, or else when the conversation has been idle long enough."""
        if timer is not None and timer != at:
            self.handle.deleteTimer(timer)
        if timer != at:
            self.handle.registerTimer(at)
        self.place.update((cursor, last, at))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [m for batch in rows for m in zip(batch["at"].tolist(), batch["turn"].tolist(), batch["text"].tolist(), strict=True)]
        first = min(m[0] for m in new)
        waits = self.waiting.exists()
        self.waiting.appendList(new)
        cursor, last, timer = self.place.get() if self.place.exists() else (0, None, None)
        self._wake(min(first, timer) if waits else first, cursor, last, timer)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        cursor, last, _ = self.place.get()
        messages = sorted(self.waiting.get(), key=lambda m: (m[0], m[1])) if self.waiting.exists() else []
        due, left = [m for m in messages if m[0] <= now], [m for m in messages if m[0] > now]
        out = []
        for at, turn, text in due:
            if last is not None and at - last >= self.idle:
                cursor = 0
            cursor, reply = advance(cursor, text)
            last = at
            out.append((key[0], turn, reply))
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        if left or (last is not None and last + self.idle > now):
            self._wake(left[0][0] if left else last + self.idle, cursor, last, None)
        else:
            self.place.clear()
        if out:
            yield pd.DataFrame(out, columns=["phone", "turn", "step"])

    def close(self) -> None:
        pass


def ordered_conversations(messages: DataFrame, timeout: str = "1 day", late: str = "1 hour") -> DataFrame:
    """phone, turn, step of each message of a stream (phone, turn, text, ts), the same however the messages fall into batches.

    A message later than `late` behind the latest is left out; any other is answered once the watermark has passed it, ordered by time and
    turn. A conversation idle for the timeout begins anew and its state goes. Timers stand for a time to live, which Spark keeps for
    processing time only. A conversation holds no more than its messages within `late`. The session needs a state store for
    several states: spark.sql.streaming.stateStore.providerClass of RocksDB.
    """
    idle = int(pd.Timedelta(timeout).total_seconds() * 1000)
    timed = messages.withWatermark("ts", late).select("phone", "turn", "text", "ts", F.unix_millis("ts").alias("at"))
    return timed.groupBy("phone").transformWithStateInPandas(statefulProcessor=Conversation(idle), outputStructType="phone string, turn long, step string", outputMode="Append", timeMode="EventTime")
