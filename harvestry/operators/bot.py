"""The advice conversation: which step each message leads to."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The steps in order, and what a message must hold for a step; a step without a pattern takes anything.
STEPS = ("greeting", "crop", "grade", "storage", "advice", "sale", "recorded")
PATTERNS = {
    "crop": r"(?i)onion|tomato|potato|pomegranate|grape|banana|okra|chilli|कांदा|टोमॅटो|डाळिंब|[0-9]",
    "grade": r"(?i)grade|दर्जा|^\s*[abc]\s*$",
    "storage": r"(?i)shed|ambient|cold|open|शेड|साठवण",
    "advice": r"(?i)sold|विकल|price|भाव|remind",
    "sale": r"^\s*₹?\s*[0-9]{3,6}\s*$",
    "recorded": r"(?i)another|पुन्हा|new lot",
}
POOL = r"(?i)^\s*pool\s*$"


def fits(text: Column) -> Column:
    """array<boolean>: which steps a message fits, and at the end whether it asks for a shared truck."""
    return F.array(*(text.rlike(PATTERNS[s]) if s in PATTERNS else F.lit(True) for s in STEPS), text.rlike(POOL))


def advance(cursor: int, text: str | None) -> tuple[int, str]:
    """The next cursor and the step replied to: the expected step, else the first later one that fits, else `fallback`; `pool` at any time."""
    found = [bool(re.search(PATTERNS[s], text or "")) if s in PATTERNS else True for s in STEPS]
    if re.search(POOL, text or ""):
        return cursor, "pool"
    for k in range(cursor, len(STEPS)):
        if found[k] and (k == cursor or STEPS[k] in PATTERNS):
            return min(k + 1, len(STEPS) - 1), STEPS[k]
    return cursor, "fallback"


def conversation_steps(messages: DataFrame, id_col: str = "conv_id", order: str = "turn", text_col: str = "text") -> DataFrame:
    """conv_id, turn, step of each message, by a fold over the ordered messages of each conversation."""
    rows = messages.select(F.col(id_col).alias("conv_id"), F.col(order).alias("turn"), fits(F.coalesce(text_col, F.lit(""))).alias("fits"))
    ordered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "fits"))).alias("turns"))
    state = "struct<cursor:int,out:array<struct<turn:bigint,step:string>>>"
    start = F.struct(F.lit(0).alias("cursor"), F.array().cast("array<struct<turn:bigint,step:string>>").alias("out")).cast(state)
    places = F.array(*map(F.lit, range(len(STEPS))))
    named = F.array(*map(F.lit, STEPS))

    def step(s: Column, m: Column) -> Column:
        free = F.filter(places, lambda k: (k >= s["cursor"]) & F.element_at(m["fits"], k + 1))
        k = F.try_element_at(free, F.lit(1))
        pool = F.element_at(m["fits"], -1)
        reply = F.when(pool, "pool").when(k.isNull(), "fallback").otherwise(F.try_element_at(named, k + 1))
        cursor = F.when(pool | k.isNull(), s["cursor"]).otherwise(F.least(k + 1, F.lit(len(STEPS) - 1)))
        return F.struct(cursor.cast("int").alias("cursor"), F.array_append(s["out"], F.struct(m["turn"].cast("long").alias("turn"), reply.alias("step"))).alias("out")).cast(state)

    done = ordered.select("conv_id", F.explode(F.aggregate("turns", start, step)["out"]).alias("o"))
    return done.select("conv_id", "o.turn", "o.step")
