"""Mixing sources to target weights.

Each source's words are one sequence, cut in blocks of fixed length. Output shards
have a fixed number of slots; a shard draws from a multinomial how many of its slots
each source gets. A source's slots are numbered through all shards and mapped to its
blocks by pseudorandom permutations, one for each pass over the source, so no block
comes again before all have come. Slots then meet the blocks' contents by index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harvestry.llm import shared
from harvestry.llm.text import mix as scramble

WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 6


def permute(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The places of x in pseudorandom permutations of range(n), by key: a Feistel network over the next even number of bits, walked until it falls below n."""
    x, n, key = np.array(x, np.uint64), np.array(n, np.uint64), np.array(key, np.uint64)
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2).astype(np.float64) + 1) / 2)).astype(np.uint64)
    mask, todo = (np.uint64(1) << half) - np.uint64(1), np.arange(len(x))
    with np.errstate(over="ignore"):
        keys = [scramble(key + np.uint64(0x9E3779B97F4A7C15) * np.uint64(r + 1)) for r in range(ROUNDS)]
        while len(todo):
            left, right = x[todo] >> half[todo], x[todo] & mask[todo]
            for k in keys:
                left, right = right, left ^ (scramble(right ^ k[todo]) & mask[todo])
            x[todo] = (left << half[todo]) | right
            todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


def targets(sizes: list[int], weights: list[float], share: float, times: float) -> list[float]:
    """The words that each source is to give: shares of all words by weight, stopped at `times` its size; what is over is shared again by weight until no source is above."""
    total, out, free = share * sum(sizes), [0.0] * len(sizes), list(range(len(sizes)))
    while free:
        unit = total / sum(weights[i] for i in free)
        over = [i for i in free if unit * weights[i] > times * sizes[i]]
        if not over:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = float(times * sizes[i])
            total -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


@dataclass
class Quotas:
    """Each source's number, words, words to take, blocks with all their words, blocks, and slots."""

    length: int
    size: np.ndarray
    take: np.ndarray

    def __post_init__(self) -> None:
        self.full = self.size // self.length
        self.blocks = -(-self.size // self.length)
        passes = self.take // np.maximum(self.size, 1)
        self.slots = passes * self.blocks + -(-(self.take - passes * self.size) // self.length)

    def blocks_of(self, source: np.ndarray, at: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """The block of a source's slots, and how many of its words they take, first ones first.

        A source's last block, with what is left of its words, ends each pass; the last slot takes what its source still lacks.
        """
        passes, place = np.divmod(at, self.blocks[source])
        with np.errstate(over="ignore"):
            key = scramble(source.astype(np.uint64) * np.uint64(0x100000001B3) + scramble(passes.astype(np.uint64) + scramble(np.full(len(at), seed, np.uint64))))
        full = self.full[source]
        block, inner = full.copy(), place < full
        block[inner] = permute(place[inner], full[inner], key[inner])
        words = np.minimum(self.length, self.size[source] - block * self.length)
        lacking = self.take[source] - passes * self.size[source] - place * self.length
        return block, np.minimum(words, lacking)


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, with_text: bool) -> DataFrame:
    """row, doc_id, source, size, tie (and text), stored; row numbers the rows, also equal ones."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    more = [text.alias("text")] if with_text else []
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("tie"), *more)
    return shared.materialise(rows.withColumn("row", F.monotonically_increasing_id()), "sized")


def _placed(sized: DataFrame, sources: DataFrame, with_text: bool) -> DataFrame:
    """sized with source_no and start: the words of its source before it, in the order of identifiers; sums are made within ranges of rows and carried on."""
    more = ["text"] if with_text else []
    numbered = sized.join(sources, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    order = [F.col("source_no"), F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("row")]
    ranged = numbered.repartitionByRange(*order).sortWithinPartitions(*order).select("row", "doc_id", "source", "source_no", "size", *more)
    schema = "row long, doc_id long, source string, source_no long, size long, " + "text string, " * with_text + "part long, within long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, source, total = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            of, sizes = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4))
            first = np.flatnonzero(np.concatenate([[of[0] != source], of[1:] != of[:-1]]))
            sums = np.cumsum(sizes) - sizes
            base = np.full(len(of), total, np.int64)
            cuts = [*first.tolist(), len(of)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                base[a:b] = -sums[a]
            within = sums + base
            source, total = of[-1], int(within[-1] + sizes[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(of), part), pa.int64()), pa.array(within, pa.int64())], [*batch.schema.names, "part", "within"])

    local = shared.materialise(ranged.mapInArrow(run, schema), "placed")
    sums = local.groupBy("source_no", "part").agg(F.sum("size").alias("k"))  # a row for each range and each source in it
    before = sums.select(F.col("source_no").alias("s"), F.col("part").alias("p"), (F.sum("k").over(Window.partitionBy("source_no").orderBy("part")) - F.col("k")).alias("before"))
    return local.join(before, (F.col("source_no") == F.col("s")) & (F.col("part") == F.col("p"))).withColumn("start", F.col("before") + F.col("within")).drop("s", "p", "part", "before", "within")


def draw_counts(spark: SparkSession, quotas: Quotas, per_shard: int, seed: int) -> DataFrame:
    """shard, source_no, k: how many of a shard's slots each source gets, drawn by the shards' own generators."""
    n = int(quotas.slots.sum())
    p, shards = quotas.slots / max(n, 1), -(-n // per_shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                counts = np.random.default_rng([seed, shard]).multinomial(min(per_shard, n - shard * per_shard), p)
                held = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), shard), pa.int64()), pa.array(held, pa.int64()), pa.array(counts[held], pa.int64())], ["shard", "source_no", "k"])

    return spark.range(shards).mapInArrow(run, "shard long, source_no long, k long")


def fill_slots(spark: SparkSession, quotas: Quotas, per_shard: int, seed: int) -> DataFrame:
    """shard, slot, source_no, block, words of every slot of the mix.

    All draws of a source together differ from its quota by chance. A permutation tells which of its slots it keeps; those
    beyond its quota are numbered through all sources and dealt, in that order, to the sources that drew too few. So each
    source gets just its quota, and the rest of a shard stays as drawn.
    """
    counts = shared.materialise(draw_counts(spark, quotas, per_shard, seed), "draws")
    drawn = np.zeros(len(quotas.slots), np.int64)
    for source, k in counts.groupBy("source_no").agg(F.sum("k")).collect():  # one row for each source
        drawn[source] = k
    over, under = np.maximum(drawn - quotas.slots, 0), np.maximum(quotas.slots - drawn, 0)
    over_before, under_upto = np.cumsum(over) - over, np.cumsum(under)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, j = (batch.column(k).to_numpy() for k in (2, 3))
            at = permute(j, drawn[source], scramble(source.astype(np.uint64) + scramble(np.full(len(j), seed + 1, np.uint64))))
            moved = np.flatnonzero(at >= quotas.slots[source])
            number = over_before[source[moved]] + at[moved] - quotas.slots[source[moved]]
            to = np.searchsorted(under_upto, number, "right")
            at[moved] = drawn[to] + number - (under_upto[to] - under[to])
            of = source.copy()
            of[moved] = to
            block, words = quotas.blocks_of(of, at, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(of), pa.array(block), pa.array(words)], ["shard", "slot", "source_no", "block", "words"])

    # A source has one row here for each shard, of some thousand slots.
    first = F.sum("k").over(Window.partitionBy("source_no").orderBy("shard")) - F.col("k")
    in_shard = F.sum("k").over(Window.partitionBy("shard").orderBy("source_no")) - F.col("k")
    spans = counts.withColumn("first", first).withColumn("in_shard", in_shard)
    slots = spans.select("shard", "source_no", "first", "in_shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("i"))
    return slots.select("shard", (F.col("in_shard") + F.col("i")).alias("slot"), "source_no", (F.col("first") + F.col("i")).alias("j")).mapInArrow(run, "shard long, slot long, source_no long, block long, words long")


@dataclass
class Mix:
    """sources (of, source_no, source_size, target), placed documents, slots, and the length of blocks."""

    sources: DataFrame
    placed: DataFrame
    slots: DataFrame
    length: int

    def pieces(self) -> DataFrame:
        """The documents' parts by block: placed with block, offset (in the block), skipped (words of the document before) and piece (words)."""
        n = F.lit(self.length).cast("long")
        spread = self.placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / n), F.floor((F.col("start") + F.col("size") - 1) / n))))
        low = F.greatest("start", F.col("block") * n)
        return spread.select("*", (low - F.col("block") * n).alias("offset"), (low - F.col("start")).alias("skipped"), (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * n) - low).alias("piece"))

    def met(self) -> DataFrame:
        """The slots joined by index with what their blocks hold; n is how many of a piece's words the slot takes."""
        took = F.least("piece", F.col("words") - F.col("offset"))
        return self.slots.join(self.pieces(), ["source_no", "block"]).withColumn("n", took).where("n > 0")


def plan(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, times: int = 3, length: int = 1024, per_shard: int = 8192, seed: int = 2024, most_sources: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_text: bool = False) -> Mix:
    """The mix of a table of documents.

    Sources in the order of code points, a null one last, have the weights in turn and share `share` of all words; a source
    gives `times` its words at most. The driver holds one row for each source and refuses more than most_sources.
    Documents without words give none; null identifiers come first; repeated rows are documents of their own. An empty
    table, or one without words, gives a mix without slots. Everything follows from the rows and the seed.
    """
    spark = docs.sparkSession
    sized = _sized(docs, id_col, text_col, source_col, with_text)
    found = sized.groupBy("source").agg(F.sum("size").alias("size")).orderBy(F.col("source").asc_nulls_last()).limit(most_sources + 1).collect()
    if len(found) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    sizes = [x["size"] for x in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, times)
    size = np.array(sizes, np.int64)
    quotas = Quotas(length, size, np.minimum(np.floor(np.array(goal, np.float64) + 0.5).astype(np.int64), times * size))
    sources = spark.createDataFrame([(x["source"], i, x["size"], t) for i, (x, t) in enumerate(zip(found, goal, strict=True))], "of string, source_no long, source_size long, target double")
    placed = _placed(sized, sources.select("of", "source_no"), with_text)
    return Mix(sources, placed, fill_slots(spark, quotas, per_shard, seed), length)


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document: the words that the mix takes of it, repeats counted."""
    mixed = plan(docs, **options)
    sums = mixed.met().groupBy(F.col("row").alias("of_row")).agg(F.sum("n").alias("taken"))
    rows = mixed.placed.join(sums, F.col("row") == F.col("of_row"), "left").join(mixed.sources.drop("of"), "source_no")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """shard, slot, source, words, doc_ids, text: each slot's words, joined by blanks, and the documents they come from."""
    mixed = plan(docs, with_text=True, **options)
    words = F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})")), (F.col("skipped") + 1).cast("int"), F.col("n").cast("int"))
    part = F.struct("offset", "doc_id", F.array_join(words, " ").alias("text"))
    slots = mixed.met().select("shard", "slot", "source", "words", part.alias("part")).groupBy("shard", "slot", "source", "words").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return slots.select("shard", "slot", "source", "words", F.col("parts.doc_id").alias("doc_ids"), F.array_join("parts.text", " ").alias("text"))
