"""Resampling documents towards a target distribution, through a stored count matrix.

Each text's features (runs of consecutive words) are counted by hash bucket. The
counts are stored as blocks of a sparse matrix in CSR form: a block has some
documents' rows, each a list of buckets with counts. Its column sums give the
distribution of the corpus; those of the target's matrix give the other; their
log ratio is a bucket's gain; the product of the matrix with the gains, over a
document's number of features, is its weight. Gumbel noise from a hash of the
identifier is added, and the highest sums are drawn without replacement.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harvestry.llm import shared
from harvestry.llm import text as T

MATRIX = "doc_ids array<long>, n_words array<long>, starts array<long>, buckets binary, counts binary"
LONG_WORD = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[0x30:0x3A] = _IN_WORD[0x41:0x5B] = _IN_WORD[0x61:0x7B] = _IN_WORD[0x80:] = True


@lru_cache(1)
def _crc_table() -> np.ndarray:
    """The reflected CRC-32 of each byte, from its polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


def span_crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The unsigned CRC-32 of spans of bytes: all spans byte by byte together, longer ones each by itself."""
    out = np.empty(len(starts), np.uint32)
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        out[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]])
    short = np.flatnonzero(lengths <= LONG_WORD)
    short = short[np.argsort(-lengths[short], kind="stable")]
    at, n, table = starts[short], -lengths[short], _crc_table()
    crc = np.full(len(short), 0xFFFFFFFF, np.uint32)
    for k in range(-int(n[0]) if len(n) else 0):
        m = int(np.searchsorted(n, -k))  # spans with a byte at k
        crc[:m] = table[(crc[:m] ^ data[at[:m] + k]) & 255] ^ (crc[:m] >> 8)
    out[short] = ~crc
    return out


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a chunk, A-Z lower-cased and each followed by a blank: bytes, starts, ends, and words before each text."""
    inside = _IN_WORD[data]
    step = np.diff(inside.astype(np.int8), prepend=0, append=0)
    # a text's end also ends a word
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = np.unique(cuts[inside[cuts - 1] & inside[cuts]]) if len(cuts) else cuts
    first = np.sort(np.concatenate([np.flatnonzero(step == 1), cuts]))
    last = np.sort(np.concatenate([np.flatnonzero(step == -1), cuts]))
    size = last - first
    ends = np.cumsum(size + 1) - 1
    joined = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, np.uint8)
    joined[np.repeat(ends - size - np.cumsum(size) + size, size) + np.arange(size.sum())] = T.gather(_LOWER[data], first, size)
    return joined, ends - size, ends, np.searchsorted(first, offsets)


def count_matrix(docs: DataFrame, buckets: int = 10_000, longest: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts of each text's features by bucket, as CSR blocks of about a megabyte of text, one text at least.

    A block has doc_ids, n_words, starts (of each row's entries, and the end), and the entries: buckets and counts, as
    little-endian unsigned 32-bit numbers. Words are runs of letters and digits (all of what is not ASCII counts as
    letters) with A-Z lower-cased; features are runs of 1 to `longest` words joined by a blank; a feature's bucket is its
    CRC-32 modulo `buckets`. A null or empty text has no entries; a null identifier stays null; repeated rows stay.
    A row has `buckets` entries at most, so a block is bounded, however long a text is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in T.chunks(batch.column(1)):
                joined, starts, ends, before = _spans(data, offsets)
                of = np.repeat(np.arange(b - a), np.diff(before))
                keys = []
                for n in range(1, longest + 1):
                    last = np.arange(n - 1, len(starts))
                    last = last[of[last - n + 1] == of[last]]
                    crcs = span_crcs(joined, starts[last - n + 1], ends[last] - starts[last - n + 1])
                    keys.append(of[last] * buckets + crcs.astype(np.int64) % buckets)
                found, counts = np.unique(np.concatenate(keys), return_counts=True)
                rows = np.searchsorted(found, np.arange(b - a + 1) * buckets)
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                entries = [pa.array([x.astype("<u4").tobytes()], pa.binary()) for x in (found % buckets, counts)]
                yield pa.RecordBatch.from_arrays([one(batch.column(0).slice(a, b - a)), one(pa.array(np.diff(before), pa.int64())), one(pa.array(rows, pa.int64())), *entries], ["doc_ids", "n_words", "starts", "buckets", "counts"])

    return shared.texts_of(docs, id_col, text_col).mapInArrow(run, MATRIX)


def _entries(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["buckets"], "<u4").astype(np.int64), np.frombuffer(row["counts"], "<u4").astype(np.int64)


def column_sums(matrix: DataFrame, buckets: int = 10_000) -> DataFrame:
    """bucket, k: how often the features of all rows fall in it; buckets without any are left out. A task hands on one number for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                columns, counts = _entries(row)
                np.add.at(sums, columns, counts)
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(sums[held], pa.int64())], ["bucket", "k"])

    return matrix.select("buckets", "counts").mapInArrow(run, "bucket long, k long").groupBy("bucket").agg(F.sum("k").alias("k"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """bucket, gain: a thousand times the log ratio of its smoothed shares in the target's and the corpus' column sums, floored."""
    spark = corpus.sparkSession
    totals = corpus.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("all_s")).crossJoin(target.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("all_t")))  # one row
    of = spark.range(buckets).withColumnRenamed("id", "bucket")
    of = of.join(corpus.withColumnRenamed("k", "s"), "bucket", "left").join(target.withColumnRenamed("k", "t"), "bucket", "left").crossJoin(totals)
    d = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    ratio = (d("t") + 1) * (d("all_s") + buckets) / ((d("s") + 1) * (d("all_t") + buckets))
    return of.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weights(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean gain of each row's features, 0 without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row in enumerate(batch.to_pylist()):
                columns, counts = _entries(row)
                starts = np.array(row["starts"])
                upto = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[starts])
                n = upto(counts)
                weight = np.where(n > 0, upto(gain[columns] * counts) // np.maximum(n, 1), 0)
                ids = batch.column(0).slice(k, 1).flatten()
                yield pa.RecordBatch.from_arrays([ids, pa.array(row["n_words"], pa.int64()), pa.array(n, pa.int64()), pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return matrix.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noisy(weighted: DataFrame, seed: str) -> DataFrame:
    """weighted with score: weight and a thousandfold Gumbel number, floored, from a hash of seed and identifier (a null one counts as an empty string)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return weighted.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))))


def draw(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """doc_id, n_features, weight, score, rank of all rows: 1, 2, 3... for the highest scores, null for those not drawn.

    Drawn are percent of the rows with least_words words at least, rounded down; ties go to the smaller identifier, null
    ones last, then to fewer features. Scores are counted first: a score is a gain's sum with noise, so there are some
    hundred thousand distinct ones at most, whatever the number of rows, and their running sum gives where each begins.
    Equal rows are counted too and laid out again, in pieces of a task's rows, so that no repeated row makes a large group.
    """
    eligible = F.col("n_words") >= least_words
    per_score = scored.where(eligible).groupBy("score").agg(F.count("*").alias("k"))
    n = percent * (per_score.agg(F.sum("k")).first()[0] or 0) // 100
    higher = per_score.withColumn("higher", F.sum("k").over(Window.orderBy(F.desc("score"))) - F.col("k")).where(F.col("higher") < n)
    higher = higher.select(F.col("score").alias("of_score"), "higher", F.lit(True).alias("near"))
    met = scored.join(higher, eligible & (F.col("score") == F.col("of_score")), "left")
    columns = ["doc_id", "n_features", "weight", "score"]
    pieces = met.where("near").withColumn("piece", F.spark_partition_id()).groupBy(*columns, "higher", "piece").agg(F.count("*").alias("k"))
    before = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "piece").rowsBetween(Window.unboundedPreceding, 0)
    placed = pieces.withColumn("upto", F.col("higher") + F.sum("k").over(before))
    laid = placed.select(*columns, F.explode(F.sequence(F.col("upto") - F.col("k") + 1, F.col("upto"))).alias("rank"))
    laid = laid.withColumn("rank", F.when(F.col("rank") <= n, F.col("rank")))
    return met.where("near is null").select(*columns, F.lit(None).cast("long").alias("rank")).unionByName(laid)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: str = "2024", buckets: int = 10_000, longest: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document: those that are drawn towards the target's texts have a rank.

    Both matrices are stored in the shared folder and read twice: for the sums and for the product. Only the gains go to
    the driver and back to the tasks: one number for each bucket. Without any target text all features of the corpus lose
    alike; an empty table of documents gives an empty result. Further columns of docs are not read.
    """
    matrix = shared.materialise(count_matrix(docs, buckets, longest, id_col, text_col), "csr")
    nameless = target.select(F.lit(None).cast("long").alias(id_col), text_col)
    wanted = shared.materialise(count_matrix(nameless, buckets, longest, id_col, text_col), "csr")
    rows = gains(column_sums(matrix, buckets), column_sums(wanted, buckets), buckets).collect()  # one for each bucket
    gain = np.zeros(buckets, np.int64)
    for bucket, g in rows:
        gain[bucket] = g
    return draw(shared.materialise(noisy(weights(matrix, gain), seed), "scored"), percent, least_words)
