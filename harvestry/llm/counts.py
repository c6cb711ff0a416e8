"""Token counts by a two-tier lookup on the map side.

A compact hash table of the most frequent pre-tokens' lengths in tokens is
broadcast (its size is a parameter); what it lacks is encoded through a bounded
cache in each worker. Pre-tokens are never shuffled. The table is fitted on a
bounded sample of rows (`sample_rows`); it decides speed only, never a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.llm import shared
from harvestry.llm import text as T
from harvestry.llm.pretokens import PretokenCache, SPECIAL, library_encoder

PROBES = 4


class LengthTable:
    """Open addressing over 64-bit hashes; an entry that finds no place within a few probes is left out."""

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray):
        self.mask = np.uint64((1 << max(4, int(2 * len(hashes)).bit_length())) - 1)
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.lengths = np.zeros(int(self.mask) + 1, np.uint8)
        for probe in range(PROBES):
            at = ((hashes + np.uint64(probe)) & self.mask).astype(np.int64)
            free = self.lengths[at] == 0
            _, first = np.unique(at[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.keys[at[chosen]], self.lengths[at[chosen]] = hashes[chosen], lengths[chosen]
            rest = np.ones(len(hashes), bool)
            rest[chosen] = False
            hashes, lengths = hashes[rest], lengths[rest]

    def get(self, hashes: np.ndarray) -> np.ndarray:
        """Lengths; 0 for a miss."""
        at = (hashes & self.mask).astype(np.int64)
        out = np.where(self.keys[at] == hashes, self.lengths[at], 0)
        for probe in range(1, PROBES):
            miss = np.flatnonzero(out == 0)
            at = ((hashes[miss] + np.uint64(probe)) & self.mask).astype(np.int64)
            out[miss] = np.where(self.keys[at] == hashes[miss], self.lengths[at], 0)
        return out


def _cache(path: str) -> PretokenCache:
    return shared.kept(("counts", path), lambda: PretokenCache(library_encoder(path), -1))


def frequent_lengths(docs: DataFrame, tokenizer: str, entries: int, sample_rows: int, text_col: str) -> LengthTable:
    """The table of the most frequent pre-tokens of a bounded sample of rows."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    n = texts.count()
    if n > sample_rows:
        texts = texts.sample(sample_rows / n, seed=7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, found = _cache(tokenizer), {}
        for batch in batches:
            for _, _, data, offsets in T.chunks(batch.column(0)):
                points, at = T.code_points(data, offsets)
                starts = T.pretoken_starts(points, at)
                ends = np.append(starts[1:], len(points))
                hashes, index, counts = np.unique(T.span_hashes(points, starts), return_index=True, return_counts=True)
                slots = cache.slots(hashes, lambda i: points[starts[index[i]] : ends[index[i]]].tobytes().decode("utf-32-le"))  # noqa: B023
                for h, size, c in zip(hashes.tolist(), cache.length[slots].tolist(), counts.tolist(), strict=True):
                    if size < 256:
                        found[h] = (found.get(h, (0, 0))[0] + c, size)
                if len(found) > 8 * entries:
                    found = dict(sorted(found.items(), key=lambda x: -x[1][0])[: 2 * entries])
        top = sorted(found.items(), key=lambda x: -x[1][0])[: 2 * entries]
        hashes = np.array([h for h, _ in top], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array([x[1] for _, x in top], pa.int32()), pa.array([x[0] for _, x in top], pa.int64())], ["hash", "length", "n"])

    rows = texts.mapInArrow(run, "hash long, length int, n long").groupBy("hash").agg(F.first("length").alias("length"), F.sum("n").alias("n"))
    top = rows.orderBy(F.desc("n"), "hash").limit(entries).select("hash", "length").toPandas()
    return LengthTable(top["hash"].to_numpy(np.int64).view(np.uint64), top["length"].to_numpy(np.uint8))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, entries: int = 1 << 16, sample_rows: int = 5_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text.

    A null or empty text has 0 bytes and tokens; a null doc_id stays null; repeated rows stay.
    A special token's string inside a text counts as one token. An empty table gives an empty result.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, tokenizer, entries, sample_rows, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, frequent = _cache(tokenizer), table.value

        def lengths(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
            points, at = T.code_points(data, offsets)
            starts = T.pretoken_starts(points, at)
            ends, spans = np.append(starts[1:], len(points)), T.span_hashes(points, starts)
            found = frequent.get(spans).astype(np.int64)
            miss = np.flatnonzero(found == 0)
            if len(miss):
                hashes, index, inverse = np.unique(spans[miss], return_index=True, return_inverse=True)
                first = miss[index]
                slots = cache.slots(hashes, lambda i: points[starts[first[i]] : ends[first[i]]].tobytes().decode("utf-32-le"))
                found[miss] = cache.length[slots][inverse]
            total = np.concatenate([[0], np.cumsum(found)])
            return np.diff(total[np.searchsorted(starts, at)])

        for batch in batches:
            for a, b, data, offsets in T.chunks(batch.column(1)):
                if SPECIAL.encode() in data.tobytes():
                    n = np.zeros(b - a, np.int64)
                    for i in range(b - a):
                        parts = data[offsets[i] : offsets[i + 1]].tobytes().split(SPECIAL.encode())
                        n[i] = len(parts) - 1 + sum(int(lengths(np.frombuffer(p, np.uint8), np.array([0, len(p)]))[0]) for p in parts if p)
                else:
                    n = lengths(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kept = shared.texts_of(docs, id_col, text_col)
    return kept.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
