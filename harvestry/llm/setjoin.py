"""Exact Jaccard joins of token sets, without listing all pairs of a group.

Sets are made from texts in the tasks, again in each pass, so that they need not be
stored. Equal sets (told apart by 64-bit hashes) form one class and take part once.

1. digests: each set's class, size and place, and counts of all tokens in a table of fixed size.
   The counts only order the tokens, the rare ones first; any order gives the same links.
2. postings: each set's keys. Two sets with J >= t share a token of their prefixes of
   n - ceil(t n) + 1 tokens, and two tokens of prefixes that are one longer (sets of two
   or more). Sets up to a boundary list pairs of tokens, larger ones tokens.
3. lists: within a key's postings each set meets one only (its leader), that in which the key
   has the first place: it has the fewest tokens of its own. Frequent keys are split by a salt,
   and their leaders meet in a second step.
4. Length and positional filters: two similar sets meet under their first common token (or pair),
   and share no token before it, so what follows it in either must be enough. Parities: a few
   words of bits, each the parity of the tokens that fall on it, bound how many tokens two sets
   don't share. The sets of pairs that pass are fetched by their places and compared: first each
   set with its most central leader, then with the other leaders unless that is settled.
5. Pairs of a list that are still open meet in blocks of bounded length and of like sizes, and
   are compared as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry.llm import shared
from harvestry.llm import text as T

SLOT_BITS, BLOCKS = 22, 16
HOT = 1 << 17  # postings of a key for each salt
LARGEST_LIGHT = 32
PLACE_BITS = 16  # of a posting's order; the bits above are the key
BLOCK = 4096  # sets of an open list that meet in one task
DEALT = 1 << 17  # postings that a task deals out at once, and about as many that a bucket has in the end
PAIRED = np.uint64(0xA0761D6478BD642F)


def document_shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One set for each text: its distinct five-word shingles."""
    n, sets = len(offsets) - 1, T.shingles(*T.words(data, offsets))
    return np.arange(n), np.zeros(n, np.int64), np.concatenate([np.zeros(0, np.uint64), *sets]), np.array([len(s) for s in sets], np.int64)


def line_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One set for each line: its distinct words. A text that isn't empty has a line more than line feeds."""
    text, part, starts = line_starts(data, offsets)
    hashes, before = T.words(data, offsets, np.append(starts, len(data)))
    return text, part, *distinct(hashes, np.diff(before))


def distinct(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct tokens of each span, and their number."""
    span = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    bits = np.uint64(max(1, len(sizes).bit_length()))
    packed = (span << (np.uint64(64) - bits)) | (tokens >> bits)
    order = np.argsort(packed)
    packed, found = packed[order], tokens[order]
    if np.any((packed[1:] == packed[:-1]) & (found[1:] != found[:-1])):  # told apart by the last bits only
        found = tokens[np.lexsort((tokens, span))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (span[1:] != span[:-1])
    return found[new], np.bincount(span[new].astype(np.int64), minlength=len(sizes))


def line_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, number and start of each line."""
    feeds = np.flatnonzero(data == 10)
    filled = np.flatnonzero(np.diff(offsets) > 0)
    text = np.concatenate([filled, np.searchsorted(offsets, feeds, "right") - 1])
    starts = np.concatenate([offsets[:-1][filled], feeds + 1])
    order = np.lexsort((starts, text))
    text, starts = text[order], starts[order]
    first = np.searchsorted(text, text)
    return text, np.arange(len(text)) - first, starts


def lines_at(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, number, start and end of each line."""
    text, part, starts = line_starts(data, offsets)
    return text, part, starts, np.minimum(np.append(starts[1:], len(data)), offsets[text + 1]) if len(text) else starts


def documents_at(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(offsets) - 1
    return np.arange(n), np.zeros(n, np.int64), offsets[:-1], offsets[1:]


def only_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, before = T.words(data, offsets)
    return distinct(hashes, np.diff(before))


def only_shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return document_shingles(data, offsets)[2:]


@dataclass(frozen=True)
class Split:
    """How texts give sets. sets: of a chunk's bytes and offsets each set's text and part in it, the sorted distinct tokens of all sets, and each
    one's number of them. spans: only where each set stands: text, part, start, end. tokens: of spans as texts the tokens and their numbers."""

    sets: Callable
    spans: Callable
    tokens: Callable


DOCUMENTS, LINES = Split(document_shingles, documents_at, only_shingles), Split(line_words, lines_at, only_words)


def places(doc: pa.Array, row: pa.Array, text: np.ndarray, part: np.ndarray) -> np.ndarray:
    """A hash of where each set stands: its row's doc_id and text, and its part."""
    rows = T.mix(doc.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64) + PAIRED) ^ row.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
    return T.mix(T.mix(rows)[text] + part.astype(np.uint64)).view(np.int64)


def class_ids(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each set (0 for an empty one)."""
    ids, filled = np.zeros(len(sizes), np.uint64), np.flatnonzero(sizes)
    if len(filled):
        at = (np.cumsum(sizes) - sizes)[filled]
        ids[filled] = T.mix(np.add.reduceat(T.mix(tokens ^ PAIRED), at) ^ (sizes[filled].astype(np.uint64) * PAIRED))
    return ids.view(np.int64)


def _bits(tokens: np.ndarray, sizes: np.ndarray, each: np.ndarray) -> np.ndarray:
    """Parities of each set's tokens in `each` bits (a power of two of 64 or more), as bytes, one set after the other."""
    start = np.cumsum(each) - each
    place = (T.mix(tokens + PAIRED) & (np.repeat(each, sizes) - 1).astype(np.uint64)).astype(np.int64)
    odd = np.zeros(int(each.sum()), np.uint8)
    np.add.at(odd, np.repeat(start, sizes) + place, np.uint8(1))
    return np.packbits(odd & 1, bitorder="little")


def parity(tokens: np.ndarray, sizes: np.ndarray, count: int) -> list[np.ndarray]:
    """For each set `count` words of 64 bits (a power of two), each bit the parity of the number of tokens that fall on it."""
    if not count:
        return []
    words = _bits(tokens, sizes, np.full(len(sizes), 64 * count)).view(np.int64).reshape(-1, count)
    return [np.ascontiguousarray(words[:, k]) for k in range(count)]


def long_parity(tokens: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Parities of each set in a power of two of bits, two for each token at least; those of half as many bits are the XOR of both halves."""
    each = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * sizes, 1))).astype(np.int64))
    packed, ends = _bits(tokens, sizes, each).tobytes(), (np.cumsum(each) // 8).tolist()
    return [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class Join:
    """Sets of the texts of a frame (doc_id, text, row_id), and the least similarity, least / 100."""

    def __init__(self, rows: DataFrame, split: Split, least: int, light: bool = False, parities: int = 0):
        """light: small sets list pairs; parities: words of parity bits (0: none)."""
        self.rows, self.split, self.least, self.spark, self.parities = rows, split, least, rows.sparkSession, parities
        self.digests = self._digests()
        self.counts = self._rarity()
        self.light = self._boundary() if light else 0
        self.hot = bool((self.counts.value >= HOT).any())

    def _digests(self) -> DataFrame:
        split, parities = self.split, self.parities
        bits = [f"p{k}" for k in range(parities)] + ["long_parity"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shared.forget()
            counts, press = np.zeros(1 << SLOT_BITS, np.uint32), zstandard.ZstdCompressor(level=1)
            names = ["doc_id", "row_id", "part", "parts", "set_id", "n", "place", *bits, "block", "counts"]
            for batch in batches:
                for a, b, data, offsets in T.chunks(batch.column(1)):
                    text, part, tokens, sizes = split.sets(data, offsets)
                    ids = class_ids(tokens, sizes)
                    np.add.at(counts, (tokens & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64), np.uint32(1))
                    docs, rows = batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a)
                    doc, row = docs.take(pa.array(text)), rows.take(pa.array(text))
                    parts = np.bincount(text, minlength=b - a)[text]
                    yield pa.RecordBatch.from_arrays([doc, row, pa.array(part), pa.array(parts), pa.array(ids), pa.array(sizes), pa.array(places(docs, rows, text, part)), *map(pa.array, parity(tokens, sizes, parities)), pa.array(long_parity(tokens, sizes) if parities else [None] * len(sizes), pa.binary()), pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())], names)
            for k, block in enumerate(counts.reshape(BLOCKS, -1)):
                if block.any():
                    none = [*[pa.nulls(1, pa.int64())] * (7 + parities), pa.nulls(1, pa.binary())]
                    yield pa.RecordBatch.from_arrays([*none, pa.array([k], pa.int32()), pa.array([press.compress(block.tobytes())], pa.binary())], names)

        return shared.materialise(self.rows.mapInArrow(run, f"doc_id long, row_id long, part long, parts long, set_id long, n long, place long, {''.join(f'{b} long, ' for b in bits[:-1])}long_parity binary, block int, counts binary"), "digests")

    def sets(self) -> DataFrame:
        """doc_id, row_id, part, parts (the number of sets of the row), set_id, n, place of every set; an empty one's set_id is 0."""
        return self.digests.where("block is null").select("doc_id", "row_id", "part", "parts", "set_id", "n", "place")

    def standing(self) -> DataFrame:
        """set_id, place: for each class one of the places where it stands."""
        return self.sets().where("n > 0").groupBy("set_id").agg(F.min("place").alias("place"))

    def _rarity(self) -> Broadcast:
        size = (1 << SLOT_BITS) // BLOCKS

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    part = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint32).astype(np.uint64)
                    sums[k] = sums.get(k, 0) + part
            for k, total in sums.items():
                packed = np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed], pa.binary())], ["block", "counts"])

        blocks = self.digests.where("block is not null").select("block", "counts").repartition(BLOCKS, "block")
        out = np.zeros((BLOCKS, size), np.uint32)
        for row in blocks.mapInArrow(merge, "block int, counts binary").collect():  # 16 MB in all, whatever the input
            out[row["block"]] = np.frombuffer(row["counts"], np.uint32)
        return self.spark.sparkContext.broadcast(out.ravel())

    def _boundary(self, sample_rows: int = 2000) -> int:
        """The size up to which sets list pairs, where the work is least.

        Sizes are counted over all sets; what scanning a set's lists takes is estimated on a
        bounded sample of rows. This decides speed only.
        """
        sizes = {r["n"]: r["k"] for r in self.sets().where(f"n between 2 and {LARGEST_LIGHT * 4 // 3 + 2}").groupBy("n").agg(F.countDistinct("set_id").alias("k")).collect()}
        if not sizes:
            return 0
        total = self.sets().count()
        rows = self.rows if total <= sample_rows else self.rows.sample(min(1.0, sample_rows / total), seed=5)
        split, least, counts = self.split, self.least, self.counts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, _, data, offsets in T.chunks(batch.column(1)):
                    _, _, tokens, sizes = split.sets(data, offsets)
                    sets = np.split(tokens, np.cumsum(sizes)[:-1]) if len(sizes) else []
                    found = [(len(s), float(np.sort(counts.value[(s & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)])[: prefix(len(s), least)].sum())) for s in sets if 2 <= len(s) <= LARGEST_LIGHT * 4 // 3 + 2]
                    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64())], ["n", "scan"])

        scan = {r["n"]: r["scan"] for r in rows.mapInArrow(run, "n long, scan double").groupBy("n").agg(F.avg("scan").alias("scan")).collect()}
        typical = sum(scan.values()) / len(scan) if scan else 0.0

        def work(boundary: int) -> float:
            out = 0.0
            for n, k in sizes.items():
                p = prefix(n, self.least)
                if n <= boundary:
                    q = min(p + 1, n)
                    out += k * (q * (q - 1) / 2 + (p if 100 * n >= self.least * (boundary + 1) else 0))
                else:
                    out += k * (p + scan.get(n, typical))
            return out

        return min(range(LARGEST_LIGHT + 1), key=work)

    def postings(self) -> DataFrame:
        """order (key, then the key's place in the set), set_id, n; if there are frequent keys, base (the key before it was split) and salts (how many parts it is split in)."""
        split, least, light, counts, hot = self.split, self.least, self.light, self.counts, self.hot
        low = np.uint64((1 << PLACE_BITS) - 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
            for batch in batches:
                for _, _, data, offsets in T.chunks(batch.column(1)):
                    _, _, tokens, sizes = split.sets(data, offsets)
                    ids = class_ids(tokens, sizes)
                    # Equal sets of a chunk are listed once, for the first of them.
                    _, first = np.unique(ids, return_index=True)
                    frequency = counts.value[(tokens & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)]
                    order = (frequency.astype(np.uint64) << np.uint64(32)) | (tokens >> np.uint64(32))
                    ends = np.cumsum(sizes)
                    keys, salts, at, pos = [], [], [], []
                    for i in first[sizes[first] > 0].tolist():
                        n = int(sizes[i])
                        b = int(ends[i])
                        p = prefix(n, least)
                        lead = np.argsort(order[b - n : b], kind="stable")[: p + 1] + (b - n)
                        if n > light or 100 * n >= least * (light + 1):
                            keys.append(tokens[lead[:p]])
                            salts.append(frequency[lead[:p]] // HOT + 1)
                            pos.append(np.arange(p))
                            at.append(np.full(p, i))
                        if 2 <= n <= light:
                            x, y = np.triu_indices(min(p + 1, n), 1)
                            keys.append(T.mix(tokens[lead[x]] * PAIRED + tokens[lead[y]]))
                            salts.append(np.minimum(frequency[lead[x]], frequency[lead[y]]) // HOT + 1)
                            pos.append(x)
                            at.append(np.full(len(x), i))
                    if not keys:
                        continue
                    keys, salts, at, pos = (np.concatenate(v) for v in (keys, salts, at, pos))
                    ids_at, pos = ids[at], np.minimum(pos.astype(np.uint64), low)
                    listed = keys
                    if hot:
                        salt = (ids_at.view(np.uint64) >> np.uint64(20)) % salts.astype(np.uint64)
                        listed = np.where(salts > 1, T.mix(keys + (salt + np.uint64(1)) * PAIRED), keys)
                    columns = {"order": ((listed & ~low) | pos).view(np.int64), "set_id": ids_at, "n": sizes[at].astype(np.int32)}
                    yield columns | ({"base": ((keys & ~low) | pos).view(np.int64), "salts": salts.astype(np.int32)} if hot else {})

        return self.dealt(run, lambda columns: columns["order"] >> PLACE_BITS)

    def dealt(self, postings: Callable, key: Callable) -> DataFrame:
        """bucket, rows, data: what postings yields from the texts (batches -> named columns), in buckets by their keys, sorted by bucket within a task.

        A row is a piece of a bucket: the bytes of its columns one after the other, so that Spark moves and sorts pieces and not single postings.
        Buckets are so many that each has a bounded number of postings, but for keys more frequent than HOT, which are split before.
        """
        n = F.col("n")
        expected = self.sets().agg(F.sum(n - F.floor((n * self.least + 99) / 100) + 1 + F.when(n <= self.light, LARGEST_LIGHT).otherwise(0))).first()[0] or 0
        tasks = shared.tasks(self.spark)
        buckets = tasks * max(1, -(-expected // (DEALT * tasks)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shared.forget()
            held, rows = [], 0
            for columns in postings(batches):
                held.append(columns)
                rows += len(columns["set_id"])
                if rows >= DEALT:
                    yield _pieces(held, key, buckets)
                    held, rows = [], 0
            if rows:
                yield _pieces(held, key, buckets)

        pieces = self.rows.mapInArrow(run, "bucket int, rows int, data binary")
        return pieces.repartitionById(tasks, F.pmod("bucket", F.lit(tasks)).cast("int")).sortWithinPartitions("bucket")

    def lists(self) -> DataFrame:
        """Each posting beside the leader of its list, if that is of another set; likewise the leaders of a split key. key, set_id, n, pos, l_set_id, l_n, l_pos, split."""
        return shared.materialise(self._lists(), "lists")

    def _lists(self) -> DataFrame:
        if not self.hot:
            return self._led(self.postings()).withColumn("split", F.lit(False))
        rows = shared.materialise(self._led(self.postings()), "lists")
        firsts = rows.where("salts > 1").groupBy("key", F.col("l_set_id").alias("set_id"), F.col("l_n").alias("n")).agg(F.min("l_pos").alias("pos"))
        first = firsts.groupBy("key").agg(F.min_by(F.struct("set_id", "n", "pos"), F.struct("pos", "set_id")).alias("l"))
        leaders = firsts.join(first, "key").select("key", "set_id", "n", "pos", F.col("l.set_id").alias("l_set_id"), F.col("l.n").alias("l_n"), F.col("l.pos").alias("l_pos"))
        inside = rows.where("set_id <> l_set_id").withColumn("split", F.col("salts") > 1).drop("salts")
        return inside.unionByName(leaders.where("set_id <> l_set_id").withColumn("split", F.lit(True)))

    def _led(self, postings: DataFrame) -> DataFrame:
        """Postings as lists has them; of split keys also the leaders' own, and salts."""
        hot = self.hot
        kinds = {"order": np.int64, "set_id": np.int64, "n": np.int32} | ({"base": np.int64, "salts": np.int32} if hot else {})
        names = ["key", "set_id", "n", "pos", "l_set_id", "l_n", "l_pos"] + ["salts"] * hot
        low = (1 << PLACE_BITS) - 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for columns in buckets(batches, kinds):
                by = np.lexsort((columns["set_id"], columns["order"]))
                columns = {c: x[by] for c, x in columns.items()}
                order, ids, n = columns["order"], columns["set_id"], columns["n"]
                new = np.ones(len(order), bool)
                new[1:] = (order[1:] >> PLACE_BITS) != (order[:-1] >> PLACE_BITS)
                lead = np.flatnonzero(new)[np.cumsum(new) - 1]
                keep = ids != ids[lead]
                if hot:
                    keep |= (columns["salts"] > 1) & new
                keep, lead = np.flatnonzero(keep), lead[keep]
                key = columns.get("base", order) >> PLACE_BITS
                out = [key[keep], ids[keep], n[keep], (order[keep] & low).astype(np.int32), ids[lead], n[lead], (order[lead] & low).astype(np.int32)]
                for a in range(0, len(keep), DEALT):
                    arrays = [pa.array(x[a : a + DEALT]) for x in out + ([columns["salts"][keep]] if hot else [])]
                    yield pa.RecordBatch.from_arrays(arrays, names)

        return postings.mapInArrow(run, "key long, set_id long, n int, pos int, l_set_id long, l_n int, l_pos int" + ", salts int" * hot)

    def alike(self, a: str, b: str) -> Column:
        """Length and positional filters on two postings of a key, with prefixes a and b of their columns, as if it were the first that the sets have in common."""
        n, m, i, j = (F.col(x) for x in (f"{a}n", f"{b}n", f"{a}pos", f"{b}pos"))
        most = F.least(n - i, m - j)
        return (100 * F.least(n, m) >= self.least * F.greatest(n, m)) & ((100 + self.least) * most >= self.least * (n + m))

    def with_parities(self, rows: DataFrame, prefix: str = "") -> DataFrame:
        """rows with the parities of the sets in the column {prefix}set_id."""
        if not self.parities:
            return rows
        known = self.digests.where("block is null and n > 0").groupBy("set_id").agg(*(F.first(f"p{k}").alias(f"{prefix}p{k}") for k in range(self.parities)))
        return rows.join(known.withColumnRenamed("set_id", f"{prefix}set_id"), f"{prefix}set_id")

    def close(self, a: str, b: str) -> Column:
        """Whether the parities allow two sets, with prefixes of their columns, to be similar."""
        apart = sum((F.bit_count(F.col(f"{a}p{k}").bitwiseXOR(F.col(f"{b}p{k}"))) for k in range(self.parities)), F.lit(0))
        total = F.col(f"{a}n") + F.col(f"{b}n")
        # n + m - 2 * both tokens aren't shared, and 100 * both >= least * (n + m - both).
        return (100 + self.least) * apart <= (100 - self.least) * total

    def led_pairs(self, rows: DataFrame) -> DataFrame:
        """a, b: distinct pairs of leader and member (columns of lists) that the filters let through."""
        rows = rows.where(self.alike("l_", "")).select("l_set_id", "l_n", "set_id", "n").distinct()
        rows = self.with_parities(self.with_parities(rows), "l_").where(self.close("l_", ""))
        return rows.select(F.least("l_set_id", "set_id").alias("a"), F.greatest("l_set_id", "set_id").alias("b")).distinct()

    def first_pairs(self, lists: DataFrame) -> DataFrame:
        """As led_pairs, of each set with the most central of its leaders only, that whose key has the first place in it."""
        of = lists.where(self.alike("l_", "")).groupBy("set_id", "n")
        first = of.agg(F.min_by("l_set_id", "l_pos").alias("l_set_id"), F.min_by("l_n", "l_pos").alias("l_n"))
        rows = self.with_parities(self.with_parities(first), "l_").where(self.close("l_", ""))
        return rows.select(F.least("l_set_id", "set_id").alias("a"), F.greatest("l_set_id", "set_id").alias("b")).distinct()

    def entries(self, rows: DataFrame, open_: DataFrame) -> DataFrame:
        """key, set_id, n, pos of the sets of open keys, but for leaders, which have met every other set of their lists; those of split keys have not."""
        leaders = rows.where("split").select("key", *(F.col(f"l_{c}").alias(c) for c in ("set_id", "n", "pos")))
        return rows.select("key", "set_id", "n", "pos").unionByName(leaders).join(open_, "key").dropDuplicates(["key", "set_id"])

    def joined_pairs(self, entries: DataFrame) -> DataFrame:
        """a, b: distinct pairs of entries (key, set_id, n, pos, label) of one key and different labels that the filters let through."""
        known = self.with_parities(entries)
        both = in_blocks(known, known, self.least).where((F.col("x_label") < F.col("y_label")) & self.alike("x_", "y_") & self.close("x_", "y_"))
        return both.select(F.least("x_set_id", "y_set_id").alias("a"), F.greatest("x_set_id", "y_set_id").alias("b")).distinct()

    def sharper(self, pairs: DataFrame) -> DataFrame:
        """The pairs that longer parities, of two bits for each token at least, allow to be similar."""
        if not self.parities:
            return pairs
        least = self.least
        known = self.digests.where("block is null and n > 0").groupBy("set_id").agg(F.first("long_parity").alias("parity"), F.first("n").alias("n"))
        of = lambda c: known.select(F.col("set_id").alias(c), F.col("parity").alias(f"{c}_parity"), F.col("n").alias(f"{c}_n"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y, n, m in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                    x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                    while len(x) != len(y):  # the longer one is folded
                        x, y = (x, y[: len(y) // 2] ^ y[len(y) // 2 :]) if len(x) < len(y) else (x[: len(x) // 2] ^ x[len(x) // 2 :], y)
                    keep.append((100 + least) * int(np.bitwise_count(x ^ y).sum()) <= (100 - least) * (n + m))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        both = pairs.join(of("a"), "a").join(of("b"), "b")
        return both.select("a", "b", "a_parity", "b_parity", "a_n", "b_n").mapInArrow(run, "a long, b long")

    def verified(self, pairs: DataFrame, standing: DataFrame, *more: str) -> DataFrame:
        """a, b of the pairs of classes whose sets are similar, and for columns `more` of standing (set_id, place, more) those of both classes,
        with prefixes a_ and b_. pairs: distinct a, b; repeated ones are compared again.

        Only the texts' parts that stand at the wanted classes' places are split into tokens again.
        """
        pairs = shared.materialise(self.sharper(pairs), "pairs")
        ids = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
        wanted_at = shared.materialise(standing.join(ids, "set_id"), "wanted")
        wanted = self._filter(wanted_at.select(F.col("place").alias("id")))
        split, least = self.split, self.least

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shared.forget()
            bloom = wanted.value
            for batch in batches:
                for a, b, data, offsets in T.chunks(batch.column(1)):
                    text, part, start, end = split.spans(data, offsets)
                    hit = _held(bloom, places(batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), text, part))
                    start, end = start[hit], end[hit]
                    tokens, sizes = split.tokens(T.gather(data, start, end - start), np.append(0, np.cumsum(end - start)))
                    ids, ends = class_ids(tokens, sizes), np.cumsum(sizes)
                    _, first = np.unique(ids, return_index=True)
                    hit = first[ids[first] != 0]
                    packed = [tokens[ends[i] - sizes[i] : ends[i]].tobytes() for i in hit.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(packed, pa.binary())], ["set_id", "tokens"])

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column(2), batch.column(3), strict=True):
                    x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                    both = len(x) + len(y) - len(np.union1d(x, y))
                    keep.append(100 * both >= least * (len(x) + len(y) - both))
                yield batch.drop_columns(["x", "y"]).filter(pa.array(keep, pa.bool_()))

        found = self.rows.mapInArrow(fetch, "set_id long, tokens binary").groupBy("set_id").agg(F.first("tokens").alias("tokens"))
        found = shared.materialise(found.join(wanted_at.select("set_id", *more), "set_id"), "sets")
        of = lambda c, p: found.select(F.col("set_id").alias(c), F.col("tokens").alias(p), *(F.col(m).alias(f"{c}_{m}") for m in more))
        both = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y", *(f"{c}_{m}" for c in "ab" for m in more))
        kinds = "".join(f", {c}_{m} {found.schema[m].dataType.simpleString()}" for c in "ab" for m in more)
        return shared.materialise(both.mapInArrow(compare, f"a long, b long{kinds}"), "links")

    def _filter(self, ids: DataFrame) -> Broadcast:
        """A Bloom filter of ids: 16 bits for each, 16 MB at most, beyond which it only lets more sets through to the join."""
        ids = ids.distinct()
        n = ids.count()
        bits = min(1 << 27, max(1 << 16, 1 << (16 * n - 1).bit_length() if n else 0)) // BLOCKS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: dict[int, np.ndarray] = {}
            for batch in batches:
                block, places = _places(batch.column(0).to_numpy(), bits)
                for k in np.unique(block).tolist():
                    parts.setdefault(k, np.zeros(bits, bool))[places[block == k].ravel()] = True
            for k, part in parts.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(part, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

        out = np.zeros((BLOCKS, bits // 8), np.uint8)
        dealt = ids.repartition(BLOCKS, F.expr(f"shiftrightunsigned(id, {64 - BLOCKS.bit_length() + 1})"))
        for row in dealt.mapInArrow(run, "block int, bits binary").collect():  # 16 MB at most
            out[row["block"]] |= np.frombuffer(row["bits"], np.uint8)
        return self.spark.sparkContext.broadcast(out)


def prefix(n: int, least: int) -> int:
    """How many of n tokens, the rare ones first, hold one in common with every similar set."""
    return n - -(-n * least // 100) + 1


def _pieces(held: list[dict[str, np.ndarray]], key: Callable, buckets: int) -> pa.RecordBatch:
    columns = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
    bucket = (T.mix(key(columns).view(np.uint64)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int32)
    order = np.argsort(bucket, kind="stable")
    columns, bucket = [x[order] for x in columns.values()], bucket[order]
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    ends = np.append(starts[1:], len(bucket))
    data = [b"".join([x[a:b].tobytes() for x in columns]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32)), pa.array((ends - starts).astype(np.int32)), pa.array(data, pa.binary())], ["bucket", "rows", "data"])


def buckets(batches: Iterator[pa.RecordBatch], kinds: dict[str, type]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each bucket that a task has got, one bucket after the other."""
    held, now = [], None
    whole = lambda: {c: np.concatenate([h[c] for h in held]) for c in kinds}
    for batch in batches:
        for bucket, rows, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if held and bucket != now:
                yield whole()
                held = []
            now, piece, at = bucket, {}, 0
            for c, kind in kinds.items():
                piece[c] = np.frombuffer(data.as_buffer(), kind, rows, at)
                at += piece[c].nbytes
            held.append(piece)
    if held:
        yield whole()


def in_blocks(x: DataFrame, y: DataFrame, least: int) -> DataFrame:
    """Rows of x beside those of y (key, set_id, n, more) of the same key and about the same size, with prefixes x_ and y_.

    Sizes are cut in classes, each at most 100 / least times as large as the one before, so that similar sets are in the same or in neighbouring
    ones. Rows of y that share key and class are cut in blocks of about BLOCK, each in a group of its own, and a row of x is given to all of them.
    """
    sized = lambda rows: rows.withColumn("size_class", F.floor(F.ln("n") / F.ln(F.lit(100 / least))).cast("int"))
    x, y = sized(x), sized(y)
    # Few lists are so long that they are cut: theirs alone are looked up.
    blocks = y.groupBy("key", "size_class").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    cut = lambda rows: rows.join(blocks, ["key", "size_class"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    y = cut(y).withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")).drop("blocks")
    x = x.withColumn("size_class", F.explode(F.array(F.col("size_class") - 1, F.col("size_class"), F.col("size_class") + 1)))
    x = cut(x).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    by = ["key", "size_class", "block"]
    x, y = (rows.select(*by, *(F.col(c).alias(f"{p}{c}") for c in rows.columns if c not in by)) for rows, p in ((x, "x_"), (y, "y_")))
    return x.join(y, by)


def _places(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    ids = ids.astype(np.int64).view(np.uint64)
    h = T.mix(ids)
    step = T.mix(h) | np.uint64(1)
    block = (ids >> np.uint64(64 - BLOCKS.bit_length() + 1)).astype(np.int64)
    return block, ((h[:, None] + step[:, None] * np.arange(4, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


def _held(bloom: np.ndarray, ids: np.ndarray) -> np.ndarray:
    block, places = _places(ids, bloom.shape[1] * 8)
    return np.all(bloom[block[:, None], places >> 3] >> (places & 7) & 1, axis=1)
