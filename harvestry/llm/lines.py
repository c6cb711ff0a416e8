"""Line dedup by an exact set-similarity join.

A line's tokens are its distinct words, the rare ones first. A line is removed if it is
similar to an earlier one (by doc_id, then by line number), itself removed or not; a line
without words stays. Equal sets of words form one class and take part once.

1. Each class lists the tokens of its prefix; a token that no other line has is left out.
2. Lists are sorted by token and read as a stream. In a list of bounded length all pairs meet,
   in a longer one each class meets a few early ones, which are those least covered so far. Length
   and positional filters, as if the list's token were the first that two classes have in common,
   and parities that bound how many tokens two sets don't share, choose the pairs to verify: for
   each class a few earlier ones. Classes of pairs that this leaves out are kept, and longer lists.
3. The chosen pairs are verified, which settles nearly all classes that have an earlier similar one.
4. Kept classes that are still open meet all earlier kept ones of their lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry.llm import setjoin, shared
from harvestry.llm import text as T
from harvestry.llm.setjoin import LINES, Join, line_words

MET = 1024  # up to this length all pairs of a list meet in one task
CHOSEN = 2  # pairs of one class in one list that are verified at first; one more in a longer list
LEADERS = 16  # classes of a longer list that all later ones meet, as long as they lack pairs
SHORT = 48  # up to so many words parities take 64 bits, beyond 128
EDGES, SEEN = 1 << 20, 1 << 17
POSTING = ["list", "set_id", "doc_id", "sizes", "p0", "p1", "key"]


def removed_parts(docs: DataFrame, least: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_id (a hash of the text), parts (how many lines there are), gone array<long> (the numbers of those removed).

    Repeated rows of one doc_id and text are one row here. Lines of rows with the same doc_id,
    line number and words stand at the same place, and none of them is later than another. A
    null doc_id comes before all others. Null and empty texts have no lines and no row here.
    """
    join = Join(shared.texts_of(docs, id_col, text_col, F.xxhash64(docs[text_col].cast("string")).alias("row_id")), LINES, least)
    lines = join.sets().where("n > 0")
    lines = lines.withColumn("at", _at(lines))
    # Minima of numbers, not of structs: they are aggregated by hashing, before the shuffle and after it.
    classes = shared.materialise(lines.groupBy("set_id").agg(F.min("at").alias("first"), F.count("*").alias("k"), F.min("place").alias("place")), "classes")
    met = shared.materialise(_met(join), "met")
    later = _later(join.verified(met.where("key is null").select(F.col("set_id").alias("a"), F.col("other").alias("b")).distinct(), classes, "first"))
    rest = shared.materialise(_open_pairs(join, met.where("key is not null"), classes, later), "pairs")
    if not rest.isEmpty():
        later = shared.materialise(later.unionByName(_later(join.verified(rest, classes, "first"))).distinct(), "later")
    # Classes of which a line goes, written before the lines join them, so that a frequent one can be split.
    marked = classes.join(later.withColumn("later", F.lit(True)), "set_id", "left").where("k > 1 or later").select("set_id", "first", F.coalesce("later", F.lit(False)).alias("later"))
    marked = shared.materialise(marked, "marked")
    gone = lines.join(marked, "set_id").where(F.col("later") | (F.col("at") != F.col("first"))).select("doc_id", "row_id", "part", F.lit(None).cast("long").alias("parts"))
    counts = join.sets().where("part = 0").select("doc_id", "row_id", F.lit(None).cast("long").alias("part"), "parts")
    return gone.unionByName(counts).groupBy("doc_id", "row_id").agg(F.max("parts").alias("parts"), F.array_sort(F.collect_set("part")).alias("gone"))


def _at(lines: DataFrame) -> Column:
    """One number for the order of lines: by doc_id, a null one first, then by line. A long if the greatest ones fit in it, else a decimal."""
    low, high, parts = lines.agg(F.min("doc_id"), F.max("doc_id"), F.max("part")).first()
    low, high, bits = low or 0, high or 0, (parts or 0).bit_length()
    if low >= 0 and (high + 1) << bits < 1 << 63:
        return F.shiftleft(F.coalesce(F.col("doc_id"), F.lit(-1)) + 1, bits) + F.col("part")
    doc = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.expr("cast(-9223372036854775809 as decimal(20,0))"))
    return (doc * F.lit(1 << 32).cast("decimal(10,0)") + F.col("part")).cast("decimal(38,0)")


def _later(links: DataFrame) -> DataFrame:
    """set_id of the later class of each link (a, b, a_first, b_first)."""
    return shared.materialise(links.select(F.when(F.col("a_first") < F.col("b_first"), F.col("b")).otherwise(F.col("a")).alias("set_id")).distinct(), "later")


def _postings(join: Join) -> DataFrame:
    """In buckets: list, set_id, doc_id, sizes (n and position), p0, p1 (parities) and, if there are frequent tokens, key: the token, which list is as well unless it is split."""
    least, counts, hot, split = join.least, join.counts, setjoin.HOT, join.hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        seen: set[int] = set()  # classes that this task has listed lately
        for batch in batches:
            for a, _, data, offsets in T.chunks(batch.column(1)):
                text, _, tokens, sizes = line_words(data, offsets)
                ids = setjoin.class_ids(tokens, sizes)
                _, first = np.unique(ids, return_index=True)
                keep = np.zeros(len(ids), bool)
                keep[[i for i, k in zip(first.tolist(), ids[first].tolist(), strict=True) if k not in seen]] = True
                keep &= sizes > 0
                if len(seen) > SEEN:
                    seen.clear()
                seen.update(ids[keep].tolist())
                tokens, sizes, ids, text = tokens[np.repeat(keep, sizes)], sizes[keep], ids[keep], text[keep]
                line = np.repeat(np.arange(len(sizes)), sizes)
                frequency = counts.value[(tokens & np.uint64((1 << setjoin.SLOT_BITS) - 1)).astype(np.int64)]
                rank = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                order = _by_rarity(line, frequency, rank)
                pos = rank  # the k-th place of each line has the k-th rarest token
                p = sizes - -(-sizes * least // 100) + 1
                take = np.flatnonzero((pos < p[line]) & (frequency[order] > 1))
                at, pos, frequency, keys = line[take], pos[take], frequency[order[take]], tokens[order[take]]
                listed = keys
                if split:
                    parts = (frequency // hot + 1).astype(np.uint64)
                    listed = np.where(parts > 1, T.mix(keys + ((ids[at].view(np.uint64) >> np.uint64(20)) % parts + np.uint64(1)) * setjoin.PAIRED), keys)
                p0, p1 = _parities(tokens, sizes)
                doc = batch.column(0).fill_null(-(1 << 63)).to_numpy()[a + text[at]]  # a null before all others
                columns = [listed.view(np.int64), ids[at], doc, (sizes[at] << 32) + pos, p0[at], p1[at], keys.view(np.int64)]
                yield dict(zip(POSTING[: 6 + split], columns, strict=False))

    return join.dealt(run, lambda columns: columns["list"])


def _by_rarity(line: np.ndarray, frequency: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The order by line, then frequency, then rank in the line."""
    line_bits, rank_bits = (int(x.max(initial=0)).bit_length() for x in (line, rank))
    if line_bits + 32 + rank_bits > 64:
        return np.lexsort((rank, frequency, line))
    packed = (line.astype(np.uint64) << np.uint64(32 + rank_bits)) | (frequency.astype(np.uint64) << np.uint64(rank_bits)) | rank.astype(np.uint64)
    return np.argsort(packed)


def _parities(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parities in two words; those of short sets folded into the first one."""
    if not len(sizes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p0, p1 = setjoin.parity(tokens, sizes, 2)
    short = sizes <= SHORT
    return np.where(short, p0 ^ p1, p0), np.where(short, 0, p1)


class _Lists:
    """Postings of whole lists; finds the pairs to verify and the rows to keep."""

    def __init__(self, columns: dict[str, np.ndarray], least: int, met: int, chosen: int):
        order = np.argsort(columns["list"])
        columns = {c: x[order] for c, x in columns.items()}
        edge = np.ones(len(columns["list"]) + 1, bool)
        edge[1:-1] = columns["list"][1:] != columns["list"][:-1]
        number = np.cumsum(edge[:-1])
        split = columns["list"] != columns["key"] if "key" in columns else np.zeros(len(number), bool)
        some = np.flatnonzero(~(edge[:-1] & edge[1:]) | split)  # nothing meets a class that is alone in its list
        some = some[np.lexsort((columns["doc_id"][some], columns["set_id"][some], number[some]))]
        number, ids = number[some], columns["set_id"][some]
        fresh = np.ones(len(some), bool)
        fresh[1:] = (number[1:] != number[:-1]) | (ids[1:] != ids[:-1])
        some, number = some[fresh], number[fresh]
        self.columns, self.least = {c: x[some] for c, x in columns.items()}, least
        self.columns.setdefault("key", self.columns["list"])
        self.chosen = chosen
        self.n, self.pos = self.columns["sizes"] >> 32, self.columns["sizes"] & 0xFFFFFFFF
        rows = len(self.n)
        starts = np.ones(rows, bool)
        starts[1:] = number[1:] != number[:-1]
        self.list = np.cumsum(starts) - 1
        self.start = np.flatnonzero(starts)
        self.length = np.diff(np.append(self.start, rows))
        self.rank = np.arange(rows) - self.start[self.list] if rows else np.zeros(0, np.int64)
        self.kept = ((self.length > met) | split[some[self.start]])[self.list] if rows else np.zeros(0, bool)

    def alike(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which of the pairs of rows the filters let through."""
        n, m, i, j, least = self.n[x], self.n[y], self.pos[x], self.pos[y], self.least
        most = np.minimum(n - i, m - j)
        ok = np.flatnonzero((100 * np.minimum(n, m) >= least * np.maximum(n, m)) & ((100 + least) * most >= least * (n + m)))
        x, y, n, m = x[ok], y[ok], n[ok], m[ok]
        d0, d1 = (self.columns[c][x] ^ self.columns[c][y] for c in ("p0", "p1"))
        folded = (n <= SHORT) | (m <= SHORT)
        apart = np.where(folded, np.bitwise_count((d0 ^ d1).view(np.uint64)), np.bitwise_count(d0.view(np.uint64)).astype(np.int64) + np.bitwise_count(d1.view(np.uint64)))
        return ok[(100 + least) * apart.astype(np.int64) <= (100 - least) * (n + m)]

    def _led(self, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a long list's rows, in order, and leaders."""
        met, out, at = np.zeros(len(rows), np.int64), [], -1
        for _ in range(LEADERS):
            lacking = np.flatnonzero(met[at + 1 :] <= self.chosen) + at + 1
            if len(lacking) < 2:
                break
            at, later = lacking[0], lacking[1:]
            later = later[self.alike(rows[later], np.full(len(later), rows[at]))]
            met[later] += 1
            out.append((rows[later], np.full(len(later), rows[at])))
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows of classes and of earlier ones, few for each class; marks the rows of the pairs that are left out."""
        doc = self.columns["doc_id"]
        held, edges = (np.zeros(0, np.int64), np.zeros(0, np.int64)), []
        long = self.kept.copy()

        def fewer() -> tuple[np.ndarray, np.ndarray]:
            x, y = (np.concatenate(v) for v in zip(held, *edges, strict=True))
            order = np.lexsort((y, doc[y], x))
            x, y = x[order], y[order]
            few = np.ones(len(x), bool)
            few[self.chosen :] = (x[self.chosen :] != x[: -self.chosen]) | long[x[self.chosen :]]
            self.kept[x[~few]] = self.kept[y[~few]] = True
            return x[few], y[few]

        def meet(x: np.ndarray, y: np.ndarray) -> int:
            ok = self.alike(x, y)
            x, y = x[ok], y[ok]
            swap = (doc[x] < doc[y]) | ((doc[x] == doc[y]) & (x < y))
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            edges.append((x, y))
            return len(x)

        for k in np.flatnonzero(long[self.start]).tolist():
            edges += self._led(self.start[k] + np.lexsort((np.arange(self.length[k]), doc[self.start[k] : self.start[k] + self.length[k]])))
        more, d, x = 0, 1, np.flatnonzero(~long & (self.rank > 0))
        while len(x):
            more += meet(x, x - d)
            if more > EDGES:
                held, edges, more = fewer(), [], 0
            d += 1
            x = x[self.rank[x] >= d]
        return fewer()


def _met(join: Join) -> DataFrame:
    """set_id, other: classes to verify; and with key, n, pos, p0, p1 the rows that are kept."""
    least, met, chosen, split = join.least, MET, CHOSEN, join.hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, out = ["set_id", "other", "key", "n", "pos", "p0", "p1"], pa.int64()

        def found(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            lists = _Lists(columns, least, met, chosen)
            x, y = lists.pairs()
            ids = lists.columns["set_id"]
            pairs = np.unique(np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *[pa.nulls(len(pairs), out)] * 5], names)
            kept = np.flatnonzero(lists.kept)
            yield pa.RecordBatch.from_arrays([pa.array(ids[kept]), pa.nulls(len(kept), out), *(pa.array(v[kept]) for v in (lists.columns["key"], lists.n, lists.pos, lists.columns["p0"], lists.columns["p1"]))], names)

        for columns in setjoin.buckets(batches, {c: np.int64 for c in POSTING[: 6 + split]}):
            yield from found(columns)

    return _postings(join).mapInArrow(run, "set_id long, other long, key long, n long, pos long, p0 long, p1 long")


def _open_pairs(join: Join, kept: DataFrame, classes: DataFrame, later: DataFrame) -> DataFrame:
    """a, b: pairs of a kept class that isn't known to be later than a similar one, and an earlier one of its list."""
    kept = kept.select("key", "set_id", "n", "pos", "p0", "p1")
    still = shared.materialise(kept.join(later, "set_id", "left_anti"), "open")
    placed = kept.join(still.select("key").distinct(), "key", "left_semi").join(classes, "set_id")
    still = still.join(classes, "set_id")
    columns = ["key", "set_id", "n", "pos", "p0", "p1", "first"]
    both = setjoin.in_blocks(still.select(*columns), placed.select(*columns), join.least)
    apart = [F.col(f"x_{c}").bitwiseXOR(F.col(f"y_{c}")) for c in ("p0", "p1")]
    folded = (F.col("x_n") <= SHORT) | (F.col("y_n") <= SHORT)
    bits = F.when(folded, F.bit_count(apart[0].bitwiseXOR(apart[1]))).otherwise(F.bit_count(apart[0]) + F.bit_count(apart[1]))
    close = (100 + join.least) * bits <= (100 - join.least) * (F.col("x_n") + F.col("y_n"))
    both = both.where((F.col("y_first") < F.col("x_first")) & join.alike("x_", "y_") & close)
    return both.select(F.least("x_set_id", "y_set_id").alias("a"), F.greatest("x_set_id", "y_set_id").alias("b")).distinct()


def removed_lines(docs: DataFrame, least: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed, removed (numbers of the removed lines, joined by commas) of every row; nulls and repeated rows as in removed_parts."""
    gone = removed_parts(docs, least, id_col, text_col)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col].cast("string")).alias("row_id"))
    same = rows["doc_id"].eqNullSafe(gone["doc_id"]) & (rows["row_id"] == gone["row_id"])
    out = rows.join(gone, same, "left").select(rows["doc_id"], F.coalesce("parts", F.lit(0)).alias("n_lines"), F.coalesce("gone", F.array().cast("array<long>")).alias("gone"))
    return out.select("doc_id", "n_lines", F.size("gone").cast("long").alias("n_removed"), F.array_join(F.col("gone").cast("array<string>"), ",").alias("removed"))


def dedup_lines(docs: DataFrame, least: int = 80, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", drop_emptied: bool = False) -> DataFrame:
    """The documents without the removed lines, all columns as they are; length_col, if it is there, becomes the new text's length.

    A document that loses all its words keeps its row with what is left (an empty text, or lines without words), unless drop_emptied:
    then it goes. Null texts stay null, and texts that had no words before stay as they were, either way.
    """
    gone = removed_parts(docs, least, id_col, text_col).where(F.size("gone") > 0).select(F.col("doc_id").alias("__doc"), F.col("row_id").alias("__row"), F.col("gone").alias("__gone"))
    rows = docs.withColumn("__text_hash", F.xxhash64(docs[text_col].cast("string")))
    joined = rows.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("__doc")) & (F.col("__text_hash") == F.col("__row")), "left")
    changed = F.col("__gone").isNotNull()
    lines = F.filter(F.split(F.col(text_col), "\n"), lambda line, i: ~F.array_contains("__gone", i.cast("long")))
    out = joined.withColumn(text_col, F.when(changed, F.array_join(lines, "\n")).otherwise(F.col(text_col)))
    if drop_emptied:
        out = out.where(~changed | F.col(text_col).rlike(r"[^\x20\x09-\x0D]"))
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.when(changed, F.length(text_col)).otherwise(F.col(length_col)).cast(docs.schema[length_col].dataType))
    return out.select(*docs.columns)
