"""Language-model scoring with an Elias-Fano n-gram trie.

Level 1 of the trie holds the training words (64-bit hashes, ascending; a word's id is
its rank) with their counts. Level k holds, for each context (a node of level k-1),
the ids of the words that follow: pointers from contexts to their ranges are monotone
and Elias-Fano coded; so are the successors, each shifted by its context's place times
the number of words, so that one successor search in the context's own range finds a
word. Beside each n-gram stands its discounted probability max(c-D, 0)/c(context),
quantised to a byte on a log scale. Queries interpolate:

    p_k(w | h) = discounted_k(h, w) + D * followers(h) / c(h) * p_{k-1}(w | h')
    p_1(w) = (c + 0.1) / (N + 0.1 (V + 1))

Followers come from the pointers. Every document begins after an end token, which is
also the context of its first word.

Training is made of Spark jobs: tasks count n-grams of their rows, the counts are dealt
out by ranges of keys and summed, and each range becomes one file in the shared folder,
which scoring tasks map into memory. Counts cover all training rows; `min_count` leaves
out rare n-grams of 2 words and more (1: none), which is the way to bound the trie.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestry.llm import elias_fano as EF
from harvestry.llm import shared
from harvestry.llm import text as T

END = np.uint64(0x5851F42D4C957F2D)  # stands for the end token's hash
STEPS, LOWEST = 255, -9.0  # quantised log10 probabilities: 1 is LOWEST, 255 is 0
HELD = 2_000_000  # n-grams that a task sums up before it hands them on
RANGE = 2_000_000  # training tokens for each range of keys
CHUNK = 4 << 20  # bytes of text that are looked up at once: the more, the more n-grams repeat


@dataclass
class Level:
    """The files of a level: first keys (word hashes, or contexts times words), first indices, paths; contexts whose range is cut, with all their followers."""

    first: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    offset: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    paths: list[str] = field(default_factory=list)
    cut: dict[int, int] = field(default_factory=dict)
    totals: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


@dataclass
class Model:
    tokens: int
    words: int
    order: int
    discount: float
    levels: list[Level]


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end token after each text, and the number of tokens before each text."""
    hashes, before = T.words(data, offsets)
    return np.insert(hashes, before[1:], END).view(np.int64), before + np.arange(len(before))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first)


class Held:
    """Sums counts of keys up to a bounded number of them."""

    def __init__(self):
        self.keys, self.counts, self.n = [], [], 0

    def add(self, keys: np.ndarray) -> bool:
        """Whether there is enough to hand on."""
        keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.n += len(keys)
        return self.n >= HELD

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = summed(np.concatenate([np.zeros(0, np.int64), *self.keys]), np.concatenate([np.zeros(0, np.int64), *self.counts]))
        self.__init__()
        return out


class Vocabulary:
    def __init__(self, level: Level):
        self.level, self.files = level, {}

    def _file(self, k: int) -> dict[str, np.ndarray]:
        if k not in self.files:
            self.files[k] = shared.map_arrays(self.level.paths[k])
        return self.files[k]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of ascending hashes."""
        ids, counts = np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
        for k, part in _parts(self.level, hashes):
            file = self._file(k)
            keys = file["keys"]
            at = np.minimum(np.searchsorted(keys, hashes[part]), len(keys) - 1)
            known = keys[at] == hashes[part]
            ids[part] = np.where(known, self.level.offset[k] + at, -1)
            counts[part] = np.where(known, file["counts"][at], 0)
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of ascending ids."""
        return _take(self, ids, "counts")


def _take(level, index: np.ndarray, name: str) -> np.ndarray:
    out = np.zeros(len(index), np.int64)
    edges = np.searchsorted(index, level.level.offset)
    for k in range(len(level.level.paths)):
        part = slice(edges[k], edges[k + 1] if k + 1 < len(edges) else len(index))
        if part.start < part.stop:
            out[part] = level._file(k)[name][index[part] - level.level.offset[k]]
    return out


def _parts(level: Level, keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The files that may hold ascending keys, each with its part of them."""
    edges = np.append(np.searchsorted(keys, level.first), len(keys))
    for k in np.flatnonzero(np.diff(edges)).tolist():
        yield k, slice(int(edges[k]), int(edges[k + 1]))


class Successors(Vocabulary):
    """A level of two words or more."""

    def __init__(self, level: Level, words: int):
        super().__init__(level)
        self.words, self.coded = words, {}

    def _coded(self, k: int) -> tuple[EF.Sequence, EF.Sequence, int]:
        if k not in self.coded:
            file = self._file(k)
            parts = [EF.Sequence({n: file[f"{p}_{n}"] for n in ("meta", "low", "high", "zeros")}) for p in "ps"]
            self.coded[k] = (*parts, int(file["base"][0]))
        return self.coded[k]

    def find(self, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes (-1: none) and discounted probabilities (0: none) of pairs in ascending order."""
        nodes, p = np.full(len(contexts), -1), np.zeros(len(contexts))
        keys = contexts * self.words + words
        for k, part in _parts(self.level, keys):
            pointers, successors, base = self._coded(k)
            here = contexts[part] - base
            inside = np.flatnonzero(here < pointers.n - 1)
            at = np.full(len(here), -1)
            at[inside] = successors.find(here[inside] * self.words + words[part][inside])
            found = at >= 0
            nodes[part] = np.where(found, self.level.offset[k] + at, -1)
            p[part] = np.where(found, 10.0 ** ((self._file(k)["q"][at].astype(np.float64) - STEPS) * (-LOWEST / (STEPS - 1))), 0.0)
        return nodes, p

    def followers(self, contexts: np.ndarray) -> np.ndarray:
        """The number of words that follow each of ascending contexts."""
        out = np.zeros(len(contexts), np.int64)
        # A context's range begins in the last file whose first key isn't beyond it, or it is a cut one.
        for k, part in _parts(self.level, contexts * self.words + self.words - 1):
            pointers, _, base = self._coded(k)
            here = contexts[part] - base
            inside = (here >= 0) & (here < pointers.n - 1)
            at = here[inside]
            n = np.zeros(len(here), np.int64)
            n[inside] = pointers.get(at + 1) - pointers.get(at)
            out[part] = n
        for context, n in self.level.cut.items():
            i = np.searchsorted(contexts, context)
            if i < len(contexts) and contexts[i] == context:
                out[i] = n
        return out


@dataclass
class Opened:
    vocabulary: Vocabulary
    higher: list[Successors]
    end: int


@lru_cache(1)
def _opened(key: str) -> list:
    return []


def opened(key: str, model: Model) -> Opened:
    """A worker's view of a model; the files stay mapped from task to task."""
    held = _opened(f"{key}:{len(model.levels)}")
    if not held:
        vocabulary = Vocabulary(model.levels[0])
        end = int(vocabulary.find(np.array([END]).view(np.int64))[0][0])
        held.append(Opened(vocabulary, [Successors(x, model.words) for x in model.levels[1:]], end))
    return held[0]


def _pairs(contexts: np.ndarray, words: np.ndarray, level: Successors) -> list[np.ndarray]:
    """level.find's results for pairs in any order, looked up once for each distinct pair."""
    keys, slot = np.unique(contexts * level.words + words, return_inverse=True)
    return [x[slot] for x in level.find(keys // level.words, keys % level.words)]


def _following(ids: np.ndarray, before: np.ndarray, first: int) -> np.ndarray:
    """Of each token what stands at the one before it; `first` at the start of a text."""
    out = np.empty(len(ids), np.int64)
    out[1:] = ids[:-1]
    out[before[:-1]] = first
    return out


def contexts_of(ids: np.ndarray, before: np.ndarray, view: Opened, order: int) -> np.ndarray:
    """The context node of each token at an order from 2 (-1: unknown)."""
    context = _following(ids, before, view.end)
    for level in view.higher[: order - 2]:
        nodes = np.full(len(ids), -1)
        known = np.flatnonzero((context >= 0) & (ids >= 0))
        if len(known):
            nodes[known] = _pairs(context[known], ids[known], level)[0]
        context = _following(nodes, before, -1)
    return context


def _token_ids(hashes: np.ndarray, view: Opened) -> tuple[np.ndarray, np.ndarray]:
    distinct, inverse = np.unique(hashes, return_inverse=True)
    ids, counts = view.vocabulary.find(distinct)
    return ids[inverse], counts[inverse]


def _vocabulary(train: DataFrame, at: str) -> tuple[Level, int, int]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, full = Held(), False
        for batch in batches:
            for _, _, data, offsets in T.chunks(batch.column(1)):
                if full:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.take()], ["hash", "n"])
                full = held.add(tokens_of(data, offsets)[0])
        if held.n:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.take()], ["hash", "n"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for batch in batches:
            keys.append(batch.column(0).to_numpy())
            counts.append(batch.column(1).to_numpy())
        if not keys or not sum(map(len, keys)):
            return
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        path = f"{at}/1-{TaskContext.get().partitionId():08d}"
        shared.write_arrays(path, {"keys": keys, "counts": counts.astype(np.uint32) if counts.max() < 1 << 32 else counts})
        yield pa.RecordBatch.from_pylist([{"path": path, "first": int(keys[0]), "n": len(keys), "total": int(counts.sum())}])

    spark = train.sparkSession
    counted = shared.materialise(train.mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")), "words")
    ordered = counted.repartitionByRange(shared.tasks(spark), "hash").sortWithinPartitions("hash")
    rows = sorted(ordered.mapInArrow(write, "path string, first long, n long, total long").collect(), key=lambda r: r["first"])  # a row for each file
    sizes = np.array([r["n"] for r in rows], np.int64)
    level = Level(np.array([r["first"] for r in rows], np.int64), np.cumsum(sizes) - sizes, [r["path"] for r in rows], totals=np.array([r["total"] for r in rows], np.int64))
    return level, int(sizes.sum()), int(level.totals.sum())


def _bounds(spark: SparkSession, level: Level, words: int, parts: int) -> np.ndarray:
    """Keys that cut the next level into ranges of about as many training tokens, a frequent context's own range as well."""
    total, before = int(level.totals.sum()), np.cumsum(level.totals) - level.totals

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = shared.map_arrays(row["path"])["counts"]
                ends = row["before"] + np.cumsum(counts, dtype=np.int64)
                wanted = np.arange(1, parts) * total // parts
                wanted = wanted[(wanted >= row["before"]) & (wanted < ends[-1])]
                i = np.searchsorted(ends, wanted, "right")
                share = (wanted - (ends[i] - counts[i])) / counts[i]
                yield pa.RecordBatch.from_arrays([pa.array((row["offset"] + i) * words + (share * words).astype(np.int64), pa.int64())], ["key"])

    rows = [(p, int(o), int(b)) for p, o, b in zip(level.paths, level.offset, before, strict=True)]
    found = spark.createDataFrame(rows, "path string, offset long, before long").repartition(max(1, min(len(rows), shared.tasks(spark)))).mapInArrow(cut, "key long")
    return np.unique(np.array([r["key"] for r in found.collect()], np.int64))


def _next_level(train: DataFrame, at: str, model: Model, min_count: int, last: bool) -> Level:
    spark, order, words = train.sparkSession, len(model.levels) + 1, model.words
    parts = max(shared.tasks(spark), -(-model.tokens // RANGE))
    bounds = spark.sparkContext.broadcast((_bounds(spark, model.levels[-1], words, parts), model))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, known = bounds.value
        view, held, full = opened(at, known), Held(), False
        press = zstandard.ZstdCompressor(level=1)

        def packed() -> pa.RecordBatch:
            keys, counts = held.take()
            edges = np.concatenate([[0], np.searchsorted(keys, cuts), [len(keys)]])
            rows = []
            for k in np.flatnonzero(np.diff(edges)).tolist():
                a, b = edges[k], edges[k + 1]
                rows.append((k, press.compress(_planes(np.diff(keys[a:b], prepend=0))), press.compress(_planes(counts[a:b]))))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))], ["part", "keys", "counts"])

        for batch in batches:
            for _, _, data, offsets in T.chunks(batch.column(1), CHUNK):
                if full:
                    yield packed()
                hashes, before = tokens_of(data, offsets)
                ids, _ = _token_ids(hashes, view)
                context = contexts_of(ids, before, view, order)
                good = (context >= 0) & (ids >= 0)
                full = held.add(context[good] * words + ids[good])
        if held.n:
            yield packed()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        view, press = opened(at, bounds.value[1]), zstandard.ZstdDecompressor()
        part, keys, counts = None, [], []

        def ended() -> Iterator[pa.RecordBatch]:
            if part is None:
                return
            k, c = summed(np.concatenate(keys), np.concatenate(counts))
            k, c = k[c >= min_count], c[c >= min_count]
            if len(k):
                yield _write_range(k, c, f"{at}/{order}-{part:08d}", view, words, model.discount, last)

        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    yield from ended()
                    part, keys, counts = row["part"], [], []
                keys.append(np.cumsum(_unplanes(press.decompress(row["keys"]))))
                counts.append(_unplanes(press.decompress(row["counts"])))
                if len(keys) >= 32:  # bounds what a range's many parts take
                    k, c = summed(np.concatenate(keys), np.concatenate(counts))
                    keys, counts = [k], [c]
        yield from ended()

    dealt = train.mapInArrow(count, "part int, keys binary, counts binary").repartition(parts, "part").sortWithinPartitions("part")
    schema = "path string, first long, n long, total long, first_context long, first_followers long, last_context long, last_followers long"
    rows = sorted(dealt.mapInArrow(write, schema).collect(), key=lambda r: r["first"])  # a row for each range
    ends = defaultdict(list)
    for r in rows:
        ends[r["first_context"]].append(r["first_followers"])
        if r["last_context"] != r["first_context"]:
            ends[r["last_context"]].append(r["last_followers"])
    sizes = np.array([r["n"] for r in rows], np.int64)
    cut = {c: sum(n) for c, n in ends.items() if len(n) > 1}
    return Level(np.array([r["first"] for r in rows], np.int64), np.cumsum(sizes) - sizes, [r["path"] for r in rows], cut, np.array([r["total"] for r in rows], np.int64))


def _planes(x: np.ndarray) -> bytes:
    """The numbers' lowest bytes, then the next ones, and so on: small numbers are then compressed well."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _write_range(keys: np.ndarray, counts: np.ndarray, path: str, view: Opened, words: int, discount: float, last: bool) -> pa.RecordBatch:
    contexts = keys // words
    base, top = int(contexts[0]), int(contexts[-1])
    distinct, first, followers = np.unique(contexts, return_index=True, return_counts=True)
    pointers = np.searchsorted(contexts, np.arange(base, top + 2)) if top - base < 4 * len(keys) + 1024 else None
    if pointers is None:
        pointers = np.repeat(np.append(first, len(keys)), np.diff(distinct, prepend=base - 1, append=top + 1))
    level = view.higher[-1] if view.higher else view.vocabulary
    before = np.repeat(level.counts(distinct), followers)
    p = np.maximum(counts - discount, 1e-12) / np.maximum(before, counts)
    q = np.clip(np.rint(STEPS + np.log10(p) * ((STEPS - 1) / -LOWEST)), 1, STEPS).astype(np.uint8)
    coded = {f"p_{n}": x for n, x in EF.encode(pointers, len(keys) + 1).items()}
    coded |= {f"s_{n}": x for n, x in EF.encode(keys - base * words, (top - base + 1) * words).items()}
    if not last:
        coded["counts"] = counts.astype(np.uint32) if counts.max() < 1 << 32 else counts
    shared.write_arrays(path, coded | {"q": q, "base": np.array([base], np.int64)})
    return pa.RecordBatch.from_pylist([{"path": path, "first": int(keys[0]), "n": len(keys), "total": int(counts.sum()), "first_context": base, "first_followers": int(followers[0]), "last_context": top, "last_followers": int(followers[-1])}])


def train_model(train: DataFrame, order: int = 2, discount: float = 0.75, min_count: int = 1, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, Model]:
    """Builds the trie of the given rows in a new folder of the shared one; gives the folder and the model's description.

    Null texts count as empty, repeated rows count again; without rows every word is unknown.
    """
    at = shared.scratch_dir(train.sparkSession, "trie")
    rows = shared.texts_of(train, id_col, text_col)
    level, words, tokens = _vocabulary(rows, at)
    model = Model(tokens, words, order if words else 1, discount, [level])
    for k in range(2, model.order + 1):
        model.levels.append(_next_level(rows, at, model, min_count, k == order))
    return at, model


def score_texts(docs: DataFrame, at: str, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities) of every text; a null text is an empty one."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        view = opened(at, model) if model.words else None
        below = model.tokens + 0.1 * (model.words + 1)
        for batch in batches:
            for a, b, data, offsets in T.chunks(batch.column(1), CHUNK):
                hashes, before = tokens_of(data, offsets)
                ids, counts = _token_ids(hashes, view) if view else (np.full(len(hashes), -1), np.zeros(len(hashes), np.int64))
                p = base = (counts + 0.1) / below
                context = _following(ids, before, view.end) if view else ids
                for k, level in enumerate(view.higher if view else ()):
                    lower = view.higher[k - 1] if k else view.vocabulary
                    known = np.flatnonzero(context >= 0)
                    distinct, inverse = np.unique(context[known], return_inverse=True)
                    total = np.maximum(lower.counts(distinct), 1)
                    left = (model.discount * np.minimum(level.followers(distinct), total) / total)[inverse]
                    seen, nodes = np.zeros(len(ids)), np.full(len(ids), -1)
                    both = known[ids[known] >= 0]
                    if len(both):
                        nodes[both], seen[both] = _pairs(context[both], ids[both], level)
                    p = p.copy()
                    # A context that min_count left without followers keeps all for the lower order.
                    p[known] = np.where(left > 0, seen[known] + left * p[known], p[known])
                    context = _following(nodes, before, -1)
                sums = [np.add.reduceat(x, before[:-1]) if b > a else np.zeros(0) for x in (np.log10(base), np.log10(p), (counts > 0).astype(np.int64))]
                out = [batch.column(0).slice(a, b - a), pa.array(np.diff(before)), pa.array(sums[2]), pa.array(np.full(b - a, model.tokens)), pa.array(sums[0]), pa.array(sums[1])]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return shared.texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(col, fold: int = 0, folds: int = 10):
    """Whether the crc32 of an identifier as text leaves this remainder; a null one is never held out."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def score_held_out(docs: DataFrame, order: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learns from the documents that aren't held out and scores all: the columns of score_texts and held_out."""
    at, model = train_model(docs.where(~held_out(F.col(id_col))), order, id_col=id_col, text_col=text_col)
    return score_texts(docs, at, model, id_col, text_col).withColumn("held_out", held_out(F.col("doc_id")))
