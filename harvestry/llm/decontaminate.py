"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are normalised: letters and digits, lower-cased; all else is one blank. An
item of m characters may be found with up to floor(rate * m) edits. It is cut into one piece
more than that, so that every such occurrence holds one of the pieces unchanged. An
Aho-Corasick automaton finds all pieces of all items in one pass over a text; around each hit
Myers' bit-parallel algorithm computes the least edit distance of the whole item.

The items go to all tasks, so their size is checked first: those of a large benchmark are cut
in parts of bounded size, each searched in a pass of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.llm import shared
from harvestry.llm import text as T

MOST_CHARACTERS = 2_000_000  # of the items that a pass searches for; their automaton takes some hundred bytes for each
BLANK = 32


@lru_cache(1)
def _normal() -> np.ndarray:
    out = np.full(0x110000, BLANK, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalnum():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def normalised(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised code points of texts, their offsets, and the place that each one had."""
    out = _normal()[points]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != BLANK) | (out[:-1] != BLANK)
    starts = offsets[:-1][offsets[:-1] < len(out)]
    keep[starts] = True
    place = np.flatnonzero(keep)
    return out[place], np.searchsorted(place, offsets), place


def normalise(text: str | None) -> str:
    points = np.array([ord(c) for c in text or ""], np.uint32)
    return normalised(points, np.array([0, len(points)]))[0].tobytes().decode("utf-32-le").strip()


def distance(pattern: str, text: str) -> tuple[int, int]:
    """The least edit distance of the pattern to a part of the text, and where the first such part ends (Myers, bit-parallel)."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return _distance(masks, m, text)


def _distance(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """Finds items in normalised texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = []
        self.automaton = ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, raw in items:
            text = normalise(raw)
            if not text:
                continue
            m = len(text)
            edits = min(int(rate * m), m - 1)
            masks: dict[str, int] = {}
            for i, c in enumerate(text):
                masks[c] = masks.get(c, 0) | 1 << i
            cuts = [m * i // (edits + 1) for i in range(edits + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                pieces.setdefault(text[a:b], []).append((len(self.items), a))
            self.items.append((item_id, m, edits, masks))
        for piece, at in pieces.items():
            self.automaton.add_word(piece, (len(piece), at))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Text, item id, end of the part found, its edits: the best occurrence of each item in each text."""
        if not self.items:
            return
        ends = offsets.tolist()
        doc, seen, best = 0, {}, {}
        for last, (n, owners) in self.automaton.iter(text):
            start = last + 1 - n
            while last >= ends[doc + 1]:
                yield from ((doc, i, *x[::-1]) for i, x in best.items())
                doc, seen, best = doc + 1, {}, {}
            if start < ends[doc]:
                continue  # it began in the text before
            for k, at in owners:
                item_id, m, edits, masks = self.items[k]
                where = start - at
                if best.get(item_id, (edits + 1,))[0] == 0:
                    continue
                near = seen.get(k)
                if near is not None and abs(near - where) <= edits:
                    continue  # the window looked at before holds this one's
                seen[k] = where
                lo, hi = max(ends[doc], where - 2 * edits), min(ends[doc + 1], where + m + 2 * edits)
                if hi - lo < m - edits:
                    continue
                d, end = _distance(masks, m, text[lo:hi])
                if d <= edits and d < best.get(item_id, (edits + 1,))[0]:
                    best[item_id] = (d, lo + end)
        yield from ((doc, i, *x[::-1]) for i, x in best.items())


def _parts(docs: DataFrame, benchmark: DataFrame, item_col: str, text_col: str) -> list[Broadcast]:
    """The distinct items in parts of about MOST_CHARACTERS at most; those of one id are in the same part."""
    items = benchmark.select(benchmark[item_col].cast("long").alias("item"), benchmark[text_col].cast("string").alias("words")).distinct()
    size = items.agg(F.sum(F.length("words"))).first()[0] or 0
    parts = max(1, -(-size // MOST_CHARACTERS))
    found = []
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == k).collect()
        found.append(docs.sparkSession.sparkContext.broadcast(sorted(((r["item"], r["words"]) for r in rows), key=str)))
    return found


def _matcher(held: Broadcast, rate: float) -> Matcher:
    """A worker's automaton."""
    return shared.kept(("matcher", tuple(held.value), rate), lambda: Matcher(held.value, rate))


def _hits(matcher: Matcher, data: np.ndarray, offsets: np.ndarray) -> tuple[list[tuple[int, int, int, int]], np.ndarray]:
    """What Matcher.find gives for a chunk, and the end of each part found in its own text."""
    points, at = T.code_points(data, offsets)
    plain, plain_at, place = normalised(points, at)
    hits = list(matcher.find(plain.tobytes().decode("utf-32-le"), plain_at))
    if not hits:
        return hits, np.zeros(0, np.int64)
    return hits, place[np.array([h[2] for h in hits]) - 1] + 1 - at[[h[0] for h in hits]]


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, end, edits: each item found in each text, at its best place (the first of equals).

    end is the number of characters before the end of the part found. Null and empty texts and items hold and match nothing. Rows with
    null ids are searched like others; repeated rows are found again; repeated items of one id count once, by their best place.
    """
    texts = shared.texts_of(docs, id_col, text_col)

    def found(held: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(held, rate)
            for batch in batches:
                for a, _, data, offsets in T.chunks(batch.column(1)):
                    hits, ends = _hits(matcher, data, offsets)
                    doc = batch.column(0).take(pa.array([a + h[0] for h in hits], pa.int64()))
                    yield pa.RecordBatch.from_arrays([doc, pa.array([h[1] for h in hits], pa.int64()), pa.array(ends, pa.int64()), pa.array([h[3] for h in hits], pa.int32())], ["doc_id", "item_id", "end", "edits"])

        return texts.mapInArrow(run, "doc_id long, item_id long, end long, edits int")

    return reduce(DataFrame.unionAll, map(found, _parts(docs, benchmark, item_col, item_text_col)))


def clean_documents(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents in which no item is found, all columns as they are; in one pass for each part of the items, without a shuffle."""
    at = docs.columns.index(text_col)

    def clean(rows: DataFrame, held: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(held, rate)
            for batch in batches:
                for a, b, data, offsets in T.chunks(batch.column(at)):
                    keep = np.ones(b - a, bool)
                    keep[[h[0] for h in _hits(matcher, data, offsets)[0]]] = False
                    yield batch.slice(a, b - a).filter(pa.array(keep))

        return rows.mapInArrow(run, docs.schema)

    return reduce(clean, _parts(docs, benchmark, item_col, item_text_col), docs)
