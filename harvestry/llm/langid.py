"""Language identification by nearest centroids.

A text's vector counts its letters' n-grams of one to three characters (words are lower-cased
and have blanks around them), hashed to a fixed number of dimensions, as (1 + log tf) * idf,
normalised. Each language has several centroids, found by spherical k-means. A text takes the
language of the centroid with the greatest cosine; one that is far from all is rejected. What
is far depends on the text's letters, as short texts of a language have lower cosines than long ones.

Fitting takes a bounded sample of labelled rows for each language (`per_language`), drawn by a
hash of the identifier; prediction reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.llm import shared
from harvestry.llm import text as T

DIMENSIONS = 1 << 12
UNKNOWN = "und"
#: Sample rows from which the cosines usual at a length are taken, and the part of them that may lie below (junk among the sample).
SIMILAR, BELOW = 40, 0.05


@dataclass
class Centroids:
    """idf of each dimension, unit centroids and the language of each, and each language's least cosines: log of letters, ascending, and the cosine there."""

    idf: np.ndarray
    centres: np.ndarray
    languages: list[str]
    least: dict[str, tuple[np.ndarray, np.ndarray]]


@lru_cache(1)
def _lower() -> np.ndarray:
    """Letters lower-cased; 0 for what isn't a letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in np.flatnonzero(T.classes() == T.LETTER).tolist():
        low = chr(c).lower()
        out[c] = ord(low) if len(low) == 1 else c
    return out


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """1 + log of the counts in each dimension (0: none) for each text, and its number of letters."""
    points, at = T.code_points(data, offsets)
    n = len(at) - 1
    # A blank before and after each text, none twice in a row.
    spaced = np.insert(_lower()[points], at[:-1], 0)
    text = np.repeat(np.arange(n), np.diff(at) + 1)
    keep = np.ones(len(spaced), bool)
    keep[1:] = (spaced[1:] != 0) | (spaced[:-1] != 0)
    keep[at[:-1] + np.arange(n)] = True
    spaced, text = spaced[keep].astype(np.uint64), text[keep]
    letters = np.bincount(text[spaced > 0], minlength=n)
    spaced = np.append(spaced, np.zeros(2, np.uint64))
    m = len(text)
    one, two, three = spaced[:m], spaced[1 : m + 1], spaced[2 : m + 2]
    last = np.append(np.flatnonzero(np.diff(text)), m - 1) if m else np.zeros(0, np.int64)
    two[last[last < len(two)]] = 0  # an n-gram stops at its text's end
    cells = np.zeros(n * DIMENSIONS, np.int64)
    mask = np.uint64(DIMENSIONS - 1)
    base = (text * DIMENSIONS).astype(np.int64)
    pair = one * np.uint64(0x110000) + two
    for k, gram, good in ((1, one, one > 0), (2, pair, (one > 0) | (two > 0)), (3, pair * np.uint64(0x110000) + three, two > 0)):
        slot = (T.mix(gram[good] * np.uint64(4) + np.uint64(k)) & mask).astype(np.int64)
        cells += np.bincount(base[good] + slot, minlength=len(cells))
    out = np.zeros(len(cells), np.float32)
    some = cells > 0
    out[some] = 1 + np.log(cells[some])
    return out.reshape(n, DIMENSIONS), letters


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def cluster(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means of unit rows, started from rows far from each other; always the same for the same rows."""
    centres = [x.mean(axis=0)]
    for _ in range(1, min(k, len(x))):
        near = np.max(x @ unit(np.array(centres)).T, axis=1)
        centres.append(x[int(np.argmin(near))])
    centres = unit(np.array(centres))
    for _ in range(rounds):
        best = np.argmax(x @ centres.T, axis=1)
        centres = unit(np.array([x[best == j].mean(axis=0) if (best == j).any() else centres[j] for j in range(len(centres))]))
    return centres


def left_out(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Greatest cosine of each unit row with the centroids as they are without that row; 0 if nothing is left."""
    cosine = x @ centres.T
    best = np.argmax(cosine, axis=1)
    total = np.array([x[best == j].sum(axis=0) for j in range(len(centres))])
    rest = total[best] - x
    size = np.linalg.norm(rest, axis=1)
    own = np.where(size > 1e-3, (x * rest).sum(axis=1) / np.maximum(size, 1e-3), 0)
    cosine[np.arange(len(x)), best] = own
    return np.maximum(cosine.max(axis=1), 0)


def usual(letters: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of letters, ascending, and a low quantile of the cosines of sample rows of about so many letters."""
    order = np.argsort(letters, kind="stable")
    runs = np.array_split(order, max(1, len(order) // SIMILAR)) if len(order) else []
    return np.array([np.log(np.median(letters[r])) for r in runs]), np.array([np.quantile(cosine[r], BELOW) for r in runs])


def least_cosine(letters: np.ndarray, at: np.ndarray, cosine: np.ndarray) -> np.ndarray:
    """Cosine that texts of so many letters need: between two lengths in proportion, and for shorter texts than the first less by the root of the letters' ratio."""
    if not len(at):
        return np.zeros(len(letters))
    log = np.log(np.maximum(letters, 1))
    return np.interp(log, at, cosine) * np.exp(np.minimum(log - at[0], 0) / 2)


def fit(labelled: DataFrame, per_language: int = 400, centroids: int = 3, margin: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Centroids:
    """Learns from at most about per_language rows of each language with letters in their texts; null languages and texts are left out.

    Rows are drawn by a hash of identifier and text, and of rows alike in both one counts: repeated or null identifiers
    neither take a language's sample away nor make it large.

    margin: a text is rejected if its cosine is below this part of what the language's own sample rows of similar length have, but for BELOW of them.
    """
    rows = labelled.where(labelled[lang_col].isNotNull() & labelled[text_col].isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col).cast("string")).count().collect()}  # a row for each language
    if not counts:
        return Centroids(np.ones(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), [], {})
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))))
    key = F.xxhash64(rows[id_col].cast("long"), rows[text_col].cast("string"), F.lit(11))
    drawn = F.pmod(key, F.lit(1 << 20)) < share[rows[lang_col].cast("string")] * (1 << 20)
    sample = shared.texts_of(rows.where(drawn), id_col, text_col, rows[lang_col].cast("string").alias("lang"), key.alias("key")).dropDuplicates(["lang", "key"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in T.chunks(batch.column(1), 1 << 18):
                x, letters = features(data, offsets)
                good = np.flatnonzero(letters)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(good)), batch.column(2).slice(a, b - a).take(pa.array(good)), batch.column(3).slice(a, b - a).take(pa.array(good)), pa.array(letters[good]), pa.array([v.tobytes() for v in x[good]], pa.binary())], ["doc_id", "lang", "key", "letters", "x"])

    held = shared.materialise(sample.mapInArrow(vectors, "doc_id long, lang string, key long, letters long, x binary"), "vectors")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer(), np.float32) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()], pa.list_(pa.int64()))], ["n", "df"])

    parts = held.select("x").mapInArrow(seen, "n long, df array<long>").collect()
    n, df = sum(p["n"] for p in parts), sum((np.array(p["df"], np.int64) for p in parts), np.zeros(DIMENSIONS, np.int64))
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    def centre(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "key"], kind="stable", na_position="first")
        x = unit(np.array([np.frombuffer(v, np.float32) for v in group["x"]]) * idf)
        c = cluster(x, centroids).astype(np.float32)
        at, least = usual(group["letters"].to_numpy(), left_out(x, c))
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centre": [v.tobytes() for v in c], "at": [at.tolist()] * len(c), "least": [least.tolist()] * len(c)})

    found = sorted(held.groupBy("lang").applyInPandas(centre, "lang string, centre binary, at array<double>, least array<double>").collect(), key=lambda r: (r["lang"], r["centre"]))
    least = {r["lang"]: (np.array(r["at"]), margin * np.array(r["least"])) for r in found}
    return Centroids(idf, np.array([np.frombuffer(r["centre"], np.float32) for r in found]).reshape(-1, DIMENSIONS), [r["lang"] for r in found], least)


def _judged(model: Centroids, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and whether it is rejected of each text of a chunk."""
    x, letters = features(data, offsets)
    n = len(letters)
    none = (letters == 0) | (len(model.languages) == 0)
    best, score, rejected = np.full(n, len(model.languages)), np.zeros(n), none.copy()
    if len(model.languages):
        x *= model.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        cosine = x @ model.centres.T
        best = np.where(none, best, np.argmax(cosine, axis=1))
        score = np.where(none, 0, np.clip(np.max(cosine, axis=1), 0, 1)).astype(np.float64)
    language = np.array([*model.languages, UNKNOWN], object)[best]
    for lang, known in model.least.items():
        rejected |= (language == lang) & (score < least_cosine(letters, *known))
    return language, score, rejected


def predict(docs: DataFrame, model: Centroids, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (cosine, 0 to 1), rejected of every row.

    A text that is null or has no letter is `und` with score 0 and rejected. One that is too far from the
    nearest centroid is rejected as well, with that centroid's language. Without a centroid all are `und`.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in T.chunks(batch.column(1), 1 << 18):
                language, score, rejected = _judged(held.value, data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(language, pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    return shared.texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(col):
    """Whether the crc32 of an identifier as text leaves 1 modulo 3; a null one is never held out."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the rows that aren't held out and predicts all: doc_id, held_out, lang_pred, score, rejected."""
    model = fit(docs.where(~held_out(F.col(id_col))), id_col=id_col, text_col=text_col, lang_col=lang_col)
    return predict(docs, model, id_col, text_col).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that aren't rejected, all columns as they are; in one pass, without a shuffle."""
    model = fit(docs.where(~held_out(F.col(id_col))), id_col=id_col, text_col=text_col, lang_col=lang_col)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in T.chunks(batch.column(at), 1 << 18):
                yield batch.slice(a, b - a).filter(pa.array(~_judged(held.value, data, offsets)[2]))

    return docs.mapInArrow(run, docs.schema)
