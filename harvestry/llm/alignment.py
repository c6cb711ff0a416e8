"""Aligning the tokens of two tokenizers by the bytes that they cover.

Token ends are bits in packed bitsets, one bit for each byte. The AND of both sets
has the shared cuts, which part the tokens into groups. The OR has the ends of all
overlaps: each stretch between its bits lies in one token of either side, so each
bit is one link. Ranks by popcount map a bit to tokens, selects list the bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.llm import shared
from harvestry.llm import text as T
from harvestry.llm.bpe import byte_alphabet, decimals
from harvestry.llm.pretokens import PretokenCache, library_encoder

META = "▁"  # a blank in the second tokenizer's pieces
HELD = 1 << 19  # frequent pairs that all tasks hold, 9 MB
GATHERED = 1 << 21  # pairs that a task gathers before it hands them on


class Bits:
    """A packed bitset over a chunk's bytes, with the number of bits before each of its 64-bit words."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @staticmethod
    def of(at: np.ndarray, n: int) -> Bits:
        marks = np.zeros(-(-n // 64) * 64, np.uint8)
        marks[at] = 1
        return Bits(np.packbits(marks, bitorder="little").view(np.uint64))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def __or__(self, other: Bits) -> Bits:
        return Bits(self.words | other.words)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The number of bits below each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        inside = np.append(self.words, np.uint64(0))[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(inside)

    def select(self) -> np.ndarray:
        """The places of all bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


class PieceCache(PretokenCache):
    """The ids of a sentencepiece model without pieces that go on after a blank: each word with the blanks before it is encoded by itself."""

    def starts(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        blank = points == 32
        first = blank.copy()
        first[1:] &= ~blank[:-1]
        edges = at[at < len(points)]
        first[edges] = True
        return np.flatnonzero(first)


def _piece_encoder(path: str):
    """The model's ids of words that begin with a blank, which the model puts before a text by itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    blank = [model.piece_to_id(META)]  # nothing is put before an empty text

    def encode(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x or blank for x in model.encode([p[1:] for p in parts], num_threads=1)]
        return np.array([i for x in found for i in x], np.int32), np.array([len(x) for x in found], np.int64)

    return model, encode


class Side:
    """A tokenizer's cache and its tokens' bytes: a table with offsets."""

    def __init__(self, cache: PretokenCache, pieces: list[bytes]):
        self.cache = cache
        self.length = np.array([len(p) for p in pieces], np.int64)
        self.offset = np.cumsum(self.length) - self.length
        self.table = np.frombuffer(b"".join(pieces), np.uint8)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        return np.cumsum(self.length[ids])

    def spells(self, ids: np.ndarray, data: np.ndarray) -> bool:
        return int(self.length[ids].sum()) == len(data) and np.array_equal(T.gather(self.table, self.offset[ids], self.length[ids]), data)


def byte_side(path: str) -> Side:
    from tokenizers import Tokenizer

    tokenizer, alphabet = Tokenizer.from_file(path), byte_alphabet()
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    pieces = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        pieces[i] = bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else piece.encode()
    return Side(PretokenCache(library_encoder(path), 0), pieces)


def piece_side(path: str) -> Side:
    model, encode = _piece_encoder(path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    inner = [p for p in names if META in p.lstrip(META)]
    if inner:
        raise ValueError(f"pieces with a blank after other characters: {inner[:3]}")
    pieces = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else p.replace(META, " ").encode() for i, p in enumerate(names)]
    return Side(PieceCache(encode, 0), pieces)


def _sides(a: str, b: str) -> tuple[Side, Side]:
    return shared.kept(("alignment", a, b), lambda: (byte_side(a), piece_side(b)))


def spaced(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept texts of a chunk, each after a blank, and their offsets."""
    size = np.diff(offsets)[keep]
    ends = np.cumsum(size + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    out[np.repeat(ends - np.cumsum(size), size) + np.arange(size.sum())] = T.gather(data, offsets[:-1][keep], size)
    return out, np.concatenate([[0], ends])


class Aligned:
    """The tokens of a chunk's texts that both tokenizers spell: ids, shared cuts and links."""

    def __init__(self, a: Side, b: Side, data: np.ndarray, offsets: np.ndarray):
        self.offsets = offsets
        (self.a, a_before), (self.b, b_before) = a.cache.encode_chunk(data, offsets), b.cache.encode_chunk(data, offsets)
        self.spelled = np.ones(len(offsets) - 1, bool)
        if not (a.spells(self.a, data) and b.spells(self.b, data)):
            for i in range(len(offsets) - 1):
                part = data[offsets[i] : offsets[i + 1]]
                self.spelled[i] = a.spells(self.a[a_before[i] : a_before[i + 1]], part) and b.spells(self.b[b_before[i] : b_before[i + 1]], part)
            return
        n = len(data)
        ends_a, ends_b = a.ends(self.a), b.ends(self.b)
        bits_a, bits_b = Bits.of(ends_a - 1, n), Bits.of(ends_b - 1, n)
        both, either = bits_a & bits_b, bits_a | bits_b
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.diff(x.rank(offsets)) for x in (bits_a, bits_b, both, either))
        self.cuts = both.select()
        self.group_a, self.group_b = bits_a.rank(self.cuts + 1), bits_b.rank(self.cuts + 1)
        links = either.select()
        self.link_a, self.link_b = bits_a.rank(links), bits_b.rank(links)
        self.link_text = np.repeat(np.arange(len(offsets) - 1), self.n_links)

    def digests(self, n_ids: int) -> list[str]:
        """Of each text the SHA-256 of its groups, `a1,a2|b1;a3|b2,b3`."""
        if not len(self.cuts):
            return []
        table, offset, length = decimals(n_ids)
        per_a, per_b = np.diff(self.group_a, prepend=0), np.diff(self.group_b, prepend=0)
        # where each token stands when every group's A tokens are followed by its B tokens
        at_a = np.arange(len(self.a)) + np.repeat(self.group_b - per_b, per_a)
        at_b = np.arange(len(self.b)) + np.repeat(self.group_a, per_b)
        ids = np.empty(len(self.a) + len(self.b), np.int64)
        ids[at_a], ids[at_b] = self.a, self.b
        size = length[ids]
        ends = np.cumsum(size)
        content = T.gather(table, offset[ids], size)
        content[ends[self.group_a + self.group_b - per_b - 1] - 1] = ord("|")
        last = ends[self.group_a + self.group_b - 1]
        content[last - 1] = ord(";")
        of_text = np.concatenate([[0], np.cumsum(self.n_groups)])
        cuts = np.concatenate([[0], last])[of_text]
        content = content.tobytes()
        return [hashlib.sha256(content[i : j - 1]).hexdigest() for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def align_chunk(a: Side, b: Side, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Aligned]:
    """The rows of a chunk with tokens, and their alignment. Texts that a tokenizer doesn't give back byte by byte have none."""
    rows = np.flatnonzero(np.diff(offsets) > 0)
    found = Aligned(a, b, *spaced(data, offsets, rows))
    if not found.spelled.all():
        rows = rows[found.spelled]
        found = Aligned(a, b, *spaced(data, offsets, rows))
    return rows, found


def align(docs: DataFrame, byte_tokenizer: str, piece_tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, groups array<struct<a array<int>, b array<int>>>, links array<struct<a int, b int>>: each text's groups of tokens, and its links as places in its tokens.

    Both tokenizers read the text after a blank, special strings as plain text. A null or empty text, or one that either
    tokenizer doesn't give back byte by byte, has no groups and no links; a null identifier stays; repeated rows stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _sides(byte_tokenizer, piece_tokenizer)
        for batch in batches:
            for i, j, data, offsets in T.chunks(batch.column(1)):
                rows, found = align_chunk(a, b, data, offsets)
                lists = lambda ids, upto: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], upto]), pa.int32()), pa.array(ids, pa.int32()))
                groups = pa.StructArray.from_arrays([lists(found.a, found.group_a), lists(found.b, found.group_b)], ["a", "b"])
                n = {k: np.zeros(j - i, np.int64) for k in ("groups", "links", "a", "b")}
                for k, x in zip(n, (found.n_groups, found.n_links, found.n_a, found.n_b), strict=True):
                    n[k][rows] = x
                first = [np.concatenate([[0], np.cumsum(x)[:-1]])[found.link_text] if len(x) else np.zeros(0, np.int64) for x in (found.n_a, found.n_b)]
                links = pa.StructArray.from_arrays([pa.array(x - y, pa.int32()) for x, y in zip((found.link_a, found.link_b), first, strict=True)], ["a", "b"])
                upto = lambda x: pa.array(np.concatenate([[0], np.cumsum(x)]), pa.int32())
                columns = [pa.ListArray.from_arrays(upto(n["groups"]), groups), pa.ListArray.from_arrays(upto(n["links"]), links)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], ["doc_id", "groups", "links"])

    return shared.texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, groups array<struct<a: array<int>, b: array<int>>>, links array<struct<a: int, b: int>>")


def encoded(docs: DataFrame, byte_tokenizer: str, piece_tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the text's distinct linked pairs of ids: pairs, times (binary, sorted, little-endian 64 and 32 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _sides(byte_tokenizer, piece_tokenizer)
        ids_a, ids_b = len(a.length), len(b.length)
        for batch in batches:
            for i, j, data, offsets in T.chunks(batch.column(1)):
                rows, found = align_chunk(a, b, data, offsets)
                numbers = np.zeros((4, j - i), np.int64)
                numbers[:, rows] = [found.n_a, found.n_b, found.n_groups, found.n_links]
                digests, pairs, times = [""] * (j - i), [b""] * (j - i), [b""] * (j - i)
                pair = found.a[found.link_a].astype(np.int64) * ids_b + found.b[found.link_b]
                ends = np.cumsum(found.n_links).tolist()
                for row, digest, k, m in zip(rows.tolist(), found.digests(max(ids_a, ids_b)), [0, *ends], ends, strict=False):
                    keys, n = np.unique(pair[k:m], return_counts=True)
                    digests[row], pairs[row], times[row] = digest, keys.astype("<i8").tobytes(), n.astype("<u4").tobytes()
                columns = [pa.array(x, pa.int64()) for x in numbers] + [pa.array(digests, pa.string()), pa.array(pairs, pa.binary()), pa.array(times, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return shared.texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary")


def pair_counts(texts: DataFrame, ids_b: int) -> DataFrame:
    """a, pair, n (the texts that hold the pair linked), best (n is the highest of its A id). Tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(keys), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + (1 << 17)]), pa.array(counts[k : k + (1 << 17)])], ["pair", "n"])

        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            found = np.frombuffer(b"".join(x for x in batch.column(0).to_pylist() if x), "<i8")
            found, n = np.unique(found, return_counts=True)
            keys, inverse = np.unique(np.concatenate([keys, found]), return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, inverse, np.concatenate([counts, n]))
            counts = sums
            if len(keys) > GATHERED:
                yield from out(keys, counts)
                keys, counts = keys[:0], counts[:0]
        yield from out(keys, counts)

    found = texts.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    found = shared.materialise(found.select((F.col("pair") / ids_b).cast("long").alias("a"), "pair", "n"), "pairs")
    highest = found.groupBy("a").agg(F.max("n").alias("highest"))  # an id's pairs are as many as the other vocabulary at most
    return found.join(highest, "a").select("a", "pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def look_up(texts: DataFrame, counts: DataFrame, held: int = HELD) -> DataFrame:
    """row, n_best, count_sum of each text (row is its number): sums over its links.

    The most frequent pairs lie in a file of bounded size that tasks map. If there are more pairs, the others are joined
    by Spark; none of those is frequent, as the held ones are at least as frequent each.
    """
    spark = texts.sparkSession
    top = counts.orderBy(F.desc("n"), "pair").limit(held + 1).select("pair", "n", "best").toArrow()
    more = len(top) > held
    columns = [top.column(k).to_numpy()[:held] for k in range(3)]
    order = np.argsort(columns[0])
    at = f"{shared.scratch_dir(spark, 'frequent')}/pairs"
    shared.write_arrays(at, dict(zip(("pair", "n", "best"), (x[order].astype(t) for x, t in zip(columns, (np.int64, np.int64, np.uint8), strict=True)), strict=True)))

    def lookup(table: dict, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.searchsorted(table["pair"], pairs)
        hit = place < len(table["pair"])
        hit[hit] = table["pair"][place[hit]] == pairs[hit]
        return place, hit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.kept(("frequent", at), lambda: shared.map_arrays(at))
        for batch in batches:
            pairs, times = (np.frombuffer(b"".join(batch.column(k).to_pylist()), t).astype(np.int64) for k, t in ((1, "<i8"), (2, "<u4")))
            ends = np.cumsum([len(x) // 8 for x in batch.column(1).to_pylist()])
            place, hit = lookup(table, pairs)
            sums = []
            for name in ("best", "n"):
                values = np.zeros(len(pairs), np.int64)
                values[hit] = table[name][place[hit]].astype(np.int64) * times[hit]
                sums.append(np.diff(np.concatenate([[0], np.cumsum(values)])[ends], prepend=0))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums)], ["row", "n_best", "count_sum"])

    def misses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.kept(("frequent", at), lambda: shared.map_arrays(at))
        for batch in batches:
            pairs, times = (np.frombuffer(b"".join(batch.column(k).to_pylist()), t).astype(np.int64) for k, t in ((1, "<i8"), (2, "<u4")))
            rows = np.repeat(batch.column(0).to_numpy(), [len(x) // 8 for x in batch.column(1).to_pylist()])
            missed = ~lookup(table, pairs)[1]
            yield pa.RecordBatch.from_arrays([pa.array(rows[missed]), pa.array(pairs[missed]), pa.array(times[missed])], ["row", "pair", "times"])

    numbered = texts.select("row", "pairs", "times")
    sums = numbered.mapInArrow(run, "row long, n_best long, count_sum long")
    if more:
        rare = numbered.mapInArrow(misses, "row long, pair long, times long").join(counts.select("pair", "n", "best"), "pair")
        rare = rare.select("row", (F.col("best").cast("long") * F.col("times")).alias("n_best"), (F.col("n") * F.col("times")).alias("count_sum"))
        sums = sums.unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return sums


def align_counted(docs: DataFrame, byte_tokenizer: str, piece_tokenizer: str, id_col: str = "doc_id", text_col: str = "text", held: int = HELD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every text.

    n_best counts the links whose pair is in as many texts as the best pair of its A id; count_sum adds up the numbers of
    texts. Texts without tokens (see align) have zeros and an empty digest. Texts are encoded once; what is stored of
    each are its distinct pairs.
    """
    import sentencepiece

    ids_b = sentencepiece.SentencePieceProcessor(model_file=piece_tokenizer).get_piece_size()
    texts = shared.materialise(encoded(docs, byte_tokenizer, piece_tokenizer, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = shared.materialise(pair_counts(texts, ids_b), "counted")
    sums = look_up(texts, counts, held)
    return texts.drop("pairs", "times").join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
