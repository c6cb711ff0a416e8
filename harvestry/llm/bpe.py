"""BPE encoding by backtracking, and decoding by an offset table.

Encoding: an Aho-Corasick automaton over the vocabulary finds all tokens in a
pre-token in one pass. From the left the longest token is taken at each position
if its pair with the token before is compatible, i.e. if merging both tokens'
bytes together would again give just these two; else shorter tokens are tried, and
then the token before is given up. Each position is given up at most once, so the
time is linear in the text, and the result is that of the merges in rank order.

Decoding: all tokens' bytes lie in one table; a token's offset and length give its
part, so that a chunk of ids is decoded by one gather.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from harvestry.llm import shared
from harvestry.llm import text as T
from harvestry.llm.pretokens import PretokenCache

PAIRS = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary, from its rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class BytePairEncoder:
    """The merges of a tokenizers file, as backtracking needs them. Pre-tokens are given as Latin-1 strings of their bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        spell = lambda piece: "".join(chr(alphabet[c]) for c in piece)
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_id = next(iter(special.values()))
        self.tokens = {spell(k): i for k, i in model["vocab"].items() if k not in special}
        self.by_id = {i: k for k, i in self.tokens.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.order: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = (spell(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            pair, whole = (self.tokens[left], self.tokens[right]), self.tokens[left + right]
            if whole not in self.halves:
                self.rank[pair], self.halves[whole], self.order[whole] = whole, pair, rank
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.tokens.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.shorter = {i: next((self.tokens[k[:n]] for n in range(len(k) - 1, 0, -1) if k[:n] in self.tokens), None) for i, k in self.by_id.items()}
        self.compatible: dict[tuple[int, int], bool] = {}
        n = max([*self.by_id, self.special_id]) + 1
        pieces = [self.by_id.get(i, "").encode("latin-1") for i in range(n)]
        for content, i in special.items():
            pieces[i] = content.encode()
        self.sizes = [len(x) for x in pieces]
        self.length = np.array(self.sizes, np.int64)
        self.offset = np.cumsum(self.length) - self.length
        self.table = np.frombuffer(b"".join(pieces), np.uint8)

    def pair_holds(self, left: int, right: int) -> bool:
        """Whether the merges keep a boundary between the two tokens; kept in a bounded table."""
        key = (left, right)
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) >= PAIRS:
                self.compatible.clear()
            known = self.compatible[key] = self._pair_holds(left, right)
        return known

    def _pair_holds(self, left: int, right: int) -> bool:
        # Undo merges on both sides of the boundary, the latest first. A merge across it
        # that comes before the next one to be undone would have been made instead.
        order, inf = self.order, 1 << 60
        limit = (inf, 0)
        while True:
            across = self.rank.get((left, right))
            if across is not None and (order[across], 0) < limit:
                return False
            of_left, of_right = order.get(left, -1), order.get(right, -1)
            if of_left < 0 and of_right < 0:
                return True
            if of_left > of_right:
                limit, left = (of_left, 0), self.halves[left][1]
            else:
                # Of equal merges the left one is made first, so one across may tie with the right half's.
                limit, right = (of_right, 1), self.halves[right][0]

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of pre-tokens, and the number of each one's ids."""
        raw = [p.encode().decode("latin-1") for p in parts]
        longest = [[-1] * len(r) for r in raw]
        start, which, row, base, size = 0, -1, [], 0, 0
        bounds = iter(enumerate(raw))
        # One pass of the automaton over all parts; the separator lies outside the byte alphabet.
        for end, (n, token) in self.automaton.iter("Ā".join(raw)):
            while end >= base + size:
                which, part = next(bounds)
                base, size, row = start, len(part), longest[which]
                start += size + 1
            row[end - n + 1 - base] = token  # matches at one start come in growing length
        found = [self._backtrack(len(r), first) for r, first in zip(raw, longest, strict=True)]
        return np.array([i for x in found for i in x], np.int32), np.array([len(x) for x in found], np.int64)

    def _backtrack(self, n: int, longest: list[int]) -> list[int]:
        if n and self.sizes[longest[0]] == n:
            # A whole token: its own merges give it, unless the vocabulary holds it without them.
            if longest[0] in self.halves or n == 1:
                return [longest[0]]
        size, shorter, holds = self.sizes, self.shorter, self.pair_holds
        out: list[int] = []
        open_ = bytearray(b"\1") * (n + 1)
        at, token = 0, longest[0] if n else None
        while token is not None:
            last = out[-1] if out else None
            while True:
                end = at + size[token]
                if open_[end] and (last is None or holds(last, token)):
                    out.append(token)
                    at = end
                    token = longest[at] if at < n else None
                    break
                less = shorter[token]
                if less is not None:
                    token = less
                    continue
                open_[at] = 0
                out.pop()
                at -= size[last]
                token = last
                break
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids."""
        return T.gather(self.table, self.offset[ids], self.length[ids])


def encoder(path: str) -> tuple[BytePairEncoder, PretokenCache]:
    """A worker's encoder and its cache of pre-tokens."""

    def make() -> tuple[BytePairEncoder, PretokenCache]:
        bpe = BytePairEncoder(path)
        return bpe, PretokenCache(bpe.encode, bpe.special_id)

    return shared.kept(("bpe", path), make)


@lru_cache(2)
def decimals(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An offset table of the numbers below n, each followed by a comma."""
    pieces = [f"{i},".encode() for i in range(n)]
    length = np.array([len(x) for x in pieces], np.int64)
    return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(length) - length, length


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded: every text encoded as the tokenizers library does, and decoded again.

    A null or empty text has no ids and decodes to an empty text; a null doc_id stays null; repeated rows stay.
    The string of a special token inside a text becomes its id, as is the library's default.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache = encoder(tokenizer)
        for batch in batches:
            for a, b, data, offsets in T.chunks(batch.column(1)):
                ids, before = cache.encode_texts((a, b, data, offsets))
                cuts = np.concatenate([[0], np.cumsum(bpe.length[ids])])[before]
                lists = pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(ids, pa.int32()))
                decoded = bpe.decode(ids).tobytes()
                texts = pa.array([decoded[i:j].decode("utf-8", "replace") for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists, texts], ["doc_id", "ids", "decoded"])

    kept = shared.texts_of(docs, id_col, text_col)
    return kept.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what encode_documents gives, digested beside it in the same tasks.

    Nulls, empty texts, special strings and repeated rows are treated as there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache = encoder(tokenizer)
        table, offset, length = decimals(len(bpe.length))
        for batch in batches:
            for a, b, data, offsets in T.chunks(batch.column(1)):
                ids, before = cache.encode_texts((a, b, data, offsets))
                texts, listed = bpe.decode(ids).tobytes(), T.gather(table, offset[ids], length[ids]).tobytes()
                digests = []
                for content, sizes, tail in ((listed, length, 1), (texts, bpe.length, 0)):
                    cuts = np.concatenate([[0], np.cumsum(sizes[ids])])[before].tolist()
                    # UTF-8 of the decoded text: only a text that isn't whole characters needs replacement marks
                    whole = tail or _is_utf8(content)
                    parts = (content[i : max(i, j - tail)] for i, j in zip(cuts[:-1], cuts[1:], strict=True))
                    digests.append(pa.array([hashlib.sha256(x if whole else x.decode("utf-8", "replace").encode()).hexdigest() for x in parts], pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(before), pa.int64()), *digests], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kept = shared.texts_of(docs, id_col, text_col)
    return kept.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _is_utf8(content: bytes) -> bool:
    try:
        content.decode()
    except UnicodeDecodeError:
        return False
    return True
