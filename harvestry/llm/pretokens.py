"""Token ids of whole texts through caches of pre-tokens in the workers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from harvestry.llm import text as T

CACHED = 400_000
SPECIAL = "<|endoftext|>"


class PretokenCache:
    """Maps pre-tokens, told apart by 64-bit hashes, to token ids.

    encode: gives all ids of a list of pre-tokens and the number of each one's ids; called
    once for those of a chunk that aren't cached. A full cache is emptied, so a worker's memory is bounded.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], special_id: int, size: int = CACHED):
        self.encode, self.special_id, self.size = encode, special_id, size
        self.known: dict[int, int] = {}
        self.reset()

    def reset(self) -> None:
        self.known.clear()
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.at, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    def _grown(self, array: np.ndarray, n: int) -> np.ndarray:
        return array if n <= len(array) else np.concatenate([array, np.zeros(max(n - len(array), len(array)), array.dtype)])

    def slots(self, hashes: np.ndarray, spell: Callable[[int], str]) -> np.ndarray:
        """The slot of each of distinct hashes; spell(i) is the i-th pre-token."""
        if len(self.known) + len(hashes) > self.size:
            self.reset()
        get = self.known.get
        slots = np.array([get(h, -1) for h in hashes.tolist()], np.int64)
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            first = len(self.known)
            flat, counts = self.encode([spell(i) for i in missing.tolist()])
            self.ids = self._grown(self.ids, self.used + len(flat))
            self.ids[self.used : self.used + len(flat)] = flat
            self.at, self.length = self._grown(self.at, first + len(missing)), self._grown(self.length, first + len(missing))
            self.at[first : first + len(missing)] = self.used + np.cumsum(counts) - counts
            self.length[first : first + len(missing)] = counts
            self.used += len(flat)
            slots[missing] = np.arange(first, first + len(missing))
            self.known.update(zip(hashes[missing].tolist(), slots[missing].tolist(), strict=True))
        return slots

    def starts(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the pre-tokens of texts that begin at `at` begin."""
        return T.pretoken_starts(points, at)

    def encode_chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a chunk, and the number of ids before each text."""
        points, at = T.code_points(data, offsets)
        starts = self.starts(points, at)
        hashes, index, inverse = np.unique(T.span_hashes(points, starts), return_index=True, return_inverse=True)
        ends = np.append(starts[1:], len(points))
        spell = lambda i: points[starts[index[i]] : ends[index[i]]].tobytes().decode("utf-32-le")
        slots = self.slots(hashes, spell)[inverse]
        lengths = self.length[slots].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(lengths)])
        return T.gather(self.ids, self.at[slots], lengths), total[np.searchsorted(starts, at)]

    def encode_texts(self, rows: tuple[int, int, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """As encode_chunk; texts with a special token's string are cut there, and its id is put between the parts."""
        a, b, data, offsets = rows
        if SPECIAL.encode() not in data.tobytes():
            return self.encode_chunk(data, offsets)
        parts, before = [], [0]
        for i in range(b - a):
            n = 0
            for k, part in enumerate(data[offsets[i] : offsets[i + 1]].tobytes().split(SPECIAL.encode())):
                if k:
                    parts.append(np.array([self.special_id], np.int32))
                    n += 1
                if part:
                    ids, _ = self.encode_chunk(np.frombuffer(part, np.uint8), np.array([0, len(part)]))
                    parts.append(ids)
                    n += len(ids)
            before.append(before[-1] + n)
        return np.concatenate([np.zeros(0, np.int32), *parts]), np.array(before)


def library_encoder(path: str) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Encodes pre-tokens with the tokenizers library.

    A line feed between two pre-tokens never joins with either, so that many go into one
    call as lines of a text; those of white space go alone.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    feed = tokenizer.encode("\n", add_special_tokens=False).ids
    assert len(feed) == 1

    def encode(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        blank = [i for i, p in enumerate(parts) if p.isspace()]
        lines = [p for p in parts if not p.isspace()]
        texts = ["".join(p + "\n" for p in lines[i : i + 500]) for i in range(0, len(lines), 500)]
        flat = np.array([i for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False) for i in x.ids], np.int32)
        ends = np.flatnonzero(flat == feed[0])
        assert len(ends) == len(lines)
        counts = np.diff(ends, prepend=-1) - 1
        flat = np.delete(flat, ends)
        if blank:
            found = [x.ids for x in tokenizer.encode_batch_fast([parts[i] for i in blank], add_special_tokens=False)]
            at = np.array(blank) - np.arange(len(blank))  # of the lines before each
            before = np.concatenate([[0], np.cumsum(counts)])[at]
            flat = np.insert(flat, np.repeat(before, [len(x) for x in found]), [i for x in found for i in x])
            counts = np.insert(counts, at, [len(x) for x in found])
        return flat.astype(np.int32), counts

    return encode
