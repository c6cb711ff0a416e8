"""Sorted-string-table shards of token ids.

A shard holds the documents of one range of identifiers, in ascending order:

    block*      entries, each: varints of the key bytes shared with the entry before, of
                those that follow, and of the number of ids; the key's rest; the ids
    index       per block: last key (1 + 8 bytes), offset, size, ids before it
    Bloom       bits over all keys
    footer      FOOTER, at the file's end

A key is a marker byte (0: null, 1: a number) and the identifier as 8 big-endian
bytes with the sign bit flipped, so that the order of bytes is that of numbers. The
first entry of a block shares nothing. Ids take 2 or 4 little-endian bytes.
A lookup reads the footer, asks the Bloom filter, bisects the index, reads one block
(more if a key's rows go on in the next).
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harvestry.llm import shared
from harvestry.llm import text as T
from harvestry.llm.pretokens import PretokenCache, library_encoder

MAGIC = b"HVSST1\0\0"
FOOTER = struct.Struct("<QQQQQQBB6x8s")  # index at, size; Bloom at, size; documents; ids; bytes of an id; hashes of a key; magic
INDEX = struct.Struct(">9sQQQ")
BLOCK_BYTES = 64 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at += 1
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(keys: np.ndarray, bits: int) -> np.ndarray:
    h = T.mix(keys)
    step = T.mix(h) | np.uint64(1)
    return (h[:, None] + step[:, None] * np.arange(BLOOM_HASHES, dtype=np.uint64)) % np.uint64(bits)


def _number(key: bytes) -> int:
    return struct.unpack(">Q", key[1:])[0] ^ (0 if key[0] else (1 << 64) - 1)


class ShardWriter:
    """Writes one shard; keys must come in ascending order."""

    def __init__(self, out, width: int, block_bytes: int = BLOCK_BYTES):
        self.out, self.width, self.block_bytes = out, width, block_bytes
        self.block, self.index, self.keys = bytearray(), [], []
        self.at = self.block_at = self.n_docs = self.n_ids = self.ids_before = 0
        self.last = b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if key < self.last:
            raise ValueError("keys must ascend")
        same = 0
        if self.block:
            while same < 9 and key[same] == self.last[same]:
                same += 1
        self.block += _varint(same) + _varint(9 - same) + _varint(len(ids)) + key[same:]
        self.block += ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        if key != self.last:
            self.keys.append(_number(key))
        self.last = key
        self.n_docs += 1
        self.n_ids += len(ids)
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.out.write(bytes(self.block))
            self.index.append(INDEX.pack(self.last, self.at, len(self.block), self.ids_before))
            self.at += len(self.block)
            self.ids_before = self.n_ids
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index = b"".join(self.index)
        bits = max(64, -(-len(self.keys) * BLOOM_BITS // 64) * 64)
        bloom = np.zeros(bits, bool)
        if self.keys:
            bloom[_bloom_places(np.array(self.keys, np.uint64), bits).ravel().astype(np.int64)] = True
        packed = np.packbits(bloom, bitorder="little").tobytes()
        self.out.write(index)
        self.out.write(packed)
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(packed), self.n_docs, self.n_ids, self.width, BLOOM_HASHES, MAGIC))


class ShardReader:
    """Reads a shard from a file that can seek."""

    def __init__(self, file):
        self.file = file
        size = file.size() if callable(getattr(file, "size", None)) else file.seek(0, 2)
        footer = self._read(size - FOOTER.size, FOOTER.size)
        index_at, index_size, bloom_at, bloom_size, self.n_docs, self.n_ids, width, _, magic = FOOTER.unpack(footer)
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.dtype = "<u2" if width == 2 else "<u4"
        self.blocks = list(INDEX.iter_unpack(self._read(index_at, index_size)))
        self.last_keys = [x[0] for x in self.blocks]
        self.bloom = np.frombuffer(self._read(bloom_at, bloom_size), np.uint8)

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, size, _ = self.blocks[block]
        data, i, key = self._read(at, size), 0, b""
        width = int(self.dtype[2])
        while i < size:
            same, i = _read_varint(data, i)
            rest, i = _read_varint(data, i)
            n, i = _read_varint(data, i)
            key = key[:same] + data[i : i + rest]
            i += rest
            yield key, np.frombuffer(data, self.dtype, n, i)
            i += n * width

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for block in range(len(self.blocks)):
            yield from self.entries(block)

    def may_hold(self, key: bytes) -> bool:
        at = _bloom_places(np.array([_number(key)], np.uint64), len(self.bloom) * 8)[0].astype(np.int64)
        return bool(np.all(self.bloom[at >> 3] >> (at & 7) & 1))

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each row of a document; none if it isn't there."""
        key, found = key_of(doc_id), []
        if not self.blocks or not self.may_hold(key):
            return found
        block = bisect_left(self.last_keys, key)
        while block < len(self.blocks):
            for k, ids in self.entries(block):
                if k > key:
                    return found
                if k == key:
                    found.append(ids)
            block += 1
        return found


def _cache(path: str, special_id: int) -> PretokenCache:
    return shared.kept(("sst", path, special_id), lambda: PretokenCache(library_encoder(path), special_id))


def write_shards(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int, special_id: int = 50256, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text, appends end_id, and writes one shard for each range of identifiers to out_dir, which all executors must share.

    Returns the manifest: shard, path, n_docs, n_ids, ids_before; it is written beside the shards first.
    Null identifiers come first; rows of one identifier are ordered by their texts' hashes and texts; a null text is an empty one.
    A shard is written under another name and then renamed, so a task may be run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, writer, sink = _cache(tokenizer, special_id), None, None
        context = TaskContext.get()
        shard = context.partitionId()
        fs, folder = shared.filesystem(out_dir)
        path, part = f"{folder}/{shard:08d}.sst", f"{folder}/{shard:08d}.{context.taskAttemptId()}.part"
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a, b, data, offsets in T.chunks(batch.column(1)):
                if writer is None:
                    sink = fs.open_output_stream(part)
                    writer = ShardWriter(sink, width)
                ids, before = cache.encode_texts((a, b, data, offsets))
                for k, i, j in zip(keys[a:b], before[:-1].tolist(), before[1:].tolist(), strict=True):
                    writer.add(key_of(k), np.append(ids[i:j], end_id))
        if writer is None:
            return
        writer.close()
        sink.close()
        fs.move(part, path)
        yield pa.RecordBatch.from_pylist([{"shard": shard, "path": f"{out_dir}/{shard:08d}.sst", "n_docs": writer.n_docs, "n_ids": writer.n_ids}])

    spark = docs.sparkSession
    kept = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    order = [F.col("doc_id").asc_nulls_first(), tie, F.col("text")]
    rows = kept.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(*order).select("doc_id", "text")
    schema = "shard long, path string, n_docs long, n_ids long"
    rows.mapInArrow(run, schema).write.mode("overwrite").parquet(f"{out_dir}/manifest")
    # One row for each shard, so that a single task may sum them up.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.schema(schema).parquet(f"{out_dir}/manifest").withColumn("ids_before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every entry of the shards in a manifest, read back from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = shared.filesystem(row["path"])
                ids, sizes, sums = [], [], []
                with fs.open_input_file(path) as file:
                    for key, tokens in ShardReader(file).scan():
                        ids.append(id_of(key))
                        sizes.append(len(tokens))
                        sums.append(zlib.crc32(tokens.astype("<u4").tobytes()))
                sizes = np.array(sizes, np.int64)
                start = row["ids_before"] + np.cumsum(sizes) - sizes
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(start), pa.array(sizes), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    dealt = manifest.select("path", "ids_before").repartition(shards)
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, manifest: DataFrame, doc_ids: list[int]) -> DataFrame:
    """doc_id, ids of the given documents, by binary search in each shard whose Bloom filter doesn't exclude them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = shared.filesystem(uri)
                with fs.open_input_file(path) as file:
                    reader = ShardReader(file)
                    found = [(d, ids.astype(np.int32)) for d in doc_ids for ids in reader.lookup(d)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([i for _, i in found], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return manifest.select("path").repartition(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(run, "doc_id long, ids array<int>")
