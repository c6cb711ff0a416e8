"""The folder that driver and executors share, and files in it."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where that is unset, as in tests, a new temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        at = tempfile.mkdtemp(prefix="harvestry-")
        spark.sparkContext.setCheckpointDir(at)
        at = f"file://{at}"
    return at.rstrip("/")


def scratch_dir(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared one; it is deleted when the driver's Python ends."""
    at = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    fs, path = filesystem(at)
    fs.create_dir(path, recursive=True)
    atexit.register(remove, at)
    return at


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def remove(uri: str) -> None:
    fs, path = filesystem(uri)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_dir(path)


def materialise(frame: DataFrame, kind: str) -> DataFrame:
    """Writes a frame to a table in the shared folder and reads it again: cuts lineage, survives lost executors."""
    spark = frame.sparkSession
    at = f"{scratch_dir(spark, kind)}/table"
    frame.write.parquet(at)
    return spark.read.schema(frame.schema).parquet(at)


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Writes named arrays to one file, which appears only when it is whole."""
    head, at, parts = {}, 0, []
    for name, x in arrays.items():
        x = np.ascontiguousarray(x)
        head[name] = (x.dtype.str, len(x), at)
        parts.append(x.tobytes() + b"\0" * (-x.nbytes % 8))
        at += len(parts[-1])
    top = json.dumps(head).encode()
    top += b" " * (-len(top) % 8)
    fs, path = filesystem(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        out.write(len(top).to_bytes(8, "little") + top)
        for x in parts:
            out.write(x)
    fs.move(part, path)


def map_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of such a file, memory-mapped. From a store that can't be mapped it is copied to a local file that has no name any more."""
    fs, path = filesystem(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        data = np.memmap(path, np.uint8, "r")
    else:
        with tempfile.NamedTemporaryFile() as local:
            with fs.open_input_stream(path) as source:
                while block := source.read(1 << 22):
                    local.write(block)
            local.flush()
            data = np.memmap(local.name, np.uint8, "r")
    size = int.from_bytes(data[:8].tobytes(), "little")
    head, base = json.loads(data[8 : 8 + size].tobytes()), 8 + size
    return {name: np.frombuffer(data, dtype, n, base + at) for name, (dtype, n, at) in head.items()}


_KEPT: dict = {}


def kept(key: object, make: Callable) -> object:
    """What a worker keeps from task to task: the last thing that was asked for, so that operators that follow each other don't add up."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Frees what the worker kept for another operator."""
    _KEPT.clear()
    pa.default_memory_pool().release_unused()


def texts_of(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """doc_id long, text string, and more columns, for tasks in Python; bounds the bytes that Spark hands to a task at once."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *more)


def tasks(spark: SparkSession) -> int:
    """The number of tasks that a shuffle deals to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
