"""What several operators of this subpackage share: table access, the shared scratch folder, Arrow helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_stored: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def scratch(spark: SparkSession) -> str:
    """The shared folder of the session (spark.checkpoint.dir). A temporary one only in local mode, where none is set."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="strata-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def files(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder and the path in it, for files that are no tables."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it back with the same schema."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _stored[out] = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Deletes what ``stored`` wrote for these frames, once nothing reads them any more."""
    for frame in frames:
        if path := _stored.pop(frame, None) if frame is not None else None:
            remove(frame.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared scratch folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Writes that end inside take their shuffle files with them. Only for plans that nothing else runs again: it would
    have to shuffle anew. The session's own setting comes back afterwards."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a binary column; null counts as empty."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    if column.null_count:
        column = column.fill_null(b"")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw, at - at[0] if len(at) else np.zeros(1, np.int64)


def portions(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of at most ``most`` bytes of ``column`` (a longer single row stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = buffers(batch.column(batch.schema.get_field_index(column)))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(at, at[low] + most, side="right")) - 1)
            yield batch.slice(low, high - low)
            low = high
