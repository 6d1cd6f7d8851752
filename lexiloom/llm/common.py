"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Python works on slices of a batch of about so many bytes of text, so that memory stays bounded for long texts.
SLICE_BYTES = 1 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset, a local master gets a temporary one; a cluster has to name its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-lexiloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/lexiloom-{name}-{uuid.uuid4().hex}"


#: For each ``temporary_tables`` block that is open, the paths it will remove.
_BLOCKS: list[list[str]] = []


def note_table(spark: SparkSession, path: str, keep: bool = False) -> None:
    """A written table goes with the innermost ``temporary_tables`` block, or, with ``keep``, with the one around it; with the session at the latest."""
    inner = len(_BLOCKS) - 1 - keep
    if inner >= 0:
        _BLOCKS[inner].append(path)
    where, files = _on_files(spark, path)
    files.deleteOnExit(where)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that are materialised in the block are removed at its end, but for those with ``keep``. The list may be emptied earlier by ``remove_path``."""
    paths: list[str] = []
    _BLOCKS.append(paths)
    try:
        yield paths
    finally:
        _BLOCKS.pop()
        for path in paths:
            remove_path(spark, path)


def materialise(df: DataFrame, name: str, compression: str = "snappy", keep: bool = False) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.parquet(path, compression=compression)
    note_table(spark, path, keep)
    return spark.read.schema(schema).parquet(path)


def _on_files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system, wherever it lies."""
    where, files = _on_files(spark, path)
    files.delete(where, True)


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most ``rows`` rows and about 16 MB, so that very long texts do not pile up."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that ``column`` holds about ``limit`` bytes in each slice (a longer text stands alone)."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(sizes) // limit)) + 1, [batch.num_rows]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return pc.fill_null(batch.column(column), "").to_pylist()


def columns_to_batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)
