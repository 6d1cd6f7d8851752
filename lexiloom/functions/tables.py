"""Intermediate tables in the folder that all executors share, so that what is read several times is computed once and survives lost executors; tables dealt to tasks by their size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of input files for which a table that is dealt by keys has a task, about 250,000 rows of a few numbers.
TASK_BYTES = 4 << 20


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The files of the shuffles of a job within go when it ends, as its result is all that is of use."""
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        yield
    finally:
        spark.conf.set(cleanup, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below ``spark.checkpoint.dir`` and read again; the files go with the session. A local master without the setting takes a temporary folder."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-lexiloom-tables-")
    path, schema = f"{root.rstrip('/')}/lexiloom-table-{name}-{uuid.uuid4().hex}", df.schema
    with shuffles_removed(spark):
        df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(schema).parquet(path)


def tasks_of(df: DataFrame) -> int:
    """As many tasks as the input files of ``df`` ask for, at least as many as shuffles have: a task's share does not grow with the input."""
    spark, size = df.sparkSession, 0
    for name in df.inputFiles():
        file = spark._jvm.org.apache.hadoop.fs.Path(name)
        size += file.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(file).getLen()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hashed by ``keys`` to ``tasks_of`` tasks. Rows of one key stay in one task."""
    return df.repartition(tasks_of(df), *keys)


def slices(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that a part has about ``most`` bytes, or one row: what Python makes of a part stays small, however many rows a task has."""
    for batch in batches:
        rows = max(1, batch.num_rows * most // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
