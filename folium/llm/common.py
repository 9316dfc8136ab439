"""Shared pieces of the operators: tables, shared storage, bounded Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch sent to Python: bounds a worker's memory when texts are long.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes unless the session already says otherwise."""
    for key, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(value))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see. Only a local session gets one of its own where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="folium-")
    return _LOCAL[app]


_LOCAL: dict[str, str] = {}


#: Shuffle files of a query go as it ends, not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and lost executors cost nothing. What it shuffled is deleted."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that no later step reads."""
    spark = tables[0].sparkSession
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for at in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
        path = paths(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def batch_columns(batch: pa.RecordBatch, *names: str) -> Iterator[list]:
    """Columns of an Arrow batch as Python lists."""
    return (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)


def without(df: DataFrame, removed: DataFrame, key: str, most: int = 1 << 20) -> DataFrame:
    """df without the rows whose key is in removed(key): removed is broadcast up to `most` rows, else both are shuffled."""
    few = removed.count() <= most
    return df.join(F.broadcast(removed) if few else removed.hint("merge"), key, "left_anti")
