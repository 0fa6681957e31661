"""What the training-data operators share: tables, the shared folder, Arrow batches of texts."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import opened

#: A word is a run of anything but ASCII white space; bytes.split() cuts at the same characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new path under the folder that the cluster shares. Only a local session, whose tasks are this machine's, has a default."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(base or 'file:///tmp/checkpoints').rstrip('/')}/kbspark-{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write and reread: lineage ends in a table that every executor can read again. forget() deletes it."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._written = path
    return written


def hadoop_path(spark: SparkSession, uri: str) -> tuple:
    """(file system, path) by Hadoop, on the driver: any store that Spark itself can write to."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def task_dir(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one for files that tasks write and read themselves; an error at once if they could not."""
    store, path = hadoop_path(spark, shared_dir(spark, label))
    store.mkdirs(path)
    folder = store.resolvePath(path).toString()
    opened(folder)
    return folder


def forget(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing reads any more."""
    for t in tables:
        store, path = hadoop_path(t.sparkSession, t._written)
        store.delete(path, True)


def n_words(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """UTF-8 of each text of a batch, null as empty."""
    column = batch.column(name).cast(pa.large_binary())
    return (x.as_py() or b"" for x in column)


def short_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Whole texts are long, so Arrow batches get fewer rows, unless the session's owner has chosen a number of their own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def give_back() -> None:
    """Freed memory goes back to the machine at once; workers and the driver live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Non-empty parts of batches: what a worker makes of one part stays small. A task's freed memory goes back at its end."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    give_back()


def batch_of(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
