"""What the corpus operators share: words, tables, and the folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a session without one, as in tests, gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None and (at := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        found = at.get()
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        found = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder; its files go when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame, what: str, rows: int = 0) -> DataFrame:
    """df written once as a table in the shared folder and read again: lost executors cost no recomputation.

    rows: how many a file holds at most (0: any number), for tables of large rows, as a reader holds many rows of a file at once.
    """
    path = new_path(df.sparkSession, what)
    df.write.option("maxRecordsPerFile", rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sliced(batch: pa.RecordBatch, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """batch in slices with about size bytes of column text each, or one longer text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch["text"]), 0), np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // size, prepend=0)) if len(sizes) else sizes
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)], strict=True):
        if a < b:
            yield batch.slice(a, b - a)
