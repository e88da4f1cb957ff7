"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. Only a session within one process may go without: it gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def stage_at(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet under the shared folder and read it back, so that no later failure recomputes it; and where it is."""
    spark = df.sparkSession
    out = f"{checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(out)
    path, system = _path(spark, out)
    system.deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(out), out


def stage(df: DataFrame, tag: str) -> DataFrame:
    return stage_at(df, tag)[0]


def remove(spark: SparkSession, at: str) -> None:
    """Delete a staged table that nothing reads any more."""
    path, system = _path(spark, at)
    system.delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_hash(text: str) -> Column:
    """With the id it names a row whatever ids repeat or are missing: a null text is one of its own."""
    return F.xxhash64(F.col(text).isNull(), F.coalesce(text, F.lit("")))


def arrow_rows(fn: Callable[[dict[str, list]], dict[str, list]], schema: pa.Schema) -> Callable:
    """A mapInArrow function from one on lists of columns; batches are cut to ``ROWS`` rows to bound memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_pydict(fn(part.to_pydict()), schema=schema)

    return run


#: Rows of a slice that a Python worker turns into Python objects at once.
ROWS = 1024
