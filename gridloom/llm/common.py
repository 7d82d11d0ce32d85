"""Shared pieces: table access, words, scratch tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_of(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that further columns of any name cannot clash."""
    return df.select(*[df[c] for c in columns])


def parts(batches, ends_of, most: int):
    """The batches' rows in slices of ``most`` units or one row; ends_of gives a batch's running number of units."""
    for b in batches:
        ends, at = ends_of(b), 0
        while at < b.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield b.slice(at, stop - at)
            at = stop
        pa.default_memory_pool().release_unused()  # workers are used again, so what they keep adds up


def byte_ends(column: pa.Array) -> np.ndarray:
    """A string column's running number of bytes."""
    return np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. Where it names none, and all runs on one machine, a local one is set; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        else:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            local = tempfile.mkdtemp(prefix="gridloom-")
            atexit.register(shutil.rmtree, local, ignore_errors=True)
            spark.sparkContext.setCheckpointDir(f"file://{local}")
            base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return base


#: Spark's own setting: a statement's shuffle files are deleted when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession):
    """Statements run in here leave no shuffle files; else those of all steps stay on disk until the driver collects garbage."""
    held = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, held)


class Scratch:
    """A DataFrame written as a Parquet table in the shared folder: lineage ends there, and any executor can reread it.

    Tables that a returned DataFrame still reads stay, in one folder for each application, which can go when that has ended."""

    def __init__(self, df: DataFrame, tag: str):
        self.spark = df.sparkSession
        self.path = f"{scratch_dir(self.spark)}/gridloom-{self.spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
        with tidy(self.spark):
            df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Deletes the table; only for one that no DataFrame still in use reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
