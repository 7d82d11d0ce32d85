"""Signal and target tables on disk: partitioned Parquet with resume, dated copies, CSV reports with delimiter-joined lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SignalStore:
    """(signal, inst, dt, value) as Parquet partitioned by signal."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, values: DataFrame) -> None:
        """Appends signals; run ``missing`` first to leave out those that are there."""
        values.select("inst", "dt", "value", "signal").repartition("signal").write.mode("append").partitionBy("signal").parquet(self.path)

    def exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def load(self, signals: list[str] | None = None, insts: list | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
        """Partition pruning by signal, pushed filters by date and instrument."""
        df = self.spark.read.parquet(self.path)
        if signals is not None:
            df = df.where(F.col("signal").isin(signals))
        if insts is not None:
            df = df.where(F.col("inst").isin(insts))
        if start is not None:
            df = df.where(F.col("dt") >= F.lit(start).cast("date"))
        if end is not None:
            df = df.where(F.col("dt") <= F.lit(end).cast("date"))
        return df

    def available(self) -> DataFrame:
        return self.spark.read.parquet(self.path).select("signal").distinct()

    def missing(self, values: DataFrame) -> DataFrame:
        """Rows of signals that the store doesn't hold yet."""
        return values.join(self.available(), "signal", "left_anti") if self.exists() else values

    def stats(self) -> DataFrame:
        return self.load().groupBy("signal").agg(F.count("value").alias("n"), F.countDistinct("inst").alias("n_inst"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))

    def backup(self, to: str) -> None:
        """A copy at a dated path."""
        self.spark.read.parquet(self.path).write.partitionBy("signal").parquet(to)


def write_report(df: DataFrame, path: str, separator: str = "|") -> None:
    """CSV with header; array columns become joined text."""
    cols = [F.array_join(f.name, separator).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema.fields]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def read_report(spark: SparkSession, path: str, schema: str, lists: tuple[str, ...] = (), separator: str = "|") -> DataFrame:
    df = spark.read.option("header", True).schema(schema).csv(path)
    import re

    return df.withColumns({c: F.split(c, re.escape(separator)) for c in lists})
