"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder for a local master, whose executors are on this machine. Elsewhere an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file:/tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


class Table:
    """A set that grows by rounds: each is written once, so a plan that reads it has no lineage but files."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.paths, self.schema, self.rows = spark, [], None, 0
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _drop_at_exit(spark, self.base)

    def add(self, df: DataFrame) -> int:
        """Writes df as the next round; how many rows it had."""
        seen = Observation()
        path = f"{self.base}/{len(self.paths)}"
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        self.schema = self.schema or df.schema
        self.paths.append(path)
        n = int(seen.get["n"])
        self.rows += n
        return n

    def read(self, last: bool = False) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(self.paths[-1:] if last else self.paths))


def staged(df: DataFrame, name: str = "staged", by: str | None = None) -> DataFrame:
    """df, written and read again: later readers neither repeat its work nor depend on its executors. With by, it is bucketed by that
    column, so that grouping by it needs no shuffle."""
    spark, key = df.sparkSession, uuid.uuid4().hex
    path = f"{shared_dir(spark)}/{name}-{key}"
    write = df.write.option("compression", "zstd")
    if by:
        own = f"{name.replace('-', '_')}_{key}"
        write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("path", path).saveAsTable(own)
    else:
        write.parquet(path)
    _drop_at_exit(spark, path)
    if not by:
        return spark.read.schema(df.schema).parquet(path)
    out = spark.table(own)
    out.schema  # noqa: B018  the plan is resolved, and with it where the files are
    spark.sql(f"DROP TABLE {own}")  # the name goes, the files of an external table stay
    return out
