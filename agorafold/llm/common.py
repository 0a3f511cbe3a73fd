"""What the operators share: reading tables, shared scratch tables, text words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that end a word in the ASCII-white-space word rule.
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path may be in any store that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for scratch tables: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Only where a session names neither (single-machine tests) it is a folder
    under the warehouse.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    return (found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch").rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of any store that Spark writes to."""
    fs, hadoop = _hadoop(spark, path)
    fs.delete(hadoop, True)


class Scratch:
    """Tables written to the shared folder in order to cut lineage.

    An executor that is lost later costs nothing: the rows are in the shared
    store. ``drop`` removes tables that no later step reads; what is left goes
    when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        """Write ``df`` and return the DataFrame that reads it back."""
        path = f"{self.root}/{self.n}"
        self.n += 1
        if self.n == 1:
            fs, hadoop = _hadoop(self.spark, self.root)
            fs.deleteOnExit(hadoop)
        df.write.partitionBy(*(partition_by or [])).option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            delete(self.spark, df._scratch_path)


@contextmanager
def batch_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs that run within it hand Python at most ``most`` rows at a time, so that long texts don't add up.

    The session's own limit stays where it is lower, and is back afterwards.
    Only for jobs that run at once: a plan that runs later has the session's limit.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= most:
        yield
        return
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def utf8_bytes(text: Column) -> Column:
    """UTF-8 length; null counts as empty."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def fraction(*cols: Column) -> Column:
    """A uniform number in (0, 1) that depends on the columns' values only."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
