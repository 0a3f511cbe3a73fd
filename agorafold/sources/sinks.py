"""Results and state on disk: JSON texts, versioned snapshots, tables between rounds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Buckets of a state table, fixed for the life of its folder.
BUCKETS = 256


def as_json(rows: DataFrame) -> DataFrame:
    """(json): each row as one JSON object."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def bucket(*keys: str, buckets: int = BUCKETS):
    """The bucket of a state row by its keys."""
    return F.pmod(F.hash(*keys), F.lit(buckets))


def _folders(spark: SparkSession, root: str, name: str) -> list[tuple[int, int, str]]:
    """(version, bucket, path) of all that is written of a state table."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/version=*/bucket=*")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    paths = [f.getPath() for f in found]
    return [(int(p.getParent().getName().split("=")[1]), int(p.getName().split("=")[1]), p.toString()) for p in paths]


def _latest(folders: list[tuple[int, int, str]], version: int) -> dict[int, str]:
    """The path of each bucket as of a version."""
    return {b: path for v, b, path in sorted(folders) if v <= version}


def write_snapshot(rows: DataFrame, keys: list[str], root: str, name: str, version: int, buckets: int = BUCKETS, emptied: set[int] | None = None) -> None:
    """Write the buckets that a version changes, whole; a repeated version replaces itself, so retries are harmless.

    Large buckets are divided between tasks, small ones share a task. emptied:
    buckets that the version has even where it leaves them without rows.
    """
    placed = rows.withColumn("bucket", bucket(*keys, buckets=buckets)).hint("rebalance", "bucket")
    placed.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{root}/{name}/version={version}")
    spark = rows.sparkSession
    for b in emptied or ():
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/version={version}/bucket={b}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)


def read_snapshot(spark: SparkSession, root: str, name: str, version: int, schema: str, only: set[int] | None = None) -> DataFrame:
    """A state table as of a version, or some of its buckets; empty before the first."""
    paths = [path for b, path in _latest(_folders(spark, root, name), version).items() if only is None or b in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def drop_replaced(spark: SparkSession, root: str, name: str, version: int) -> None:
    """Delete buckets that neither ``version`` nor the one before it, from which it can be repeated, reads."""
    folders = _folders(spark, root, name)
    needed = {*_latest(folders, version).values(), *_latest(folders, version - 1).values()}
    for v, _, path in folders:
        if v < version and path not in needed:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def nothing(spark: SparkSession, schema: str) -> DataFrame:
    """A state before its first batch; known to be empty when a query is planned, so joins with it fall away."""
    return spark.createDataFrame([], schema).where(F.lit(False))


class Shared:
    """Tables between the rounds of a loop, in the shared folder ``spark.checkpoint.dir``, else the context's checkpoint folder (without either, under the warehouse)."""

    def __init__(self, spark: SparkSession, name: str):
        found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        self.spark, self.root, self.n = spark, f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}", 0

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def open(self) -> str:
        """The folder, which goes when the application ends."""
        fs, hadoop = self._fs(self.root)
        fs.deleteOnExit(hadoop)
        return self.root

    def keep(self, rows: DataFrame) -> DataFrame:
        """Write ``rows`` and return what reads them back."""
        path = f"{self.root}/{self.n}"
        if not self.n:
            self.open()
        self.n += 1
        rows.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(rows.schema).parquet(path)
        back._shared_path = path
        return back

    def drop(self, rows: DataFrame) -> None:
        fs, hadoop = self._fs(rows._shared_path)
        fs.delete(hadoop, True)
