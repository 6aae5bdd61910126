"""Session access: table loading and cutting lineage through the shared folder."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as ``spark.checkpoint.dir`` names it. Only a session on this machine alone
    may leave it unset and gets a temporary one; on a cluster that would be another folder on every machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="litlens-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_LOCAL_MAP = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"


class Scratch:
    """Tables written to the shared folder during one operator; a reader never depends on a live executor.

    Each ``cut`` ends the lineage of its frame: it is written as Parquet and read back. ``drop`` removes a
    table that no later plan reads. Tables of the returned result stay until the session's folder is cleared.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.n = 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        # joins may hash instead of sort, where the statistics of the finished shuffles show every partition to be small
        before = self.spark.conf.get(_LOCAL_MAP)
        self.spark.conf.set(_LOCAL_MAP, "8m")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_LOCAL_MAP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def rows(self, df: DataFrame) -> int:
        """The number of rows of a cut frame, from its files' footers. (An observation of the write would save the job, but
        a session that has observed anything can no longer ship the functions of fitted models.)"""
        return df.count()

    def release(self) -> None:
        """Let the shuffle files of finished steps go now, not when the driver next happens to collect its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = self.spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
