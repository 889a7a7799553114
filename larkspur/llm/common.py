"""Shared plumbing: the cluster's shared folder, scratch tables, shipping the package to workers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship

__all__ = ["Scratch", "crc32_mod", "sent_if_small", "shared_dir", "ship", "table", "with_ids"]


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and all of Spark runs on this machine (tests, a laptop) is a fresh local folder made
    and set; a cluster without the setting is an error, as its executors share no local folder."""
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="larkspur-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Up to so many ids (8 bytes each, some 20 in a task's hash table) are sent to all tasks; beyond, both sides
#: are shuffled.
ID_LIMIT = 2_000_000
#: The same for rows of a few numbers, which take 100 to 150 bytes each in a hash table.
ROW_LIMIT = 200_000


def with_ids(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """``df`` semi- or anti-joined with a written table of distinct ids. Its size is counted first: a small one
    spares moving the texts of ``df``."""
    return df.join(F.broadcast(ids) if ids.count() <= ID_LIMIT else ids, key, how)


def sent_if_small(rows: DataFrame) -> DataFrame:
    """A written table of narrow rows, marked to be sent to all tasks if counting shows that it is small. The
    larger side of a join on a hot key then stays where it is; else Spark splits such a key's rows."""
    return F.broadcast(rows) if rows.count() <= ROW_LIMIT else rows


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive a lost executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/larkspur/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n}-{name}"

    def table(self, df: DataFrame, name: str = "t", compression: str = "zstd") -> DataFrame:
        df.write.option("compression", compression).parquet(p := self.path(name))
        out = self.spark.read.schema(df.schema).parquet(p)
        out._larkspur_path = p
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete superseded tables so that the shared folder holds one generation only."""
        for t in tables:
            if p := getattr(t, "_larkspur_path", None):
                jp = self.spark._jvm.org.apache.hadoop.fs.Path(p)
                jp.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jp, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_mod(col: str, m: int):
    """crc32 of the id written as decimal text, modulo m."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % m
