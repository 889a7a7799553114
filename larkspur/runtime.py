"""What all of Spark needs of this package: itself on Python workers, Arrow batches of bounded size, a shared
folder for tables that cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[1]
#: Bytes of an Arrow batch, unless the session's settings say otherwise: a worker holds a batch at a time.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows of a few numbers or short strings that are sent to all tasks at most; some 150 bytes each in a hash table.
ROW_LIMIT = 200_000
#: Rows that a task sorts or groups at a time, where what it holds would grow with the input.
TASK_ROWS = 250_000
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package even if the repository isn't on their path, and bound the session's
    Arrow batches where its settings don't: long texts then can't fill a worker's memory."""
    sc = spark.sparkContext
    if not sc.getConf().contains(_BATCH_CONF):
        spark.conf.set(_BATCH_CONF, BATCH_BYTES)
    if sc.applicationId in _shipped or str(ROOT) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    _shipped.add(sc.applicationId)
    at = Path(tempfile.mkdtemp(prefix="larkspur-src-")) / "larkspur_src.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted((ROOT / "larkspur").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(at))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session, or what setCheckpointDir named.

    Only where neither is set and all of Spark runs on this machine (tests, a laptop) is a fresh local folder made
    and set; a cluster without the setting is an error, as its executors share no local folder."""
    sc = spark.sparkContext
    if conf := sc.getConf().get("spark.checkpoint.dir"):
        return conf.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="larkspur-"))
        held = sc._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, outlives lost executors, cuts lineage. What
    this has returned is returned as it is."""
    if getattr(df, "_is_stored", False):
        return df
    path = f"{shared_dir(df.sparkSession)}/larkspur/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._is_stored = True
    return out


def sent_if_small(rows: DataFrame, limit: int = ROW_LIMIT) -> DataFrame:
    """``rows``, marked to be sent to all tasks if counting them shows that they are few; store them first if they
    are costly to make."""
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores if its scan has fewer tasks than these, as one small file has."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of about ``rows`` rows, dealt out by ``keys``, TASK_ROWS a task, so that what a task sorts or groups
    doesn't grow with the input."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)
