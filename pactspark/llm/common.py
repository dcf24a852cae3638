"""Shared helpers of the training-data operators: table access and shared storage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, by Spark's own reader (any file system it knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a temporary
    folder stands in on one machine (master ``local[...]``); a cluster gets an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="pactspark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage so that lost executors cost no recomputation, and gives the
    optimiser the true size: it then broadcasts only what is under
    ``spark.sql.autoBroadcastJoinThreshold``. The files go by ``free``, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pactspark/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def free(*frames: DataFrame | None) -> None:
    """Delete the files of frames that ``materialise`` returned and that nothing will read again."""
    for df in frames:
        if df is None or not (path := getattr(df, "scratch_path", None)):
            continue
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clean_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are gone; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def free_prefix(df: DataFrame, start: str) -> str:
    """``start``, with underscores added until no column's name begins with it (Spark doesn't tell cases apart)."""
    while any(c.lower().startswith(start) for c in df.columns):
        start += "_"
    return start


def split_remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; remainder 1 is held out of all learning."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(3))


def held_out(doc_id: Column) -> Column:
    """True where the id's remainder is 1; a null id counts as held out (it can't be assigned)."""
    return F.coalesce(split_remainder(doc_id) == 1, F.lit(True))


_IN_WORKER: dict[str, object] = {"owner": None, "forget": None}


def own_worker(owner: str, forget=None) -> None:
    """Call first in a Python task: one operator's memory at a time in a worker.

    Workers outlive their tasks and serve all operators in turn. What another operator
    remembers is dropped (its ``forget``), and free memory goes back to the system.
    """
    import ctypes

    import pyarrow as pa

    if _IN_WORKER["owner"] not in (None, owner) and _IN_WORKER["forget"]:
        _IN_WORKER["forget"]()
    _IN_WORKER.update(owner=owner, forget=forget)
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
