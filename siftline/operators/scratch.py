"""Copies of intermediate tables, as Parquet in the folder that the cluster names in ``spark.checkpoint.dir``.

They cut the lineage of jobs in several steps and outlive the executors that
wrote them.  A folder of the driver's own machine is only taken where all
executors are threads of the driver; on a cluster without a shared folder the
job is refused, as its executors would each write to a disk of their own.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_COPIES: dict[str, SparkSession] = {}


def folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    made = sc._jsc.sc().getCheckpointDir()
    if made.isDefined():
        return made.get().rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="siftline-"))
    return folder(spark)


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is deleted when the process ends."""
    path = f"{folder(spark)}/siftline-{name}-{uuid.uuid4().hex}"
    if not _COPIES:
        atexit.register(drop_all)
    _COPIES[path] = spark
    return path


def saved(df: DataFrame, name: str = "copy") -> DataFrame:
    """``df``, read from a copy."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.copied_to = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the copy that :func:`saved` returned as ``df``; nothing may read it any more."""
    _delete(getattr(df, "copied_to", ""))


def drop_all() -> None:
    """Delete every copy that this process wrote."""
    while _COPIES:
        if not _delete(next(iter(_COPIES))):
            _COPIES.clear()  # the session is gone


def _delete(path: str) -> bool:
    spark = _COPIES.pop(path, None)
    try:
        if spark is not None:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        return True
    except Exception:  # noqa: BLE001  at the end of the process the session may be gone
        return False
