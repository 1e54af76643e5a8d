"""Cutting the lineage of a DataFrame in storage that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What this process has written, for :func:`clear`.
_WRITTEN: set[str] = set()


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    Where the session names none, a temporary folder serves a session of one machine, as in tests; a cluster is refused, as its
    executors share no such folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="paperlane-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def place(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder for tables that are written step by step."""
    path = f"{folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.add(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the checkpoint folder: a lost executor costs a read and no recomputation.

    The table is compressed Parquet, smaller than what ``checkpoint()`` writes; it stays until :func:`clear` or until
    the folder is cleared.
    """
    path = place(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Delete the tables that this process has cut; call it when the results that came from them are written. The number of tables."""
    n = len(_WRITTEN)
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
