"""Parquet tables of a data folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def make_importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the session was started without it on their path."""
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, *paths) if p)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; columns and filters are pruned by the scan."""
    make_importable(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
