"""Structured Streaming for intake: folder source, duplicates, sessions, counters, progress, tenant events.

Event time with a watermark replaces clocks; what a batch query computes over finished rows, these compute over
arriving ones.  Every function maps a streaming DataFrame to one; the caller writes it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlane.functions.text import suffix
from paperlane.sources.files import DOCUMENT_TYPES

JOURNAL = T.StructType([T.StructField(n, k) for n, k in (
    ("device_id", T.StringType()), ("batch_id", T.StringType()), ("path", T.StringType()), ("sha256", T.StringType()), ("state", T.StringType()),
    ("document_id", T.StringType()), ("error", T.StringType()), ("updated_at", T.TimestampType()), ("received_at", T.TimestampType()))])


def watched_folder(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """(path, name, sha256, byte_size, modified) of document files as they appear; hidden and temporary names are ignored.

    Files must be moved into the folder whole; what is there at the start is read first.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", per_trigger).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    wanted = suffix(name).isin(*DOCUMENT_TYPES) & ~name.startswith(".") & ~name.startswith("~")
    return files.filter(wanted).select("path", name.alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("byte_size"), F.col("modificationTime").alias("modified"))


def journal_stream(spark: SparkSession, folder: str, per_trigger: int = 10) -> DataFrame:
    return spark.readStream.schema(JOURNAL).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def marked_duplicates(files: DataFrame, key: str = "sha256") -> DataFrame:
    """(key, path, outcome): ``new`` for the first file of a hash, ``duplicate`` for later ones, over restarts.

    The state per hash is one path.  Needs the RocksDB state store.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Seen(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.first = handle.getValueState("first", "path string")

        def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
            for part in rows:
                part = part.sort_values("path")
                out = []
                for path in part["path"]:
                    if self.first.exists():
                        out.append((key[0], path, "duplicate"))
                    else:
                        self.first.update((path,))
                        out.append((key[0], path, "new"))
                yield pd.DataFrame(out, columns=["sha256", "path", "outcome"])

        def close(self) -> None:
            pass

    named = files.select(F.col(key).alias("sha256"), "path").filter("sha256 is not null")
    return named.groupBy("sha256").transformWithStateInPandas(Seen(), "sha256 string, path string, outcome string", "Append", "None")


def sessions(rows: DataFrame, key: str = "device_id", moment: str = "received_at", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, files) of upload sessions: a file within 60 seconds of the last one joins its session.

    Spark merges events exactly at the gap, so the gap is a microsecond less than a minute.
    """
    window = F.session_window(moment, "59.999999 seconds")
    grouped = rows.withWatermark(moment, late).groupBy(F.col(key), window.alias("w")).agg(F.count("*").alias("files"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "files")


def batch_progress(rows: DataFrame, moment: str = "received_at", late: str = "1 hour") -> DataFrame:
    """(batch_id, total, completed) as they stand, for append mode of changes: each file counts once, and once more when it is done.

    Duplicates are dropped by (batch, file, done) for as long as the watermark lets them arrive, so counts are exact.
    """
    done = (F.col("state") == "done").alias("done")
    seen = rows.filter("batch_id is not null and sha256 is not null").select("batch_id", F.lower("sha256").alias("file"), done, moment)
    # a file that is first seen when it is done counts in both
    whole = seen.withColumn("counts", F.when(F.col("done"), F.array(F.lit("total"), F.lit("completed"))).otherwise(F.array(F.lit("total"))))
    each = whole.select("batch_id", "file", F.explode("counts").alias("count"), moment).withWatermark(moment, late).dropDuplicatesWithinWatermark(["batch_id", "file", "count"])
    return each.select("batch_id", "file", "count", moment)


def batch_counts(changes: DataFrame) -> DataFrame:
    """(batch_id, total, completed, status) of the rows that :func:`batch_progress` has written."""
    counts = changes.groupBy("batch_id").agg(F.count_if(F.col("count") == "total").alias("total"), F.count_if(F.col("count") == "completed").alias("completed"))
    return counts.withColumn("status", F.when(F.col("completed") >= F.col("total"), "completed").otherwise("processing"))


def last_states(rows: DataFrame, key: str = "document_id", state: str = "state", moment: str = "updated_at") -> DataFrame:
    """(key, state, moment): the newest state of each key, for update or complete mode."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(state, moment).alias(state), F.max(moment).alias(moment))


def events_for(rows: DataFrame, company: str | None, topic_prefix: str = "") -> DataFrame:
    """Events a listener of a company may see; all for listeners without one."""
    seen = rows if company is None else rows.filter(F.col("company_id") == company)
    return seen.filter(F.col("topic").startswith(topic_prefix)) if topic_prefix else seen


def within_limit(pages: DataFrame, limit: int = 2000) -> DataFrame:
    """(company_id, pending, accepted): whether a company may send more pages."""
    pending = pages.groupBy("company_id").agg(F.count_if(F.col("status") == "pending").alias("pending"))
    return pending.withColumn("accepted", F.col("pending") <= limit)
