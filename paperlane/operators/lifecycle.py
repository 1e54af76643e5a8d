"""State transitions and table maintenance as pure functions from old rows and changes to new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Allowed transitions of a correction and of a model version.
CORRECTION_STEPS = (("draft", "submitted"), ("submitted", "approved"), ("submitted", "rejected"), ("approved", "used_in_training"))
ACTIVATABLE = ("candidate", "retired", "active")


def applied(rows: DataFrame, changes: DataFrame, key: str, steps: tuple[tuple[str, str], ...] = CORRECTION_STEPS) -> tuple[DataFrame, DataFrame]:
    """(rows after the changes (key, to), refused changes with the reason)."""
    allowed = rows.sparkSession.createDataFrame(list(steps), "status string, to string").withColumn("ok", F.lit(True))
    wanted = changes.join(rows.select(key, "status"), key, "left").join(F.broadcast(allowed), ["status", "to"], "left")
    refused = wanted.filter("ok is null").select(key, "to", F.when(F.col("status").isNull(), "not found").otherwise(F.concat(F.lit("not from "), "status")).alias("reason"))
    taken = wanted.filter("ok").select(key, F.col("to").alias("__to")).dropDuplicates([key])
    after = rows.join(taken, key, "left").withColumn("status", F.coalesce("__to", "status")).drop("__to").select(*rows.columns)
    return after, refused


def flipped(rows: DataFrame, group: str, key: str, moment: str, flag: str = "is_current") -> DataFrame:
    """Rows with exactly the newest of each group flagged."""
    newest = rows.groupBy(group).agg(F.max_by(key, F.struct(moment, key)).alias("__newest"))
    return rows.join(newest, group).withColumn(flag, F.col(key) == F.col("__newest")).drop("__newest").select(*rows.columns)


def activated(versions: DataFrame, chosen: DataFrame) -> DataFrame:
    """Versions after activating the ``chosen`` (id): the active one of the same (company, kind) retires. NULL companies are one scope."""
    rows = versions.join(chosen.select("id").withColumn("__on", F.lit(True)), "id", "left")
    valid = F.col("__on") & F.col("status").isin(*ACTIVATABLE)
    scope = Window.partitionBy("company_id", "kind")
    rows = rows.withColumn("__valid", F.coalesce(valid, F.lit(False))).withColumn("__taken", F.max(F.col("__valid").cast("int")).over(scope) == 1)
    status = F.when(F.col("__valid"), "active").when(F.col("__taken") & (F.col("status") == "active"), "retired").otherwise(F.col("status"))
    return rows.withColumn("status", status).select(*versions.columns)


def without(rows: DataFrame, gone: DataFrame, key: str, gone_key: str = "id") -> DataFrame:
    """Rows that don't belong to what is deleted."""
    return rows.join(gone.select(F.col(gone_key).alias(key)), key, "left_anti").select(*rows.columns)


def unlinked(rows: DataFrame, gone: DataFrame, key: str, gone_key: str = "id") -> DataFrame:
    """Rows with NULL in place of a link to what is deleted."""
    lost = gone.select(F.col(gone_key).alias(key)).distinct().withColumn("__gone", F.lit(True))
    return rows.join(lost, key, "left").withColumn(key, F.when(F.col("__gone"), None).otherwise(F.col(key))).select(*rows.columns)


def added_if_absent(rows: DataFrame, seed: DataFrame, *keys: str) -> DataFrame:
    return rows.unionByName(seed.join(rows.select(*keys), list(keys), "left_anti"))


def swept(rows: DataFrame, before: Column, states: tuple[str, ...], to: str, moment: str = "created_at") -> DataFrame:
    """Rows that stay in one of ``states`` since before a moment, moved to the state ``to``."""
    return rows.withColumn("status", F.when(F.col("status").isin(*states) & (F.col(moment) < before), to).otherwise(F.col("status")))
