"""Quality of recognised text: error rates, table cells, gates, and leak-free splits."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlane.functions.markdown import table_cells
from paperlane.functions.text import error_rate, normal_form


def cell_f1(pairs: DataFrame, key: str, reference: str, read: str) -> DataFrame:
    """(key, f1) of the table cells of two texts as multisets: 1 where neither has any, 0 where one has none."""

    def cells(text: str, name: str) -> DataFrame:
        found = F.filter(F.flatten(table_cells(F.coalesce(F.col(text), F.lit("")))), lambda c: c != "")
        return pairs.select(key, F.explode(found).alias("cell")).groupBy(key, "cell").agg(F.count("*").alias(name))

    both = cells(reference, "a").join(cells(read, "b"), [key, "cell"], "full").fillna(0, ["a", "b"])
    sums = both.groupBy(key).agg(F.sum(F.least("a", "b")).alias("common"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    f1 = F.when(F.col("a").isNull(), 1.0).when((F.col("a") == 0) | (F.col("b") == 0), 0.0).otherwise(2.0 * F.col("common") / (F.col("a") + F.col("b")))
    return pairs.select(key).distinct().join(sums, key, "left").select(key, f1.alias("f1"))


def text_error(pairs: DataFrame, key: str, reference: str, read: str) -> DataFrame:
    """(key, cer): edits per reference character in normal form; NULL texts are empty."""
    a, b = (normal_form(F.coalesce(F.col(c), F.lit(""))) for c in (reference, read))
    return pairs.select(key, a.alias("a"), b.alias("b")).select(key, error_rate(F.col("a"), F.col("b")).alias("cer"))


def golden_evaluation(samples: DataFrame, key: str, expected: str, read: str, most: float = 0.15) -> DataFrame:
    """(key, cer, f1, passed) of each sample."""
    rates = text_error(samples, key, expected, read).join(cell_f1(samples, key, expected, read), key)
    return rates.withColumn("passed", F.col("cer") <= most)


def gate(rows: DataFrame, gain: float = 0.02, worse_cer: float = 0.005, worse_f1: float = 0.01) -> DataFrame:
    """Rows (base_holdout, new_holdout, base_golden, new_golden, base_f1, new_f1) with passed and reason.

    The relative gain on held-out text is checked first, then the golden set's error rate, then its cells. A base of 0 or
    less can't be improved on.
    """
    improved = F.when(F.col("base_holdout") > 0, (F.col("base_holdout") - F.col("new_holdout")) / F.col("base_holdout")).otherwise(0.0)
    reason = (
        F.when(improved < gain, "too little improvement")
        .when(F.col("new_golden") - F.col("base_golden") > worse_cer, "golden error rate is worse")
        .when(F.col("base_f1") - F.col("new_f1") > worse_f1, "table cells are worse")
        .otherwise("passed")
    )
    return rows.withColumn("reason", reason).withColumn("passed", F.col("reason") == "passed")


def holdout(rows: DataFrame, key: str, scope: str, share: float = 0.1, seed: str = "42") -> DataFrame:
    """Rows (one per key) with ``holdout``: the share of each scope, at least one, that comes first by hash of seed and key.

    No scope is sorted whole: counts of hash prefixes tell which prefix has the border, and only the keys of that prefix are ranked.
    """
    hashed = rows.withColumn("__h", F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))).withColumn("__prefix", F.substring("__h", 1, 4))
    prefixes = hashed.groupBy(scope, "__prefix").agg(F.count("*").alias("__n"))  # at most 65,536 of a scope
    running = Window.partitionBy(scope).orderBy("__prefix").rowsBetween(Window.unboundedPreceding, -1)
    sizes = prefixes.withColumn("__before", F.coalesce(F.sum("__n").over(running), F.lit(0))).withColumn("__most", F.greatest(F.lit(1), F.floor(F.lit(share) * F.sum("__n").over(Window.partitionBy(scope)))))
    placed = hashed.withColumn("__s", F.coalesce(F.col(scope).cast("string"), F.lit("\x00"))).join(sizes.withColumn("__s", F.coalesce(F.col(scope).cast("string"), F.lit("\x00"))).drop(scope, "__n"), ["__s", "__prefix"])
    order = Window.partitionBy("__s", "__prefix").orderBy("__h", key)
    ranked = placed.withColumn("__rank", F.row_number().over(order))
    return ranked.withColumn("holdout", F.col("__before") + F.col("__rank") <= F.col("__most")).drop("__h", "__prefix", "__s", "__before", "__most", "__rank").select(*rows.columns, "holdout")


def shuffled_holdout(keys: list[str], share: float = 0.1, seed: int = 42) -> set[str]:
    """The held-out keys of a list in first-seen order, by a seeded shuffle; for lists that fit one machine."""
    order = list(dict.fromkeys(keys))
    random.Random(seed).shuffle(order)
    return set(order[: max(1, int(share * len(order)))]) if order else set()


def split_rows(rows: DataFrame, key: str, scope: str, share: float = 0.1) -> DataFrame:
    """Rows with ``split``; all rows of a key are on one side."""
    sides = holdout(rows.select(key, scope).distinct(), key, scope, share).select(key, F.when(F.col("holdout"), "holdout").otherwise("train").alias("split"))
    return rows.join(sides, key)


def confidence(lines: Column) -> Column:
    """Mean confidence of an array of numbers; NULL if it is empty."""
    return F.when(F.size(lines) > 0, F.aggregate(lines, F.lit(0.0), lambda a, x: a + x) / F.size(lines))


def approved_corrections(corrections: DataFrame, pages: DataFrame) -> DataFrame:
    """Approved corrections that change something, with the document of their page, first made first: what a training set is built of."""
    changed = corrections.filter("status = 'approved' and not (original_markdown <=> corrected_markdown)")
    return changed.join(pages.select(F.col("id").alias("page_id"), "document_id"), "page_id").orderBy("created_at", "id")


def training_set(corrections: DataFrame, pages: DataFrame, share: float = 0.1) -> DataFrame:
    """(document_id, page_id, original_markdown, corrected_markdown, split): no document is on both sides."""
    rows = approved_corrections(corrections, pages).withColumn("__all", F.lit(""))
    return split_rows(rows, "document_id", "__all", share).select("document_id", "page_id", "original_markdown", "corrected_markdown", "split")


def set_sizes(rows: DataFrame) -> DataFrame:
    """(total, train, holdout) of a training set."""
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "holdout").alias("holdout"))
