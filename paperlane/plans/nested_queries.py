"""Queries over nested JSON records (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlane.operators import nested
from paperlane.sources import table


def _records(spark: SparkSession, folder: str) -> DataFrame:
    layouts = table(spark, folder, "ocr_results").select("id", F.col("layout_json").alias("json"))
    fields = table(spark, folder, "scan_documents").select("id", F.col("extracted_json").alias("json"))
    return layouts.unionByName(fields)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row per object that is an element of an array in layout_json or extracted_json."""
    return nested.nodes(_records(spark, folder), "id", "json").filter("is_element").select("record_id", "parent_path", "node_path")


def p5_supertypes(spark: SparkSession, folder: str) -> DataFrame:
    """Per role of an object: the number of its variants and the keys they share."""
    return nested.supertypes(nested.nodes(_records(spark, folder), "id", "json"))


def p5_subtypes(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the typed subtype tables of every variant."""
    return nested.subtypes(nested.nodes(_records(spark, folder), "id", "json"))


QUERIES = {"p5_found": p5_found, "p5_supertypes": p5_supertypes, "p5_subtypes": p5_subtypes}
_UNWRAPPED = "CASE WHEN json_valid({0}) AND json_type({0}) = 'VARCHAR' THEN json_extract_string({0}, '$') ELSE {0} END"
SQL = {
    "p5_found": f"""WITH r AS (SELECT id, layout_json AS j FROM ocr_results UNION ALL SELECT id, extracted_json FROM scan_documents), u AS (SELECT id, {_UNWRAPPED.format('j')} AS j FROM r), w AS (SELECT id, {_UNWRAPPED.format('j')} AS j FROM u),
t AS (SELECT w.id, x.fullkey FROM (SELECT id, j FROM w WHERE j IS NOT NULL AND json_valid(j)) w, json_tree(w.j::JSON) x WHERE x.type = 'OBJECT' AND x.fullkey LIKE '%]')
SELECT id AS record_id, regexp_replace(fullkey, '(\\.[^.\\[\\]]+)?(\\[[0-9]+\\])+$', '') AS parent_path, fullkey AS node_path FROM t"""
}
