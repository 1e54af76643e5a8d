"""Rectangle algebra over struct<x0, y0, x1, y1>, and groups of intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def box_of_points(points: Column) -> Column:
    """The box around array<array<double>> points; zeros without any."""
    axis = lambda i, f: F.coalesce(f(F.transform(points, lambda p: p[i])), F.lit(0.0))
    return box(axis(0, F.array_min), axis(1, F.array_min), axis(0, F.array_max), axis(1, F.array_max))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def shared_area(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])) * F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))


def overlap(a: Column, b: Column) -> Column:
    """Shared area over the area of the union; 0 for empty boxes."""
    i = shared_area(a, b)
    union = area(a) + area(b) - i
    return F.when(union > 0, i / union).otherwise(0.0)


def grown(b: Column, by: float) -> Column:
    return box(b["x0"] - by, b["y0"] - by, b["x1"] + by, b["y1"] + by)


def centre_within(a: Column, b: Column, slack: float = 4.0) -> Column:
    x, y = (a["x0"] + a["x1"]) / 2, (a["y0"] + a["y1"]) / 2
    return x.between(b["x0"] - slack, b["x1"] + slack) & y.between(b["y0"] - slack, b["y1"] + slack)


def first_box(lines: DataFrame, boxes: DataFrame, page: str, slack: float = 4.0) -> DataFrame:
    """Lines (page, line, b) with the order of the first box (page, ord, b) that has their centre, NULL if none has."""
    l, t = lines.withColumnRenamed("b", "lb"), boxes.withColumnRenamed("b", "tb")
    met = l.join(t, page).filter(centre_within(F.col("lb"), F.col("tb"), slack)).groupBy(page, "line").agg(F.min("ord").alias("ord"))
    return lines.join(met, [page, "line"], "left")


def uncovered(boxes: DataFrame, covers: DataFrame, page: str, key: str, share: float = 0.5) -> DataFrame:
    """Boxes of which less than ``share`` lies in any one cover of their page."""
    met = boxes.select(page, key, "b").join(covers.select(page, F.col("b").alias("cover")), page)
    gone = met.filter((area(F.col("b")) > 0) & (shared_area(F.col("b"), F.col("cover")) >= share * area(F.col("b")))).select(page, key).distinct()
    return boxes.join(gone, [page, key], "left_anti")


def islands(rows: DataFrame, keys: list[str], start: str, end: str, gap: float, ties: list[str]) -> DataFrame:
    """Rows with ``island``: 1, 2, ... within keys, a new one where an interval starts more than ``gap`` behind all before."""
    order = Window.partitionBy(*keys).orderBy(start, end, *ties)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) - reach > gap), 1).otherwise(0)
    return rows.withColumn("__new", fresh).withColumn("island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
