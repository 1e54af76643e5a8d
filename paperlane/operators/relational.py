"""Scoping, listing, counting, joining and deduplicating rows of document tables.

Every function maps DataFrames to a DataFrame and adds no action of its own.  Orders always end in a unique key, so
that pages and top-k results are the same on every run.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Principal:
    """Who asks: NULL company means all companies, admins see every row of theirs."""

    company_id: str | None
    user_id: str | None = None
    admin: bool = False


@dataclass(frozen=True)
class Listing:
    """A listing's optional filters; those that are None or empty don't apply."""

    statuses: tuple[str, ...] = ()
    doc_type: str | None = None
    batch_id: str | None = None
    name_like: str | None = None
    since: date | None = None
    until: date | None = None
    mine: bool = False
    page: int = 1
    size: int = 25
    extra: tuple[Column, ...] = field(default=())


def of_company(rows: DataFrame, who: Principal, company: str = "company_id") -> DataFrame:
    """The rows of the principal's company; all rows for a principal without one."""
    return rows if who.company_id is None else rows.filter(F.col(company) == who.company_id)


def visible(rows: DataFrame, who: Principal, owner: str = "uploaded_by_user_id") -> DataFrame:
    """Company rows that are shared or the principal's own. A NULL owner owns nothing."""
    scoped = of_company(rows, who)
    return scoped if who.admin else scoped.filter((F.col("visibility") == "shared") | (F.col(owner) == F.lit(who.user_id)))


def visible_to(rows: DataFrame, users: DataFrame, owner: str = "uploaded_by_user_id") -> DataFrame:
    """The rows that each of ``users`` (company_id, user_id, one of a company) sees of its company, as :func:`visible` has them, with user_id."""
    return rows.join(users.select("company_id", "user_id"), "company_id").filter((F.col("visibility") == "shared") | (F.col(owner) == F.col("user_id")))


def within_days(moment: Column, since: date | None, until: date | None) -> Column:
    """From the start of ``since`` to the end of ``until``, as bare comparisons that reach the scan."""
    at = lambda d: F.lit(datetime(d.year, d.month, d.day))
    low = moment >= at(since) if since else F.lit(True)
    return low & (moment < F.lit(datetime(until.year, until.month, until.day)) + F.expr("interval 1 day") if until else F.lit(True))


def listed(rows: DataFrame, who: Principal, wanted: Listing, owner: str = "uploaded_by_user_id") -> DataFrame:
    """The rows a listing shows before paging. ``%`` and ``_`` of ``name_like`` are wildcards."""
    out = visible(rows, who, owner)
    if wanted.mine:
        out = out.filter(F.col(owner) == F.lit(who.user_id))
    if wanted.statuses:
        out = out.filter(F.col("status").isin(*wanted.statuses))
    if wanted.doc_type is not None:
        out = out.filter(F.col("doc_type") == wanted.doc_type)
    if wanted.batch_id is not None:
        out = out.filter(F.col("batch_id") == wanted.batch_id)
    if wanted.name_like:
        out = out.filter(F.col("original_filename").ilike(f"%{wanted.name_like}%"))
    if wanted.since or wanted.until:
        out = out.filter(within_days(F.col("created_at"), wanted.since, wanted.until))
    for condition in wanted.extra:
        out = out.filter(condition)
    return out


def page_of(rows: DataFrame, page: int, size: int, *order: Column) -> DataFrame:
    """Page ``page`` (from 1) of ``size`` rows (1 to 100) in the given order."""
    size = min(max(size, 1), 100)
    return rows.orderBy(*order).offset((max(page, 1) - 1) * size).limit(size)


def newest_first(moment: str = "created_at", key: str = "id") -> tuple[Column, Column]:
    return F.col(moment).desc(), F.col(key).asc()


def counts_by(rows: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias(name))


def with_counts(entities: DataFrame, rows: DataFrame, key: str, foreign: str, name: str = "n") -> DataFrame:
    """Entities with the number of their rows, 0 for those without any."""
    counts = rows.filter(F.col(foreign).isNotNull()).groupBy(F.col(foreign).alias("__key")).agg(F.count("*").alias(name))
    return entities.join(counts, F.col(key) == F.col("__key"), "left").drop("__key").withColumn(name, F.coalesce(name, F.lit(0)))


def daily_volume(rows: DataFrame, days: int, last: Column | None = None, moment: str = "created_at") -> DataFrame:
    """(day, n) of each of the last ``days`` days up to ``last`` (default: the newest row's day), 0 for days without rows."""
    per_day = rows.groupBy(F.to_date(moment).alias("day")).agg(F.count("*").alias("n"))
    end = per_day.agg(F.max("day").alias("last")).select(F.coalesce(last if last is not None else F.col("last"), F.col("last")).alias("last"))
    calendar = end.select(F.explode(F.sequence(F.date_sub("last", days - 1), F.col("last"))).alias("day"))
    return calendar.join(per_day, "day", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def latest_per(rows: DataFrame, key: str, moment: str, tie: str, *columns: str) -> DataFrame:
    """For each key the columns of its newest row; one aggregation, no sort."""
    newest = F.max_by(F.struct(*columns), F.struct(F.col(moment), F.col(tie)))
    return rows.groupBy(key).agg(newest.alias("__row")).select(key, "__row.*")


def first_copies(rows: DataFrame, keys: list[Column], moment: str, key: str) -> DataFrame:
    """Every row with ``first_id``: the earliest row with the same keys. Rows with a NULL first key are their own first."""
    named = rows.select(F.col(key).alias("id"), F.col(moment).alias("__at"), *[k.alias(f"__k{i}") for i, k in enumerate(keys)])
    groups = [f"__k{i}" for i in range(len(keys))]
    # an aggregation before the join back: a key that a third of the rows share costs one row per partition
    firsts = named.filter("__k0 is not null").groupBy(*groups).agg(F.min_by("id", F.struct("__at", "id")).alias("first_id"))
    condition = [named[g].eqNullSafe(firsts[g]) for g in groups]
    joined = named.join(firsts, condition, "left")
    return joined.select(named["id"], F.coalesce("first_id", named["id"]).alias("first_id"))


def signature(data: Column) -> Column:
    """Text that is equal for maps with equal entries, whatever their order; NULL and empty values count as absent."""
    entries = F.filter(F.map_entries(data), lambda e: e["value"].isNotNull() & (e["value"] != ""))
    return F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(e["key"], F.lit("\x1f"), e["value"])), "\x1e")


def coalesced_lookup(keys: DataFrame, key: str, scoped: DataFrame, general: DataFrame, value: str) -> DataFrame:
    """Each key with its own value, else with the general one (a single row)."""
    own = scoped.select(F.col(key), F.col(value).alias("__own"))
    return keys.join(own, key, "left").crossJoin(F.broadcast(general.select(F.col(value).alias("__general")).limit(1))).select(key, F.coalesce("__own", "__general").alias(value))


def any_value_contains(data: Column, needle: str) -> Column:
    return F.exists(F.map_values(data), lambda v: F.contains(F.lower(v), F.lit(needle.lower())))


def sessions(rows: DataFrame, key: str, moment: str, gap_seconds: float, tie: str) -> DataFrame:
    """Rows with ``session``: 1, 2, ... within a key, a new one where at least ``gap_seconds`` passed since the row before."""
    order = Window.partitionBy(key).orderBy(moment, tie)
    since = F.unix_micros(F.col(moment)) - F.unix_micros(F.lag(moment).over(order))
    fresh = F.when(since.isNull() | (since >= int(gap_seconds * 1_000_000)), 1).otherwise(0)
    return rows.withColumn("__new", fresh).withColumn("session", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that aren't unique, with their number of rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
