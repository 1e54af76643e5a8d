"""Deeply nested JSON records as flat tables that keep parent and child together.

Each record is parsed once per executor batch.  A bottom-up tree automaton gives every object a state: the
sorted list of its member names, each with the state class of its value (``null``, ``bool``, ``number``,
``text``, ``array<...>`` of the states of its elements, or the state of an object).  Objects of one state have
one shape, so the state's hash is the *variant* that names the typed subtype table of the object; objects at one
*role* (their path without positions) share the supertype keys that all its variants have.

Defined results: NULL, blank, cut or otherwise invalid JSON gives no rows; a record that is a JSON string holding
JSON is read as that JSON, at any number of wrappings; records without objects in arrays give no element rows.
Repeated member names keep the last value, as JSON parsers do.  Depth is limited by memory only.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_SCHEMA = T.StructType([
    T.StructField("record_id", T.StringType()),
    T.StructField("parent_path", T.StringType()),
    T.StructField("node_path", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("variant", T.StringType()),
    T.StructField("is_element", T.BooleanType()),
    T.StructField("kinds", T.MapType(T.StringType(), T.StringType())),
    T.StructField("members", T.MapType(T.StringType(), T.StringType())),
])

_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?))', re.ASCII)


class NotJson(ValueError):
    """The text is no complete JSON value."""


def _reject(name: str) -> Any:
    raise NotJson(name)


_DECODER = json.JSONDecoder(parse_constant=_reject)


def _parse_deep(text: str) -> Any:
    """Parser without recursion, for records nested deeper than the interpreter's stack."""
    root: list[Any] = []
    stack: list[Any] = [root]
    keys: list[str | None] = [None]
    want, pos = "value", 0  # value, first (value or closing), key, firstkey, colon, after
    end = len(text.rstrip(" \t\n\r"))
    while pos < end:
        m = _TOKEN.match(text, pos)
        if not m or want == "done":
            raise NotJson(f"at {pos}")
        pos = m.end()
        mark, string, scalar = m.groups()
        top = stack[-1]
        if mark in ("}", "]"):
            if len(stack) == 1 or isinstance(top, dict) != (mark == "}") or want not in ("after", "first", "firstkey"):
                raise NotJson(f"at {pos}")
            stack.pop()
            keys.pop()
            want = "after"
        elif mark == ",":
            if want != "after" or len(stack) == 1:
                raise NotJson(f"at {pos}")
            want = "key" if isinstance(top, dict) else "value"
        elif mark == ":":
            if want != "colon":
                raise NotJson(f"at {pos}")
            want = "value"
        elif want in ("key", "firstkey"):
            if string is None:
                raise NotJson(f"at {pos}")
            keys[-1] = json.loads(string)
            want = "colon"
        elif want in ("value", "first"):
            value: Any = {} if mark == "{" else [] if mark == "[" else json.loads(string or scalar)
            if isinstance(top, dict):
                top[keys[-1]] = value
            else:
                top.append(value)
            if mark:
                stack.append(value)
                keys.append(None)
                want = "firstkey" if mark == "{" else "first"
            else:
                want = "after"
        else:
            raise NotJson(f"at {pos}")
        if len(stack) == 1 and want == "after":
            want = "done"
    if want != "done":
        raise NotJson("cut")
    return root[0]


def parse(text: str | None) -> Any:
    """The value of a record, unwrapped from JSON strings; raises NotJson."""
    value: Any = text
    if text is None:
        raise NotJson("null")
    while isinstance(value, str):
        text = value.strip(" \t\n\r")
        try:
            value, at = _DECODER.raw_decode(text)
        except RecursionError:
            value, at = _parse_deep(text), len(text)
        except NotJson:
            raise
        except ValueError as error:
            raise NotJson(str(error)) from None
        if at != len(text):
            raise NotJson("more follows")
    return value


def _kind(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    return "number" if isinstance(value, (int, float)) else "text"


def _clean(text: str) -> str:
    return text.encode("utf-8", "replace").decode("utf-8")


def walk(value: Any) -> list[tuple[str, str, str, str, bool, dict[str, str], dict[str, str]]]:
    """(parent_path, node_path, role, variant, is_element, kinds, members) of each object, the record itself included.

    Two passes without recursion: top-down for paths, then bottom-up for the automaton's states.
    """
    # Only objects keep their paths, and a state lives until its parent has read it: arrays nested deeply cost no more than one path.
    order: list[tuple[Any, str, str, str, bool]] = []  # value, path, role, parent object's path, is element
    todo: list[tuple[Any, str, str, str, bool]] = [(value, "$", "$", "$", False)]
    while todo:
        v, path, role, parent, element = todo.pop()
        if isinstance(v, dict):
            order.append((v, path, role, parent, element))
            todo.extend((x, f"{path}.{k}", f"{role}.{k}", path, False) for k, x in v.items() if isinstance(x, (dict, list)))
        else:
            order.append((v, "", "", "", element))
            todo.extend((x, f"{path}[{i}]", f"{role}[]", parent, True) for i, x in enumerate(v) if isinstance(x, (dict, list)))
    state: dict[int, str] = {}
    rows = []
    for v, path, role, parent, element in reversed(order):
        if isinstance(v, list):
            kinds = sorted({state.pop(id(x)) if isinstance(x, (dict, list)) else _kind(x) for x in v})
            state[id(v)] = f"array<{'|'.join(kinds)}>"
            continue
        kinds = {_clean(k): state.pop(id(x)) if isinstance(x, (dict, list)) else _kind(x) for k, x in v.items()}
        variant = hashlib.md5("\x1f".join(f"{k}:{kinds[k]}" for k in sorted(kinds)).encode()).hexdigest()[:16]
        state[id(v)] = f"object<{variant}>"
        members = {_clean(k): _clean(x) if isinstance(x, str) else json.dumps(x) for k, x in v.items() if x is not None and not isinstance(x, (dict, list))}
        rows.append((_clean(parent), _clean(path), _clean(role), variant, element, kinds, members))
    return rows[::-1]


def _parsed(texts: pd.Series) -> Iterator[tuple[int, Any]]:
    for i, text in enumerate(texts):
        try:
            value = parse(text)
        except NotJson:
            continue
        if isinstance(value, (dict, list)):
            yield i, value


def nodes(records: DataFrame, record_id: str, text: str) -> DataFrame:
    """One row per object in the JSON column ``text``, with its path, its parent's path, role, variant and scalars."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.name for f in NODE_SCHEMA.fields]
        for batch in batches:
            ids = batch["record_id"].tolist()
            yield pd.DataFrame([(ids[i], *row) for i, value in _parsed(batch["text"]) for row in walk(value)], columns=names)

    picked = records.select(F.col(record_id).cast("string").alias("record_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    return picked.mapInPandas(run, NODE_SCHEMA)


def element_links(records: DataFrame, record_id: str, text: str) -> DataFrame:
    """(record_id, parent_path, node_path) of each object of :func:`nodes` that is an array's element."""
    return nodes(records, record_id, text).filter("is_element").select("record_id", "parent_path", "node_path")


def variants(flat: DataFrame) -> DataFrame:
    """Per role and variant: member kinds and number of objects."""
    return flat.groupBy("role", "variant").agg(F.count("*").alias("n"), F.first("kinds").alias("kinds"))


def supertypes(flat: DataFrame) -> DataFrame:
    """Per role: the keys that every variant of it has, and the number of its variants."""
    shapes = variants(flat).select("role", "variant", F.map_keys("kinds").alias("keys"))
    per_role = shapes.groupBy("role").agg(F.count("*").alias("n_variants"))
    keys = shapes.select("role", F.explode("keys").alias("key")).groupBy("role", "key").agg(F.count("*").alias("in_variants"))
    common = keys.join(per_role, "role").filter("in_variants = n_variants").groupBy("role").agg(F.array_sort(F.collect_list("key")).alias("common_keys"))
    return per_role.join(common, "role", "left").withColumn("common_keys", F.coalesce("common_keys", F.array().cast("array<string>")))


def _typed(key: str, kind: str) -> Column:
    value = F.col("members").getItem(key)
    kinds = {"number": "double", "bool": "boolean"}
    return value.cast(kinds.get(kind, "string"))


def subtype_table(flat: DataFrame, role: str, variant: str, kinds: dict[str, str]) -> DataFrame:
    """The typed table of one variant: link columns, then one typed column per scalar member.

    Member columns are named ``m_<name>`` so that a member called ``record_id`` can't clash with the links.
    """
    links = [F.col(c) for c in ("record_id", "parent_path", "node_path")]
    scalars = [k for k, kind in sorted(kinds.items()) if not kind.startswith(("object", "array"))]
    return flat.filter((F.col("role") == role) & (F.col("variant") == variant)).select(*links, *[_typed(k, kinds[k]).alias(f"m_{k}") for k in scalars])


def subtypes(flat: DataFrame) -> DataFrame:
    """The rows of the subtype tables of all variants, one row per object, routed by (role, variant).

    Scalar members are typed as in :func:`subtype_table`: ``numbers``, ``flags`` and ``texts``, the latter with the members
    that the variant knows as null only.  One pass over ``flat``, whatever the number of variants.
    """

    def of(*kinds: str) -> Column:
        return F.map_filter("kinds", lambda _, kind: kind.isin(*kinds))

    def typed(kind: str, type_name: str) -> Column:
        return F.transform_values(of(*([kind, "null"] if kind == "text" else [kind])), lambda key, _: F.col("members")[key].cast(type_name))

    links = ("role", "variant", "record_id", "parent_path", "node_path")
    return flat.select(*links, typed("number", "double").alias("numbers"), typed("bool", "boolean").alias("flags"), typed("text", "string").alias("texts"))
