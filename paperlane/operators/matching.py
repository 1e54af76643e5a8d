"""Master values in document text: candidates, scores, best per field, decisions and learned spellings.

Two texts in normal form match exactly if they are equal or the value stands in the unit; else by edits, if at most
18 of 100 characters of the value differ.  That bound gives lossless blocking: a value of n characters allows
k = floor(18 n / 100) edits, so of k + 1 trigrams that don't overlap one survives as it is.  The value emits those k + 1 that fewest units
of its company have (none for one that no unit has), the unit its distinct trigrams; the equi-join on them finds every
pair that can match, and the score is computed for those only.  What many names share, such as the form of a company, is thus a
key only of names that are too short to have k + 1 trigrams beside it.  Values of two characters are looked up among
the unit's pairs of characters.

Orders are explicit: score, then canonical before learned, then value, then unit.
"""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlane.functions.markdown import text_units
from paperlane.functions.text import normal_form
from paperlane.sources import checkpoints

THRESHOLD = 0.82
#: Keys of 8 bytes that are broadcast at most; more of them are joined by shuffle.
MOST_BROADCAST = 2_000_000


def matchable_values(records: DataFrame, types: DataFrame) -> DataFrame:
    """(company_id, master_record_id, master_type_id, field_key, value, norm, value_ord): values that text is searched for."""
    fields = types.select(F.col("id").alias("master_type_id"), F.posexplode("fields").alias("value_ord", "f")).filter("f.matchable").select("master_type_id", "value_ord", F.col("f.key").alias("field_key"))
    joined = records.select("company_id", F.col("id").alias("master_record_id"), "master_type_id", "data").join(fields, "master_type_id")
    values = joined.withColumn("value", F.trim(F.try_element_at("data", "field_key"))).filter("value is not null").withColumn("norm", normal_form(F.col("value")))
    return values.filter(F.length("norm") >= 2).drop("data")


def alias_values(records: DataFrame, values: DataFrame) -> DataFrame:
    """Learned spellings of matchable values: as :func:`matchable_values`, with ``alias_norm``."""
    spelled = records.select(F.col("id").alias("master_record_id"), F.posexplode("aliases").alias("alias_ord", "a")).select("master_record_id", "alias_ord", F.col("a.field_key").alias("field_key"), normal_form(F.col("a.text")).alias("alias_norm"))
    return values.join(spelled.filter(F.length("alias_norm") >= 2), ["master_record_id", "field_key"])


def units(pages: DataFrame, *keys: str, text: str = "markdown") -> DataFrame:
    """(*keys, unit_ord, unit, unit_norm) of each text unit of a page."""
    return pages.select(*keys, F.posexplode(text_units(F.col(text))).alias("unit_ord", "unit")).withColumn("unit_norm", normal_form(F.col("unit"))).filter(F.length("unit_norm") > 0)


def score(value: Column, unit: Column) -> Column:
    """1 for a value equal to or within the unit, else the similarity if it reaches the threshold, else NULL; of normal forms."""
    n = F.length(value)
    # lengths that differ by more than the edits allow are no match, whatever the letters
    similar = F.when(F.abs(F.length(unit) - n) <= F.floor(18 * n / 100), 1.0 - F.levenshtein(value, unit) / n)
    return F.when((value == unit) | (F.instr(unit, value) > 0), 1.0).when((F.length(unit) <= 2 * n + 6) & (similar >= THRESHOLD), similar)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _least_places(counts: pd.Series, wanted: pd.Series) -> pd.Series:
    """The places of ``wanted`` grams, three or more apart, whose counts have the least sum; counts are in order of place."""
    out = []
    for df, k in zip(counts, wanted, strict=True):
        n, k = len(df), int(k)
        # best[j][p]: least sum of j grams from place p on
        best = [[0.0] * (n + 3)] + [[float("inf")] * (n + 3) for _ in range(k)]
        for j in range(1, k + 1):
            for p in range(n - 1, -1, -1):
                best[j][p] = min(best[j][p + 1], float(df[p]) + best[j - 1][min(p + 3, n + 2)])
        places, p = [], 0
        for j in range(k, 0, -1):
            while p < n and best[j][p] == best[j][p + 1]:
                p += 1
            if p < n:
                places.append(p)
            p = min(p + 3, n)
        out.append(places)
    return pd.Series(out)


def rarest_keys(values: DataFrame, text: str, wanted: Column, units: DataFrame, unit: str, scope: str) -> DataFrame:
    """(scope, text, key): of each value ``wanted`` trigrams that don't overlap and that fewest ``units`` (scope, unit) have.

    A trigram that no unit has gives no key, as no unit can match by it.  A key is the hash of scope and trigram.
    """
    grams = values.select(scope, text, wanted.cast("int").alias("__wanted"), F.posexplode(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3)))).alias("place", "k")).withColumn("key", F.xxhash64(scope, "k"))
    df = _with_keys(units, unit, 3, scope, grams).groupBy("key").agg(F.count("*").alias("__df"))
    counted = grams.join(df, "key", "left").groupBy(scope, text, "__wanted").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("__df", F.lit(0)).alias("df"), "key"))).alias("__grams"))  # of one value
    placed = counted.withColumn("__places", _least_places(F.col("__grams.df"), "__wanted"))
    return placed.select(scope, text, F.explode(F.filter(F.transform("__places", lambda p: F.get("__grams", p)), lambda g: g["df"] > 0)["key"]).alias("key")).distinct()


def _with_keys(units: DataFrame, unit: str, k: int, scope: str, keyed: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(scope, unit, key) of the grams of ``units`` whose key ``keyed`` has.

    At most ``most_broadcast`` keys of 8 bytes are broadcast, so that only grams that matter leave the scan; more of them are joined by shuffle.
    """
    keys = keyed.select("key").distinct()
    grams = units.select(scope, unit, F.explode(_grams(F.col(unit), k)).alias("k")).select(scope, unit, F.xxhash64(scope, "k").alias("key"))
    return grams.join(F.broadcast(keys) if keys.count() <= most_broadcast else keys, "key", "left_semi")


def _meeting(units: DataFrame, unit: str, k: int, scope: str, keyed: DataFrame, text: str) -> DataFrame:
    """(scope, text, unit) of the pairs that share a key."""
    return _with_keys(units, unit, k, scope, keyed).join(keyed.select(F.col(scope).alias("__scope"), text, "key"), "key").filter(F.col(scope) == F.col("__scope")).select(scope, text, unit)


def _grams(norm: Column, k: int) -> Column:
    found = F.transform(F.sequence(F.lit(1), F.length(norm) - (k - 1)), lambda i: F.substring(norm, i, F.lit(k)))
    return F.array_distinct(F.when(F.length(norm) >= k, found).otherwise(F.array().cast("array<string>")))


def candidates(values: DataFrame, found: DataFrame, scope: str = "company_id") -> DataFrame:
    """Values with the units of their company that they may match, each pair once; found by the pigeonhole keys.

    Texts are made distinct before they are cut up; keys that no value has are dropped by the join's bloom filter or broadcast.
    """
    v, u = values.select(scope, "norm").distinct(), found.select(scope, "unit_norm").distinct()
    u = checkpoints.cut(u)
    long, short = v.filter(F.length("norm") >= 3), v.filter(F.length("norm") == 2).withColumn("key", F.xxhash64(scope, "norm"))
    keyed = checkpoints.cut(rarest_keys(long, "norm", F.floor(18 * F.length("norm") / 100) + 1, u, "unit_norm", scope))
    pairs = _meeting(u, "unit_norm", 3, scope, keyed, "norm").unionByName(_meeting(u, "unit_norm", 2, scope, short, "norm"))
    # most pairs share a trigram by chance: the score is checked before pairs are made distinct
    return pairs.withColumn("score", score(F.col("norm"), F.col("unit_norm"))).filter("score is not null").distinct()


def contained(lines: DataFrame, values: DataFrame, scope: str, line: str, value: str) -> DataFrame:
    """``lines`` with each ``value`` of their scope that stands in ``line``, each pair of row and value once; values of one character or more.

    Lines are made distinct before they are cut up; a value is looked up by the rarest of its trigrams (shorter ones by themselves).
    """
    v, u = values.select(scope, value).distinct(), lines.select(scope, line).distinct()
    u = checkpoints.cut(u)
    keyed = checkpoints.cut(rarest_keys(v.filter(F.length(value) >= 3), value, F.lit(1), u, line, scope))
    met = _meeting(u, line, 3, scope, keyed, value)
    for k in (2, 1):
        met = met.unionByName(_meeting(u, line, k, scope, v.filter(F.length(value) == k).withColumn("key", F.xxhash64(scope, value)), value))
    return lines.join(met.filter(F.contains(line, value)).distinct(), [scope, line])


def best_matches(pages: DataFrame, records: DataFrame, types: DataFrame) -> DataFrame:
    """The best unit of each page for each (record, field).

    ``pages`` has (company_id, page_id, ocr_result_id, markdown).  A learned spelling that equals a unit counts 1 and beats a
    similar canonical value, but not one that is there exactly.
    """
    values = matchable_values(records, types)
    found = checkpoints.cut(units(pages, "company_id", "page_id", "ocr_result_id"))
    scored = checkpoints.cut(candidates(values, found))
    spelled = checkpoints.cut(alias_values(records, values))
    # only units that some value or spelling meets are moved
    keys = scored.select(F.xxhash64("company_id", "unit_norm").alias("key")).unionByName(spelled.select(F.xxhash64("company_id", "alias_norm").alias("key"))).distinct()
    met = checkpoints.cut(found.withColumn("key", F.xxhash64("company_id", "unit_norm")).join(F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys, "key", "left_semi").drop("key"))
    canonical = values.join(scored, ["company_id", "norm"]).join(met, ["company_id", "unit_norm"]).withColumn("pass", F.lit(0)).withColumn("alias_ord", F.lit(0))
    learned = spelled.join(met.withColumnRenamed("company_id", "__company"), (F.col("alias_norm") == F.col("unit_norm")) & (F.col("company_id") == F.col("__company"))).drop("__company").withColumn("score", F.lit(1.0)).withColumn("pass", F.lit(1))
    columns = ["company_id", "page_id", "ocr_result_id", "master_record_id", "master_type_id", "field_key", "value", "norm", "unit", "unit_norm", "unit_ord", "score", "pass", "alias_ord"]
    every = canonical.select(*columns).unionByName(learned.select(*columns))
    rank = F.struct(F.col("score"), -F.col("pass"), -F.col("alias_ord"), -F.col("unit_ord"))
    best = every.groupBy("company_id", "page_id", "ocr_result_id", "master_record_id", "master_type_id", "field_key").agg(F.max_by(F.struct("value", "norm", "unit", "unit_norm", "score", "pass"), rank).alias("b"))
    inside = (F.col("b.score") == 1) & (F.col("b.pass") == 0)
    return best.select(
        "company_id", "page_id", "ocr_result_id", "master_record_id", "master_type_id", "field_key", F.col("b.value").alias("master_value"),
        F.when(inside, F.col("b.value")).otherwise(F.col("b.unit")).alias("matched_text"), F.round("b.score", 4).alias("score"),
        F.when(F.col("b.score") == 1, "exact").otherwise("fuzzy").alias("kind"), (F.col("b.pass") == 1).alias("is_alias"))


def proposals(best: DataFrame, decided: DataFrame) -> DataFrame:
    """Best matches whose (page, record, field, text) nobody has linked or dismissed."""
    keys = ["page_id", "master_record_id", "field_key", "matched_text"]
    return best.join(decided.filter("status <> 'suggested'").select(*keys), keys, "left_anti")


def after_rematch(matches: DataFrame, best: DataFrame) -> DataFrame:
    """The match table after matching again: decisions stay, suggestions are replaced, learned spellings are linked."""
    kept = matches.filter("status <> 'suggested'")
    fresh = proposals(best, matches).withColumn("status", F.when(F.col("is_alias"), "linked").otherwise("suggested"))
    return kept.unionByName(fresh.select(*[c for c in kept.columns if c in fresh.columns]), allowMissingColumns=True)


def replaced_text(text: Column, replacements: Column) -> Column:
    """Text after replacing, in order, each struct(matched, value): all occurrences; those no longer there are skipped."""
    return F.aggregate(replacements, text, lambda t, r: F.replace(t, r["matched"], r["value"]))


class Linked(NamedTuple):
    """Tables after links were confirmed, with the corrections to record and the links refused (id, reason)."""

    matches: DataFrame
    results: DataFrame
    records: DataFrame
    corrections: DataFrame
    refused: DataFrame


def linked(matches: DataFrame, results: DataFrame, records: DataFrame, chosen: DataFrame) -> Linked:
    """Confirmed matches carried through: ``chosen`` has (id, linked_by, linked_at).

    The matched text becomes the master value everywhere in the result's markdown and layout, in order of match ids; a text that is no longer
    there is refused as stale. Each change is an approved correction with the text before and after, and teaches the record the
    spelling as an alias. Links made before stay as they are; unknown ids are refused.
    """
    wanted = chosen.dropDuplicates(["id"]).withColumnRenamed("linked_by", "__by").withColumnRenamed("linked_at", "__at").join(matches.dropDuplicates(["id"]), "id", "left").filter("status is null or status <> 'linked'")
    found = wanted.join(results.select(F.col("id").alias("ocr_result_id"), F.col("markdown").alias("__text")), "ocr_result_id", "left")
    steps = F.array_sort(F.collect_list(F.when(F.col("__text").isNotNull(), F.struct("id", "matched_text", "master_value"))))  # the links of one result
    by_result = found.groupBy("ocr_result_id").agg(F.first("__text").alias("text"), steps.alias("steps"))
    state = "struct<text:string,done:array<struct<id:string,before:string,after:string,matched:string,value:string>>>"

    def step(s: Column, m: Column) -> Column:
        after = F.replace(s["text"], m["matched_text"], m["master_value"])
        there = F.contains(s["text"], m["matched_text"])
        entry = F.struct(m["id"].cast("string").alias("id"), s["text"].alias("before"), after.alias("after"), m["matched_text"].alias("matched"), m["master_value"].alias("value"))
        return F.when(m["matched_text"] == m["master_value"], F.struct(s["text"].alias("text"), s["done"].alias("done"))).when(there, F.struct(after.alias("text"), F.array_append(s["done"], entry).alias("done"))).otherwise(F.struct(s["text"].alias("text"), s["done"].alias("done"))).cast(state)

    folded = by_result.withColumn("state", F.aggregate("steps", F.struct(F.col("text"), F.array().cast(state.removeprefix("struct<text:string,done:").removesuffix(">")).alias("done")).cast(state), step))
    folded = checkpoints.cut(folded.select("ocr_result_id", "state.text", "state.done"))
    done = folded.select("ocr_result_id", F.explode("done").alias("c")).select("ocr_result_id", "c.id", F.col("c.before").alias("original_markdown"), F.col("c.after").alias("corrected_markdown"))
    same = F.col("matched_text") == F.col("master_value")
    judged = found.withColumn("id", F.col("id").cast("string")).join(done.select("id", F.lit(True).alias("__changed")), "id", "left")
    reason = F.when(F.col("status").isNull(), "no such match").when(F.col("__text").isNull(), "no such result").when(~same & F.col("__changed").isNull(), "matched text no longer there")
    judged = checkpoints.cut(judged.withColumn("__reason", reason))
    accepted = judged.filter("__reason is null")
    now = accepted.select(F.col("id").alias("__id"), "__by", "__at")
    kept = matches.join(now, F.col("id").cast("string") == F.col("__id"), "left")
    after = kept.select(*[{"status": F.when(F.col("__id").isNotNull(), "linked").otherwise(F.col("status")), "linked_by": F.when(F.col("__id").isNotNull(), F.col("__by")).otherwise(F.col("linked_by")), "linked_at": F.when(F.col("__id").isNotNull(), F.col("__at")).otherwise(F.col("linked_at"))}.get(c, F.col(c)).alias(c) for c in matches.columns])
    changes = folded.filter("size(done) > 0").select("ocr_result_id", F.col("text").alias("__new"), F.transform("done", lambda c: F.struct(c["matched"].alias("matched"), c["value"].alias("value"))).alias("__steps"))
    renewed = results.join(changes, results["id"] == changes["ocr_result_id"], "left")
    layout = F.aggregate(F.coalesce("__steps", F.array().cast("array<struct<matched:string,value:string>>")), F.col("layout_json"), lambda t, c: F.replace(t, _json_text(c["matched"]), _json_text(c["value"]))) if "layout_json" in results.columns else None
    renewed = renewed.select(*[F.coalesce("__new", "markdown").alias(c) if c == "markdown" else layout.alias(c) if c == "layout_json" else results[c] for c in results.columns])
    spelled = accepted.filter(~same).groupBy("master_record_id").agg(F.array_sort(F.collect_set(F.struct("field_key", "matched_text", normal_form(F.col("matched_text")).alias("norm"), normal_form(F.col("master_value")).alias("value")))).alias("__new"))  # the links of one record
    taught = records.join(spelled, records["id"] == spelled["master_record_id"], "left")
    folded_aliases = F.aggregate("__new", F.coalesce("aliases", F.array().cast(dict(records.dtypes)["aliases"])), lambda a, m: learned_aliases(a, m["field_key"], m["matched_text"], m["value"], F.lit(None).cast("string"), m["norm"]).cast(dict(records.dtypes)["aliases"]))
    taught = taught.select(*[F.when(F.col("__new").isNull(), F.col("aliases")).otherwise(folded_aliases).alias(c) if c == "aliases" else records[c] for c in records.columns])
    corrections = done.select(F.col("id").alias("match_id"), "ocr_result_id", "original_markdown", "corrected_markdown", F.lit("approved").alias("status"))
    return Linked(after, renewed, taught, corrections, judged.filter("__reason is not null").select("id", F.col("__reason").alias("reason")))


def _json_text(text: Column) -> Column:
    """A text as it stands between the quotes of a JSON string."""
    quoted = F.to_json(F.struct(text.alias("v")))
    return F.substring(quoted, F.lit(7), F.length(quoted) - 8)


def field_candidates(documents: DataFrame) -> DataFrame:
    """(document_id, key, value, page_number, type) of extracted fields (document_id, extracted_json) that names may stand in: with a value and a
    page, and neither date nor amount nor number."""
    schema = "fields array<struct<key:string,value:string,page_number:int,type:string>>"
    fields = documents.select("document_id", F.explode(F.from_json("extracted_json", schema)["fields"]).alias("f")).select("document_id", "f.*")
    return fields.filter("trim(value) <> '' and page_number <> 0 and coalesce(type, '') not in ('date', 'amount', 'number')")


def document_field_matches(documents: DataFrame, pages: DataFrame, matches: DataFrame) -> DataFrame:
    """The best match of each extracted field on its page: :func:`field_candidates` through :func:`field_matches`."""
    placed = field_candidates(documents).join(pages.select("document_id", "page_number", F.col("id").alias("page_id")), ["document_id", "page_number"])
    return field_matches(placed, matches)


def dismissed(matches: DataFrame, chosen: DataFrame) -> DataFrame:
    """Matches with the ``chosen`` (id) dismissed."""
    marked = matches.join(chosen.select("id").distinct().withColumn("__gone", F.lit(True)), "id", "left")
    return marked.withColumn("status", F.when(F.col("__gone"), "dismissed").otherwise(F.col("status"))).select(*matches.columns)


def learned_aliases(aliases: Column, field: Column, text: Column, master_value: Column, canonical: Column, norm: Column | None = None) -> Column:
    """Aliases with a new spelling, if it is a genuine variant that isn't known; arguments in normal form but for ``text``, whose own is ``norm``."""
    norm = normal_form(text) if norm is None else norm
    known = F.coalesce(aliases, F.array().cast("array<struct<field_key:string,text:string>>"))
    genuine = (F.length(norm) >= 2) & (norm != master_value) & ~norm.eqNullSafe(canonical)
    there = F.exists(known, lambda a: a["field_key"].eqNullSafe(field) & a["text"].eqNullSafe(text))  # a NULL alias hides nothing
    return F.when(genuine & ~there, F.array_append(known, F.struct(field.alias("field_key"), text.alias("text")))).otherwise(known)


def without_alias(aliases: Column, field: Column, text: Column) -> Column:
    return F.filter(aliases, lambda a: ~((a["field_key"] == field) & (a["text"] == text)))


def field_matches(fields: DataFrame, matches: DataFrame) -> DataFrame:
    """For each extracted field (document_id, page_id, key, value) the page's match that contains it or is contained, best score first."""
    f = fields.withColumn("v", normal_form(F.col("value"))).filter(F.length("v") >= 2)
    m = matches.filter("status <> 'dismissed'").select("page_id", F.col("id").alias("match_id"), "score", F.explode(F.array("matched_text", "master_value")).alias("t"))
    m = m.withColumn("t", normal_form(F.col("t"))).filter(F.length("t") > 0)
    met = f.join(m, "page_id").filter((F.instr("v", F.col("t")) > 0) | (F.instr("t", F.col("v")) > 0))
    return met.groupBy("document_id", "key").agg(F.max_by("match_id", F.struct("score", "match_id")).alias("match_id"), F.max("score").alias("score"))
