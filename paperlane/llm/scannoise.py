"""Noise in text from scanned pages: words divided at line ends, misread characters, headers, footers, page numbers.

Misread words.  Tokens are words of alphabetic scripts and, for scripts without spaces, each character between its
neighbours.  Counts cover all pages.  Candidates come from inverted joins on character q-grams: words meet the frequent
words that share enough q-grams; a character meets the frequent ones between the same neighbours (the q-gram with a hole).
A pair (seen, meant) carries its counts, how many different tokens show the same confusion, how exclusive the confusion
is, and how much of the seen character's use it explains.  Gradient-boosted trees rank the candidates; they learn from
pages that were recognised more than once, where a token of one result stands in another's place.  All such pages are
counted, as the counts are evidence for the decision too; only the pairs that the trees are trained on are sampled
(``train_pairs``).

Divided words.  A logistic classifier decides for two lines whether the hyphen between them divides a word (the joined word's
count against the compound's), trained on pairs that the counts make sure.

Page numbers.  A line at a page's edge with a small number has a shape: the line with that number masked, as it reads and with its
words masked too.  How often lines of a shape, in other documents, carry their own page's number tells whether a shape is a page
number's; a line is one if its shape is and its number is the page's.

Furniture.  A classifier sees a pair of edge lines from neighbouring pages of a document: how alike they are, where they stand, the
line's length and form, and how often lines of its shape recur within other documents.  Its label comes from neither line of
the pair but from the document's further pages: whether one of them has the line too.  Headers that further pages lost make labels
incomplete, not wrong, so scores are divided by their mean over labelled cases.  A line is judged by its best pair, and its score alone
decides.  A number beside a header is a page number.

Everything but the classifiers' training rows (the least by hash, ``train``, ``train_pairs`` and ``weak_pairs`` of them) covers all pages.

Defined results: NULL, empty and blank pages have no noise; tables are never corrected; figures and codes are never
misread; pages whose document is unknown or has one page have no running header; pages without a number have no
page number; repeated rows are treated alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlane.llm.pii import EMAIL, view
from paperlane.llm.plainform import is_plain, plain
from paperlane.sources import checkpoints

_WORD = re.compile(r"(?<![\w.@-])[A-Za-zÀ-ÖØ-öø-ÿ0-9][A-Za-zÀ-ÖØ-öø-ÿ0-9]*(?:[’'][A-Za-zÀ-ÖØ-öø-ÿ0-9]+)?(?![\w@])")
_URL = re.compile(r"\b(?:www\.|https?://)\S+")
_CHAR = re.compile("[ぁ-ヿ㐀-鿿]")
_MARKS = "-‐‑­¬–"
_FIRM = re.compile(r"(?i)^(?:[^\W\d][\w'’&-]*,? ){1,5}(?:ltd|gmbh|sa|sarl|inc|co|works|industries|partners|logistics|kg|ag|corp|company|group)\.?$|^(?:株式会社|有限会社|合同会社)[㐀-鿿ァ-ヶー]{2,12}$|^[㐀-鿿ァ-ヶー]{2,12}(?:株式会社|有限会社|合同会社)$")
_SECRET = re.compile(r"(?i)^(confidential|confidentiel|vertraulich|internal|intern|interne|社外秘|秘|部外秘|c0nfidential)\b|^(社外秘|部外秘)")
_NUMBERED = re.compile(r"[A-Z]{1,4}-\d{3,}-\d{2,}")


def tokens(text: str, lines: list[str] | None = None) -> set[str]:
    """The distinct tokens of a page outside tables: ``w`` + word, or ``c`` + a character between its neighbours."""
    out: set[str] = set()
    joined, _ = view(text, lines)
    for line in joined.split("\n"):
        if not line or line[0] == "|":
            continue
        if "@" in line or "at" in line:
            line = EMAIL.sub(" ", line)
        if "www" in line or "http" in line:
            line = _URL.sub(" ", line)
        for m in _WORD.finditer(line):
            w = m.group()
            letters = len(w) if w.isalpha() else sum(map(str.isalpha, w))
            if letters >= 3 and len(w) - letters <= 2 and not (w.isupper() and len(w) > letters):
                out.add("w" + w)
        if _CHAR.search(line):
            s = "^" + re.sub(r"\d", "9", line) + "$"
            # a character that stands alone (letters spaced out) has no neighbours to be judged by
            out.update("c" + s[i - 1 : i + 2] for i in range(1, len(s) - 1) if _CHAR.match(s[i]) and not (s[i - 1] in " ^" and s[i + 1] in " $"))
    return out


#: A number of up to four digits that is no part of a longer one.
_SMALL = re.compile(r"(?<!\d)(?<!\d[.,:/-])\d{1,4}(?!\d)(?![.,:]\d)")
_APART = re.compile(r"[ 　]{2,}| [-–—|·] ")
_READ = (
    "row_id string, page string, doc string, results long, page_number int, pages int, tokens array<string>, cuts array<array<string>>, "
    "edges array<struct<k:int,line:string,form:string>>, numbers array<struct<k:int,value:int,shape:string,masked:string,beside:string>>"
)


def numbers_of(line: str) -> list[tuple[int, str, str, str | None]]:
    """(value, shape, masked shape, what stands beside it) of the small numbers that begin or end a line, or a part of it that stands apart."""
    bounds = [(m.start(), m.end()) for m in _APART.finditer(line)]
    parts = [(0, len(line), None)]
    if bounds:
        parts += [(0, bounds[0][0], line[bounds[0][1] :]), (bounds[-1][1], len(line), line[: bounds[-1][0]])]
    out = []
    for start, stop, beside in parts:
        part = line[start:stop]
        if beside is not None and not re.search(r"[^\W\d_]{2}|[^\W\d_] [^\W\d_]", beside):
            continue
        found = list(_SMALL.finditer(part))
        for m in found[:1] + found[1:][-1:]:
            shape = re.sub(r"\d", "9", part[: m.start()].casefold()) + "#" + re.sub(r"\d", "9", part[m.end() :].casefold())
            out.append((int(m.group()), shape, re.sub(r"[^\W\d_]+(?: [^\W\d_]+)*", "a", shape), beside))
    return out


def line_marks(lines: list[str]) -> tuple[list[tuple[str, str, str]], list[tuple[int, str, str, list]]]:
    """(divided words as (left, right, mark), edge lines as (place among lines, line, form, numbers)): the three first and last lines."""
    lines = [x.strip() for x in lines]
    cuts = []
    for a, b in zip(lines, lines[1:], strict=False):
        if a and b and a[-1] in _MARKS and (b[0].islower() or (b[0] in "0159" and b[1:2].islower())) and (m := re.search(rf"([A-Za-zÀ-ÿ’']+(?:-[A-Za-zÀ-ÿ]+)*)[ ]?([{_MARKS}]+)$", a)):
            cuts.append((m.group(1), re.match(r"[\w’']+", b).group(), m.group(2)))
    full = [x for x in lines if x]
    outer = sorted({k for k in (0, 1, 2, len(full) - 3, len(full) - 2, len(full) - 1) if 0 <= k < len(full)})
    return cuts, [(k, full[k], _edge_form(full[k]), numbers_of(full[k])) for k in outer]


def read(pages: DataFrame) -> DataFrame:
    """One row per page: its distinct tokens, divided words and edge lines. Texts are gone through once; all else is made from this table."""

    strings = pa.list_(pa.string())
    edge = pa.list_(pa.struct([("k", pa.int32()), ("line", pa.string()), ("form", pa.string())]))
    number = pa.list_(pa.struct([("k", pa.int32()), ("value", pa.int32()), ("shape", pa.string()), ("masked", pa.string()), ("beside", pa.string())]))
    kept = ["row_id", "page", "doc", "results", "page_number", "pages"]
    names = [*kept, "tokens", "cuts", "edges", "numbers"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            lines = [plain_lines(t) for t in texts]
            marks = [line_marks(x) for x in lines]
            made = [
                pa.array([list(tokens(t, x)) for t, x in zip(texts, lines, strict=True)], strings),
                pa.array([cuts for cuts, _ in marks], pa.list_(strings)),
                pa.array([[(k, line, form) for k, line, form, _ in edges] for _, edges in marks], edge),
                pa.array([[(k, *n) for k, _, _, found in edges for n in found] for _, edges in marks], number),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names)

    # pages come joined by their page, so counting a page's results moves nothing again
    known, alone = pages.filter("page is not null"), pages.filter("page is null").withColumn("results", F.lit(1).cast("long"))
    counted = known.withColumn("results", F.count("*").over(Window.partitionBy("page"))).unionByName(alone)
    typed = counted.select(*[F.col(c).cast(t).alias(c) for c, t in (("row_id", "string"), ("page", "string"), ("doc", "string"), ("results", "long"), ("page_number", "int"), ("pages", "int"), ("text", "string"))])
    return checkpoints.cut(typed.mapInArrow(run, _READ))


def counts_of(known: DataFrame) -> DataFrame:
    """(token, n): number of pages with each token."""
    return known.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def candidate_pairs(counted: DataFrame, ratio: float = 8.0, char_ratio: float = 4.0, least: int = 15) -> DataFrame:
    """(seen, meant, n_seen, n_meant, conf): tokens and the frequent tokens they may be misread from."""
    chars = counted.filter("startswith(token, 'c')").select("token", "n", F.concat(F.substring("token", 2, 1), F.substring("token", 4, 1)).alias("hole"), F.substring("token", 3, 1).alias("char"))
    top = chars.filter(F.col("n") >= least).select("hole", F.col("token").alias("meant"), F.col("n").alias("n_meant"), F.col("char").alias("to"))
    han = chars.join(top, "hole").filter((F.col("n") * char_ratio <= F.col("n_meant")) & (F.col("char") != F.col("to")))
    han = han.select(F.col("token").alias("seen"), "meant", F.col("n").alias("n_seen"), "n_meant", F.concat_ws(">", "char", "to").alias("conf"))
    words = counted.filter("startswith(token, 'w')").select(F.expr("substring(token, 2)").alias("word"), "n").filter("length(word) > 2")
    padded = F.concat(F.lit("\x01\x01"), F.lower("word"), F.lit("\x02\x02"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") + 2), lambda i: F.substring(padded, i, F.lit(3))))
    posted = words.withColumn("gram", F.explode(grams))
    frequent = posted.filter(F.col("n") >= least).select("gram", F.col("word").alias("meant"), F.col("n").alias("n_meant"))
    # k edits spoil at most 3 k trigrams of a word, so one of any 3 k + 1 survives: its rarest ones are enough
    edits = F.when(F.length("word") < 6, 1).otherwise(2)
    df = frequent.groupBy("gram").agg(F.count("*").alias("df"))
    rarest = Window.partitionBy("word").orderBy("df", "gram")
    probes = posted.join(df, "gram", "left").fillna(0, ["df"]).withColumn("rank", F.row_number().over(rarest)).filter((F.col("rank") <= 3 * edits + 1) & (F.col("df") > 0))
    near = probes.join(frequent, "gram").filter((F.col("n") * ratio <= F.col("n_meant")) & (F.abs(F.length("word") - F.length("meant")) <= 2))
    near = near.select("word", "meant", F.col("n").alias("n_seen"), "n_meant").distinct().filter(F.levenshtein("word", "meant", 2).between(1, edits))
    return han.unionByName(near.select(F.concat(F.lit("w"), "word").alias("seen"), F.concat(F.lit("w"), "meant").alias("meant"), "n_seen", "n_meant", _confusion()("word", "meant").alias("conf")))


def _confusion():
    @F.pandas_udf(T.StringType())
    def middle(seen: pd.Series, meant: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(seen, meant, strict=True):
            i = 0
            while i < min(len(a), len(b)) and a[i] == b[i]:
                i += 1
            j = 0
            while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
                j += 1
            x, y = a[i : len(a) - j], b[i : len(b) - j]
            out.append(f"{x}>{y}" if len(x) <= 2 and len(y) <= 2 else "~".join(sorted({f"{p}>{q}" for p, q in zip(x, y, strict=False) if p != q})) if len(x) == len(y) else "other")
        return pd.Series(out)

    return middle


def with_evidence(pairs: DataFrame, counted: DataFrame) -> DataFrame:
    """Pairs with the support and exclusiveness of their confusion and the share of the seen character's use that is dominated."""
    conf = pairs.groupBy("conf").agg(F.count_distinct("seen").alias("support"))
    conf = conf.withColumn("source", F.substring_index("conf", ">", 1))
    share = Window.partitionBy("source")
    conf = conf.withColumn("share", F.col("support") / F.sum("support").over(share)).drop("source")
    chars = counted.filter("startswith(token, 'c')").select("token", F.substring("token", 3, 1).alias("char"), "n")
    worse = pairs.select(F.col("seen").alias("token")).distinct().withColumn("worse", F.lit(1))
    used = chars.join(worse, "token", "left").groupBy("char").agg((F.sum(F.col("n") * F.coalesce("worse", F.lit(0))) / F.sum("n")).alias("dominated"))
    known = pairs.withColumn("source", F.when(F.col("seen").startswith("c"), F.substring("seen", 3, 1)).otherwise(F.col("conf")))
    spread = known.groupBy("source").agg(F.count_distinct("seen").alias("spread"))
    return known.join(conf, "conf").join(spread, "source").join(used.withColumnRenamed("char", "source"), "source", "left")


def _matrix(p: pd.DataFrame) -> np.ndarray:
    seen = p["seen"].str[1:]
    digit = seen.str.contains(r"\d", regex=True) & p["seen"].str.startswith("w")
    # a figure for a letter is told by what it stands for; other confusions by how often they are seen
    return np.column_stack((
        p["seen"].str.startswith("c"), np.log1p(p["n_seen"]), np.log1p(p["n_meant"]), np.log((p["n_meant"] + 1) / (p["n_seen"] + 1)), np.log1p(p["support"]),
        p["share"], p["dominated"].astype(float).fillna(-1.0), np.minimum(seen.str.len(), 20), digit, p["conf"].str.len(), np.log1p(p["spread"]),
        np.log((p["conf_yes"] + 1.0) / (p["conf_no"] + 1.0)), np.log((p["source_yes"] + 1.0) / (p["source_no"] + 1.0)),
    )).astype(float)


class Boosted:
    """Gradient-boosted trees of depth 3 for a yes-or-no label, on binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 40, rate: float = 0.25, bins: int = 16) -> None:
        heavy = x[weight >= 0.1 * weight.max()]  # rows of little weight draw no bounds
        self.edges = [np.unique(np.quantile(heavy[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = self._bin(x)
        mean = float(np.clip((weight * y).sum() / weight.sum(), 0.01, 0.99))
        self.base, self.rate, self.trees = np.log(mean / (1 - mean)), rate, []
        f = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(binned, weight * (y - p), weight * p * (1 - p), np.arange(len(y)), 3)
            self.trees.append(tree)
            f += rate * self._value(tree, binned)

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)])

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> tuple:
        leaf = (g[rows].sum() / (h[rows].sum() + 1.0),)
        if depth == 0 or len(rows) < 10:
            return leaf
        gain, split = 1e-3, None
        for j in range(x.shape[1]):
            k = len(self.edges[j]) + 1
            gs, hs = np.cumsum(np.bincount(x[rows, j], g[rows], k)), np.cumsum(np.bincount(x[rows, j], h[rows], k))
            score = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - gs[-1] ** 2 / (hs[-1] + 1)
            if len(score) and score.max() > gain:
                gain, split = score.max(), (j, int(score.argmax()))
        if split is None:
            return leaf
        low = x[rows, split[0]] <= split[1]
        return (*split, self._grow(x, g, h, rows[low], depth - 1), self._grow(x, g, h, rows[~low], depth - 1))

    def _value(self, tree: tuple, x: np.ndarray) -> np.ndarray:
        if len(tree) == 1:
            return np.full(len(x), tree[0])
        low = x[:, tree[0]] <= tree[1]
        out = np.empty(len(x))
        out[low], out[~low] = self._value(tree[2], x[low]), self._value(tree[3], x[~low])
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        binned = self._bin(x)
        f = self.base + self.rate * sum(self._value(t, binned) for t in self.trees)
        return 1 / (1 + np.exp(-f))


def clear(x: np.ndarray) -> np.ndarray:
    """Weak labels of pairs that no page shows twice: clear confusions."""
    return ((x[:, 3] > 2.5) & (((x[:, 0] == 1) & (x[:, 10] > 1) & (x[:, 6] > 0.8)) | ((x[:, 0] == 0) & ((x[:, 8] == 1) | (x[:, 4] > 1.3))))).astype(float)


def labelled(known: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs with the number of pages that show them misread (``yes``) and read alike twice (``no``), of (row_id, page, results, tokens)."""
    several = known.filter("results > 1").select("page", "results", F.col("row_id").alias("reading"), F.explode("tokens").alias("token"))
    seen = checkpoints.cut(several)
    counts = seen.groupBy("page", "token").agg(F.count("*").alias("k"))
    beside = seen.select("page", "reading", F.col("token").alias("meant"), F.lit(1).alias("beside"))
    with_pairs = seen.withColumnRenamed("token", "seen").join(pairs.select("seen", "meant"), "seen").join(beside, ["page", "reading", "meant"], "left")
    with_pairs = with_pairs.groupBy("page", "seen", "meant").agg(F.count("*").alias("k"), F.first("results").alias("results"), F.count("beside").alias("both"))
    judged = with_pairs.join(counts.select("page", F.col("token").alias("meant"), F.col("k").alias("k_meant")), ["page", "meant"], "left")
    # one result has the token and the other the one meant, in its place; a token that other results lack without having the
    # one meant stands in text that they don't have
    other_k = F.coalesce("k_meant", F.lit(0))
    yes = (F.col("k") < F.col("results")) & (F.col("k") + other_k == F.col("results")) & (F.col("both") == 0)
    no = (F.col("k") == F.col("results")) | (other_k == 0) | ((F.col("both") == F.col("k")) & (other_k == F.col("both")))
    return judged.groupBy("seen", "meant").agg(F.count_if(yes).alias("yes"), F.count_if(no).alias("no")).filter("yes + no > 0")


def misreadings(known: DataFrame, train_pairs: int = 20_000, weak_pairs: int = 2_000, weak: float = 20.0) -> tuple[DataFrame, DataFrame]:
    """((seen, meant), counted tokens): the best replacement of each misread token of (row_id, page, tokens).

    The trees are trained on at most ``train_pairs`` pairs that pages read twice show, and on ``weak_pairs`` that none shows, by weak
    labels that weigh as much as ``weak`` shown ones together: they decide only where hardly any page was read twice.
    """
    counted = checkpoints.cut(counts_of(known))
    pairs = with_evidence(checkpoints.cut(candidate_pairs(counted)), counted)
    labels = checkpoints.cut(labelled(known, pairs.select("seen", "meant")))
    pairs = pairs.join(labels, ["seen", "meant"], "left").fillna(0, ["yes", "no"])
    for key in ("conf", "source"):  # what the labels say of the same confusion
        said = pairs.groupBy(key).agg(F.sum("yes").alias(f"{key}_yes"), F.sum("no").alias(f"{key}_no"))
        pairs = pairs.join(said, key)
    pairs = checkpoints.cut(pairs)
    by_hash = F.xxhash64("seen", "meant")
    own, unseen = (pairs.filter(which).orderBy(by_hash).limit(most).toArrow().to_pandas() for which, most in (("yes + no > 0", train_pairs), ("yes + no = 0", weak_pairs)))
    y = (own["yes"] / (own["yes"] + own["no"])).to_numpy(float)
    weight = np.sqrt(own["yes"] + own["no"]).to_numpy(float)
    if len(own):
        weight *= np.where(y > 0.5, 0.5 / max((weight * (y > 0.5)).sum(), 1e-9), 0.5 / max((weight * (y <= 0.5)).sum(), 1e-9)) * weight.sum()
    for key in ("conf", "source"):  # without the pair's own labels, which other pairs don't have
        own[f"{key}_yes"] -= own["yes"]
        own[f"{key}_no"] -= own["no"]
    x = np.concatenate([_matrix(rows) for rows in (own, unseen) if len(rows)]) if len(own) + len(unseen) else np.zeros((1, 13))
    y, weight = np.append(y, clear(x[len(own) :])), np.append(weight, np.full(len(x) - len(own), weak / max(len(unseen), 1)))
    model = Boosted(x, y, weight)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[["seen", "meant", "n_meant"]].copy()
            p = model.probability(_matrix(batch)) if len(batch) else np.zeros(0)
            # pages that show this very pair count with the model's view as two more
            out["p"] = (batch["yes"] + 2 * p) / (batch["yes"] + batch["no"] + 2)
            # a confusion that no page shows must be seen in several words, or be a figure among letters; letters lost or
            # added must be shown often
            figure = batch["seen"].str.startswith("w") & batch["seen"].str.contains(r"\d", regex=True)
            shown = (batch["conf_yes"] + batch["source_yes"] > 0) | (batch["spread"] >= 3) | figure
            changed = batch["seen"].str.startswith("w") & batch["conf"].str.contains(r"^>|>$", regex=True)
            shown &= ~changed | (batch["conf_yes"] > 3 * batch["conf_no"] + 3)
            yield out[(out["p"] > 0.5) & shown]

    ranked = pairs.mapInPandas(run, "seen string, meant string, n_meant long, p double")
    best = checkpoints.cut(ranked.groupBy("seen").agg(F.max_by("meant", F.struct("p", "n_meant")).alias("meant")))
    return best.unionByName(_next_to_each_other(best, counted)), counted


def _next_to_each_other(best: DataFrame, counted: DataFrame, ratio: float = 4.0, least: int = 15) -> DataFrame:
    """Misread characters beside another misread one, which no frequent neighbours can show: found with both replaced."""
    single = best.filter("startswith(seen, 'c')").select(F.substring("seen", 3, 1).alias("a"), F.substring("meant", 3, 1).alias("b"), "seen")
    sure = checkpoints.cut(single.groupBy("a", "b").agg(F.count_distinct("seen").alias("n")).filter("n > 1").groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b")))  # pairs of single characters
    doubtful = counted.filter("startswith(token, 'c')").select(F.col("token").alias("seen"), "n", *[F.substring("token", k, 1).alias(f"a{k}") for k in (2, 3, 4)])
    for k, how in ((3, "inner"), (2, "left"), (4, "left")):
        doubtful = doubtful.join(sure.select(F.col("a").alias(f"a{k}"), F.col("b").alias(f"b{k}")), f"a{k}", how)
    doubtful = doubtful.select("seen", "n", F.concat(F.lit("c"), *[F.coalesce(f"b{k}", f"a{k}") for k in (2, 3, 4)]).alias("meant"))
    doubtful = doubtful.filter(F.col("seen") != F.col("meant")).join(best.select("seen"), "seen", "left_anti")
    frequent = counted.select(F.col("token").alias("meant"), F.col("n").alias("n_meant")).filter(F.col("n_meant") >= least)
    return doubtful.join(frequent, "meant").filter(F.col("n") * ratio <= F.col("n_meant")).select("seen", "meant")


def plain_lines(text: str) -> list[str]:
    return text.split("\n") if is_plain(text) else [plain(x) or "" for x in text.split("\n")]


def _edge_form(line: str) -> str:
    """A line in the form in which furniture repeats: letters spaced out are closed up, case and spaces are one."""
    if re.fullmatch(r"(?:\S ?(?:  )?){4,}", line) and sum(c == " " for c in line) * 2 >= len(line.replace("  ", " ")) - 2:
        line = re.sub(r"(?<=\S) (?=\S)", "", line)
    return re.sub(r"\s+", " ", line).casefold().strip()


def _form_flags(line: str) -> tuple[int, int, int]:
    numbered = _NUMBERED.search(line.upper())
    return int(bool(_FIRM.search(line)) and len(line) < 50), int(bool(_SECRET.search(line))), int(bool(numbered) and len(line) < 70 and not re.search(r"[.。]$", line))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 300) -> np.ndarray:
    x = np.column_stack((np.ones(len(x)), x))
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (w * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(beta))
        step = np.linalg.solve(hessian, x.T @ (w * (y - p)) - 0.5 * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def divided_words(cuts: DataFrame, counted: DataFrame, train: int = 20_000) -> DataFrame:
    """The rows of (left, right, mark, ...) whose hyphen divides a word."""
    words = counted.filter("startswith(token, 'w')").select(F.lower(F.substring("token", 2, 60)).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    keyed = cuts.withColumn("joined", F.lower(F.concat("left", "right")))
    found = keyed.join(words.select(F.col("word").alias("joined"), F.col("n").alias("n_joined")), "joined", "left")
    for side in ("left", "right"):
        found = found.withColumn("__k", F.lower(F.substring_index(side, "-", -1 if side == "left" else 1))).join(words.select(F.col("word").alias("__k"), F.col("n").alias(f"n_{side}")), "__k", "left").drop("__k")
    found = checkpoints.cut(found.fillna(0, ["n_joined", "n_left", "n_right"]).withColumn("odd", (~F.col("mark").isin("-")).cast("int")))
    x = [F.log1p(c) for c in ("n_joined", "n_left", "n_right")] + [F.col("odd").cast("double")]
    sure = F.when((F.col("n_joined") >= 5) | ((F.col("odd") == 1) & (F.col("n_left") + F.col("n_right") == 0)), 1.0).when((F.col("n_joined") <= 1) & (F.col("n_left") >= 20) & (F.col("n_right") >= 20) & (F.col("odd") == 0), 0.0)
    rows = found.withColumn("y", sure).filter("y is not null").orderBy(F.xxhash64("left", "right", "row_id")).limit(train).select("y", *[c.alias(f"x{i}") for i, c in enumerate(x)]).toArrow().to_pandas()
    beta = np.array([-1.0, 1.2, -0.3, -0.3, 3.0])
    if len(rows) and 0 < rows["y"].mean() < 1:
        beta = _logistic(rows[[f"x{i}" for i in range(4)]].to_numpy(float), rows["y"].to_numpy(float), np.ones(len(rows)))
    score = F.lit(float(beta[0]))
    for b, c in zip(beta[1:], x, strict=True):
        score = score + F.lit(float(b)) * c
    return found.filter(score > 0)


def page_numbers(known: DataFrame) -> DataFrame:
    """(row_id, k, own, beside) of the edge lines of pages as read that have their page's number: whether the line is that number, and else what
    stands beside it.

    A shape's share of lines that carry their page's number is counted over second and later pages, without the line itself, and starts from
    the share of its masked shape.
    """
    of = known.filter("page_number is not null").select("row_id", "page_number", F.explode("numbers").alias("number")).select("row_id", "page_number", "number.*")
    of = of.withColumn("equal", (F.col("value") == F.col("page_number")).cast("int")).withColumn("later", (F.col("page_number") > 1).cast("int"))
    judged = of
    for key in ("shape", "masked"):
        judged = judged.filter("equal = 1").join(of.groupBy(key).agg(F.sum("later").alias(f"n_{key}"), F.sum(F.col("equal") * F.col("later")).alias(f"eq_{key}")), key)
    equal, later = F.col("equal") * F.col("later"), F.col("later")
    masked = (F.col("eq_masked") - equal + 0.2) / (F.col("n_masked") - later + 2.0)
    share = (F.col("eq_shape") - equal + 10 * masked) / (F.col("n_shape") - later + 10)
    likely = judged.filter(share > 0.5)
    own = likely.groupBy("row_id", "k").agg(F.max(F.when(F.col("beside").isNull(), 1)).alias("alone"), F.max("beside").alias("beside"))
    # with something beside it, whether the line is furniture decides
    return own.select("row_id", "k", (F.col("alone").isNotNull() & F.col("beside").isNull()).alias("own"), "beside")


_FORM = "row_id string, k int, form string, beside boolean"


def furniture(known: DataFrame, own: DataFrame, train: int = 20_000) -> DataFrame:
    """(row_id, k, form, beside) of the edge lines that are running headers or footers; ``beside`` tells of a page number on the line.

    A page's outermost lines that aren't its number (``own``, of :func:`page_numbers`) are judged, where its document has several pages.
    """
    slim = F.transform("edges", lambda e: F.struct(e["k"].alias("k"), e["line"].rlike("^[|#]").alias("barred"), e["form"].alias("form")))
    several = known.filter("doc is not null and page_number is not null and pages > 1").select("row_id", "doc", "page_number", F.explode(slim).alias("e")).select("row_id", "doc", "page_number", "e.*")
    left = several.join(own, ["row_id", "k"], "left").filter("own is null or not own")
    ends = left.groupBy("row_id", "doc", "page_number").agg(*[pick(F.struct("k", "barred", "form", "beside"), "k").alias(n) for pick, n in ((F.min_by, "first"), (F.max_by, "last"))])
    both = ends.select("row_id", "doc", "page_number", F.explode(F.array(F.struct(F.lit(1).alias("top"), F.col("first").alias("l")), F.struct(F.lit(0).alias("top"), F.col("last").alias("l")))).alias("e"))
    lines = both.filter("not e.l.barred").select("row_id", "doc", "page_number", "e.top", "e.l.k", F.coalesce(_form_of()("e.l.beside"), "e.l.form").alias("form"), F.col("e.l.beside").isNotNull().alias("beside"))
    lines = checkpoints.cut(lines.dropDuplicates(["row_id", "k"]))

    page_lines = lines.select("doc", "page_number", "form").distinct()
    per_form = page_lines.groupBy("doc", "form").agg(F.count("*").alias("on_pages"))
    in_doc = page_lines.groupBy("doc").agg(F.count_distinct("page_number").alias("doc_pages"))
    # how often lines of a shape recur within documents
    shape = F.regexp_replace("form", r"\d", "9").alias("shape")
    by_doc = per_form.select("doc", shape, (F.col("on_pages") > 1).cast("int").alias("again")).groupBy("doc", "shape").agg(F.max("again").alias("again"))
    by_shape = by_doc.groupBy("shape").agg(F.count("*").alias("docs"), F.sum("again").alias("docs_again"))
    # pairs with the lines of the pages beside
    asked = lines.select("row_id", "k", "doc", "form", "page_number", F.explode(F.array(F.col("page_number") - 1, F.col("page_number") + 1)).alias("other_page"))
    other = page_lines.select("doc", F.col("page_number").alias("other_page"), F.col("form").alias("other"))
    longest = F.greatest(F.length("form"), F.length("other"), F.lit(1))
    apart = F.when(F.abs(F.length("form") - F.length("other")) <= 12, F.levenshtein("form", "other", 12)).otherwise(F.lit(-1))
    alike = F.when(apart < 0, F.lit(0.0)).otherwise(1 - apart / longest)
    near = asked.join(other, ["doc", "other_page"]).groupBy("row_id", "k").agg(
        F.max(alike).alias("alike"), F.count_distinct("other_page").alias("beside_pages"), F.count_distinct(F.when(F.col("form") == F.col("other"), F.col("other_page"))).alias("same_beside"))
    rows = lines.join(near, ["row_id", "k"], "left").fillna(0, ["alike", "beside_pages", "same_beside"]).join(per_form, ["doc", "form"]).join(in_doc, "doc")
    rows = rows.withColumn("shape", shape).join(by_doc, ["doc", "shape"]).join(by_shape, "shape")
    further = F.col("doc_pages") - 1 - F.col("beside_pages")
    rows = checkpoints.cut(rows.withColumn("label", F.when(further > 0, (F.col("on_pages") - 1 - F.col("same_beside") > 0).cast("int"))))
    sample = rows.filter("label is not null").orderBy(F.xxhash64("row_id", "k")).limit(train).select("label", "form", "top", "alike", "on_pages", "again", "docs", "docs_again").toArrow().to_pandas()
    # what is known before any page is read: a line that comes again is furniture, one that doesn't isn't
    prior = [[1 - k / 40, top, 3, 0, 0, 0, 0, 0, 0.5, 1] for k in range(5) for top in (0, 1)] + [[k / 8, top, 3, 0, 0, 0, 0, 0, 0.05, 1] for k in range(5) for top in (0, 1)]
    x = np.concatenate((_line_matrix(sample, False), prior))
    y = np.append(sample["label"].to_numpy(float), np.repeat([1.0, 0.0], 10))
    model = Boosted(x, y, np.ones(len(x)))
    seen = model.probability(x)
    whole = float((seen * y).sum() / y.sum())  # the share of furniture whose further pages show it

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            score = model.probability(_line_matrix(batch, True)) if len(batch) else np.zeros(0)
            yield batch.loc[score > 0.5 * whole, ["row_id", "k", "form", "beside"]]

    return rows.mapInPandas(run, _FORM)


def _form_of():
    @F.pandas_udf(T.StringType())
    def form(lines: pd.Series) -> pd.Series:
        return lines.map(_edge_form, na_action="ignore")

    return form


def _line_matrix(p: pd.DataFrame, whole: bool) -> np.ndarray:
    """Features of edge lines; with ``whole`` any page of the document may be the line's pair, not only those beside."""
    alike = p["alike"].to_numpy(float)
    if whole:
        alike = np.where(p["on_pages"] > 1, 1.0, alike)
    flags = np.array([_form_flags(f) for f in p["form"]], dtype=float).reshape(-1, 3)
    own = p["again"].to_numpy(float)
    docs = p["docs"].to_numpy(float) - 1
    rate = (p["docs_again"].to_numpy(float) - own + 0.1) / (docs + 1)
    return np.column_stack((
        alike, p["top"].to_numpy(float), np.log1p(p["form"].str.len().to_numpy(float)), p["form"].str.contains(r"[.。!?:]$").to_numpy(float), p["form"].str.contains(r"^\d").to_numpy(float),
        flags, rate, np.log1p(docs),
    ))


class Found(NamedTuple):
    """What is wrong with pages: replacements of tokens, divided words, furniture lines, page numbers, and the pages as read."""

    known: DataFrame
    replace: DataFrame
    divided: DataFrame
    lines: DataFrame
    numbers: DataFrame


def found(pages: DataFrame) -> Found:
    """The noise of pages (row_id, page, doc, page_number, pages, text)."""
    known = read(pages.filter("text is not null and row_id is not null"))
    replace, counted = misreadings(known)
    cuts = known.select("row_id", F.explode("cuts").alias("cut")).select("row_id", *[F.col("cut")[i].alias(n) for i, n in enumerate(("left", "right", "mark"))])
    own = checkpoints.cut(page_numbers(known))
    lines = checkpoints.cut(furniture(known, own))
    numbers = own.filter("own").select("row_id", "k").unionByName(lines.filter("beside").select("row_id", "k"))
    return Found(known, checkpoints.cut(replace), divided_words(cuts, counted), lines, numbers)


def noise(pages: DataFrame, most_broadcast: int = 300_000) -> DataFrame:
    """(row_id, noise) of pages (row_id, page, doc, page_number, pages, text).

    At most ``most_broadcast`` misread tokens are broadcast to the pages' tokens; more of them are joined by shuffle.
    """
    all_found = found(pages)
    seen = all_found.replace.select("seen")
    if seen.count() <= most_broadcast:
        seen = F.broadcast(seen)
    misread = all_found.known.select("row_id", F.explode("tokens").alias("seen")).join(seen, "seen", "left_semi")
    kinds = {"misread": misread, "hyphenation": all_found.divided, "running_header": all_found.lines, "page_number": all_found.numbers}
    named = [rows.select("row_id", F.lit(kind).alias("noise")) for kind, rows in kinds.items()]
    return named[0].unionByName(named[1]).unionByName(named[2]).unionByName(named[3]).distinct()


def repaired(text: str, meant: dict[str, str], divided: set[tuple[str, str]], gone: set[int], gone_lines: set[str] = frozenset()) -> str:
    """A page as continuous paragraphs: its lines ``gone`` (counted without blank ones) and ``gone_lines`` left out, divided words whole,
    misread words outside tables replaced."""
    out: list[str] = []
    k, width = -1, 0
    for line in text.split("\n"):
        k += bool((plain(line) or "").strip())
        if line.strip() and (k in gone or (gone_lines and (plain(line) or "").strip() in gone_lines)):
            continue
        if not line.strip() or line.startswith(("|", "#")):
            out.append(line.rstrip())
            continue
        fixed = _WORD.sub(lambda m: meant.get("w" + m.group(), "w" + m.group())[1:], line)
        s = "^" + fixed + "$"
        masked = re.sub(r"\d", "9", s)
        chars = list(s)
        for i in range(1, len(s) - 1):
            if (hit := meant.get("c" + masked[i - 1 : i + 2])) is not None:
                chars[i] = hit[2]
        fixed = "".join(chars[1:-1])
        before = out[-1] if out else ""
        # a line goes on below if it is as long as lines of running text are, or if the next begins in the middle of a sentence
        full = width >= (20 if _CHAR.search(before[-12:]) else 40) or (width >= 20 and fixed.lstrip()[:1].islower())
        joins = bool(before) and not before.startswith(("|", "#")) and full
        width = len(fixed)
        cut = re.search(rf"([A-Za-zÀ-ÿ’']+(?:-[A-Za-zÀ-ÿ]+)*)[ ]?([{_MARKS}]+)\s*$", before[-200:]) if before else None
        follows = re.match(r"[\w’']+", fixed)
        if cut and follows and (cut.group(1), follows.group()) in divided:
            out[-1] = before[: len(before) - len(before[-200:]) + cut.end(1)] + fixed
        elif joins and not re.search(r"[:：]$|^\d{4}[-年]", before):
            out[-1] = before + ("" if _CHAR.search(before[-1]) or before[-1] in "。、" else " ") + fixed.strip()
        else:
            out.append(fixed)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip("\n")


def repair(pages: DataFrame, out: str, regions: DataFrame | None = None) -> DataFrame:
    """``pages`` (row_id, page, doc, page_number, pages, text) with column ``out``: the repaired text; NULL stays NULL.

    With ``regions`` (row_id, text, ...), parts of these pages, they are repaired by what their pages show, and returned instead.  What a
    page needs (its replacements, divided words and lines) is joined to it, so nothing grows with the corpus but the tables.
    """
    all_found = found(pages)
    need = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b")).alias("need")
    lines = all_found.lines.select("row_id", "k").unionByName(all_found.numbers).distinct()
    texts = all_found.known.select("row_id", F.explode("edges").alias("e")).select("row_id", "e.k", "e.line").join(lines, ["row_id", "k"])
    needs = all_found.known.select("row_id", F.explode("tokens").alias("seen")).join(all_found.replace, "seen").select("row_id", need("t", F.col("seen"), F.col("meant")))
    needs = needs.unionByName(all_found.divided.select("row_id", need("c", F.col("left"), F.col("right"))))
    needs = needs.unionByName(texts.select("row_id", need("g", F.col("k").cast("string"), F.col("line"))))
    per_page = needs.groupBy("row_id").agg(F.collect_set("need").alias("__needs"))  # of one page
    by_line = regions is not None

    @F.pandas_udf(T.StringType())
    def put(texts: pd.Series, found: pd.Series) -> pd.Series:
        done = []
        for text, need in zip(texts, found, strict=True):
            rows = [] if need is None else [(x["kind"], x["a"], x["b"]) for x in need]
            gone = {(b if by_line else int(a)) for kind, a, b in rows if kind == "g"}
            done.append(None if text is None else repaired(text, {a: b for k, a, b in rows if k == "t"}, {(a, b) for k, a, b in rows if k == "c"}, set() if by_line else gone, gone if by_line else frozenset()))
        return pd.Series(done)

    return (regions if by_line else pages).join(per_page, "row_id", "left").withColumn(out, put("text", "__needs")).drop("__needs")
