"""New batches checked against everything accepted before, through a persistent chunk table.

What identifies a paper is what scanning never changes: its figures.  A document's figures, in page order, are one
stream of digits; a rolling hash over ``window`` digits sets content-defined boundaries, so an inserted number (a page
mark, a telephone number) changes the chunks around it only.  A document number is a chunk of its own.  A document of fewer than
``FEW`` digits is cut as a stream of its letters and digits instead, and must be covered nearly whole.

The store holds two tables, partitioned by batch and by a bucket of the scope (company): keys (scope, key, id), the file hashes
and whole streams with the first document that has each, and chunks (chunk, id, bytes, total, number, probe), the scope being part of a
chunk's hash.  A new batch is chunked alone; it reads the store's buckets of its own scopes, and of these the rows whose key or chunk
it has, never the history's texts.  Two documents are one paper if the bytes of their shared chunks cover enough of
the smaller one; different document numbers exclude it.  Accepting a batch writes its partitions, so that accepting it again
changes nothing; a document whose stream the store knows adds no chunks.

Candidates come from an exact filter: if the shared chunks cover a share ``t`` of the smaller document, then
one of them is among any of its chunks that make up more than ``1 - t`` of its bytes.  Each document probes with its rarest ones, by
the number of documents of the store and the batch that had a chunk when the document came; this is kept in the table.  Frequent chunks are thus
compared only where a document has nothing rarer, and no chunk is capped.  Copies (equal hash or stream) are linked to the first of
their group before any join, so groups of copies cost one row each.

Defined results: documents without hash, pages or text match nothing; the scope (company) must be equal, and NULL
scopes match nothing; hashes are compared by their 64 hex digits, whatever the case and the wrapping; repeated
rows of a document count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlane.sources import checkpoints

WIDE = "０１２３４５６７８９"
#: A document number, or a run of digits.
_FIGURES = r"(?<![A-Za-z0-9])[A-Z]{1,4}-[0-9]{3,}-[0-9]{2,}(?![0-9])|[0-9]+"


def figures(text: Column) -> Column:
    """The document numbers and digits of a text, all that chunks are made of; far shorter than the text."""
    return F.array_join(F.regexp_extract_all(F.translate(text, WIDE, "0123456789"), F.lit(_FIGURES), F.lit(0)), " ")


#: Documents with fewer digits than this are cut as letters and digits.
FEW = 12
BUCKETS = 16
KEYS = "scope string, key string, id string"
CHUNKS = "id string, number string, chunk long, bytes int, total int, cover double"


def letters(text: Column) -> Column:
    """The letters and digits of a text in lower case, for documents without figures."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def boundaries(stream: str, window: int, spread: int) -> np.ndarray:
    """Places behind each window of a stream whose rolling hash is 0 modulo ``spread``."""
    codes = np.frombuffer(stream.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(codes)
    if n < window:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        # sums of code * base^-i roll on: a window's hash is the difference of two of them, brought to one place
        powers = np.ones((2, n), np.uint64)
        powers[0, 1:], powers[1, 1:] = _INVERSE, _BASE
        down, up = np.cumprod(powers, axis=1, dtype=np.uint64)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((codes + np.uint64(1)) * down, dtype=np.uint64, out=sums[1:])
        rolled = (sums[window:] - sums[:-window]) * up[window - 1 :]
        mixed = (rolled ^ (rolled >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.flatnonzero((mixed >> np.uint64(33)) % np.uint64(spread) == 0) + window


def chunk_stream(stream: str, window: int = 3, spread: int = 4, least: int = 7) -> list[str]:
    """Chunks of a stream: a boundary behind each window whose hash is 0 modulo ``spread``, ``least`` characters apart or more."""
    out, start = [], 0
    for end in boundaries(stream, window, spread).tolist():
        if end - start >= least:
            out.append(stream[start:end])
            start = end
    if start < len(stream):
        out.append(stream[start:])
    return out


def chunks_of(figures: str, text: str) -> tuple[str | None, dict[str, int], bool]:
    """(document number, chunk -> bytes, whether they are of figures) of a document."""
    parts = figures.split()
    numbers = [p for p in parts if "-" in p]
    digits = "".join(p for p in parts if "-" not in p)
    of_figures = sum(map(len, parts)) >= FEW
    out: dict[str, int] = {}
    for piece in chunk_stream(digits) if of_figures else chunk_stream(text, 6, 8, 8):
        out[piece] = out.get(piece, 0) + len(piece)
    for number in set(numbers) if of_figures else ():
        out[number] = sum(map(str.isdigit, number))
    return (numbers[0] if numbers else None), out, of_figures


def chunk_table(documents: DataFrame, cover: float = 0.45, cover_text: float = 0.8) -> DataFrame:
    """The chunk rows of (scope, id, figures, text); ``cover`` is the share of the smaller document that must be common."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for scope, i, figures, text in zip(batch["scope"], batch["id"], batch["figures"], batch["text"], strict=True):
                number, chunks, of_figures = chunks_of(figures or "", text or "")
                total = sum(chunks.values())
                rows.extend((i, number, xxhash.xxh3_64_intdigest(f"{scope}\x1f{c}") - 2**63, n, total, cover if of_figures else cover_text) for c, n in chunks.items())
            yield pd.DataFrame(rows, columns=["id", "number", "chunk", "bytes", "total", "cover"]).astype({"chunk": "int64"})

    return documents.filter("scope is not null and id is not null").select("scope", "id", "figures", "text").mapInPandas(run, CHUNKS)


def probing(new: DataFrame, old: DataFrame | None = None, least_cover: float = 0.2) -> DataFrame:
    """``new`` with ``probe``: whether a chunk is among its document's rarest that make up more than ``1 - least_cover`` of its bytes."""
    every = new.select("chunk") if old is None else new.select("chunk").unionByName(old.select("chunk"))
    df = every.groupBy("chunk").agg(F.count("*").alias("df"))
    rarest = Window.partitionBy("id").orderBy("df", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("bytes").over(rarest), F.lit(0))
    return new.join(df, "chunk").withColumn("probe", before <= (1 - least_cover) * F.col("total")).withColumn("shared", F.col("df") > 1).drop("df")


def similar(new: DataFrame, old: DataFrame | None = None, cover_same_number: float = 0.2, least_bytes: int = 8) -> DataFrame:
    """(a, b): pairs of a document of ``new`` and one of ``old`` or of ``new`` that are one paper; both as :func:`probing` makes them.

    ``cover_same_number`` is the share of the smaller document that two of one number must have in common.
    """
    mine = new.filter("shared")  # chunks that no other document has meet nothing
    asks, has = lambda rows, n: rows.filter("probe").select("chunk", F.col("id").alias(n)), lambda rows, n: rows.select("chunk", F.col("id").alias(n))
    pairs = asks(mine, "n").join(has(mine, "a"), "chunk").filter("n <> a").select(F.least("n", "a").alias("n"), F.greatest("n", "a").alias("a"))
    every = mine
    if old is not None:
        pairs = pairs.unionByName(asks(mine, "n").join(has(old, "a"), "chunk").select("n", "a")).unionByName(asks(old, "a").join(has(mine, "n"), "chunk").select("n", "a"))
        every = mine.unionByName(old.withColumn("shared", F.lit(True)))
    side = lambda rows, n: rows.select(F.col("id").alias(n), "chunk", *[F.col(c).alias(f"{c}_{n}") for c in ("bytes", "total", "number", "cover")])
    met = pairs.distinct().join(side(mine, "n"), "n").join(side(every, "a"), ["a", "chunk"]).groupBy("n", "a").agg(
        F.sum(F.least("bytes_n", "bytes_a")).alias("bytes"), *[F.first(f"{c}_{n}").alias(f"{c}_{n}") for c in ("total", "number", "cover") for n in "na"])
    covered = F.col("bytes") / F.least("total_n", "total_a")
    one_number = F.col("number_n") == F.col("number_a")
    kept = met.filter((F.col("bytes") >= least_bytes) & F.coalesce(one_number, F.lit(True)) & ((covered >= F.greatest("cover_n", "cover_a")) | (one_number & (covered >= cover_same_number))))
    return kept.select(F.col("n").alias("a"), F.col("a").alias("b"))


class Checked(NamedTuple):
    """A checked batch: its links (a document, an earlier one or one of the same batch), and what accepting it adds to the store."""

    links: DataFrame
    keys: DataFrame
    chunks: DataFrame


def _bucket(scope: str = "scope") -> Column:
    return F.pmod(F.xxhash64(scope), F.lit(BUCKETS)).cast("int")


def _stored(batch: DataFrame, store: str, name: str, schema: str, number: int) -> DataFrame | None:
    """The rows of a table of the store that other batches added in the buckets of this one's scopes; None if nothing is there."""
    spark = batch.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{name}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    buckets = [r[0] for r in batch.select(_bucket()).distinct().collect()]  # at most BUCKETS
    return spark.read.schema(f"{schema}, batch int, bucket int").parquet(f"{store}/{name}").filter((F.col("batch") != number) & F.col("bucket").isin(buckets))


def check_batch(batch: DataFrame, store: str, number: int) -> Checked:
    """The documents of a new batch (scope, id, hashes, figures, text) against the store at ``store`` and each other; ``number`` names the batch.

    ``figures`` and ``text`` are what :func:`figures` and :func:`letters` make of the pages, ``hashes`` an array of file hashes.
    Call :func:`accept` with the result for what is kept.
    """
    named = checkpoints.cut(batch.filter("scope is not null and id is not null"))
    stream = F.when(F.length(F.regexp_replace("figures", "[^0-9]", "")) >= FEW, F.col("figures")).otherwise(F.concat(F.lit("t"), F.nullif("text", F.lit(""))))
    with_keys = named.withColumn("stream", F.when(stream.isNotNull(), F.concat(F.lit("s"), F.sha2(stream, 256))))
    keys = checkpoints.cut(with_keys.select("scope", "id", F.explode(F.array_distinct(F.filter(F.concat(F.coalesce(F.transform("hashes", lambda h: F.concat(F.lit("h"), h)), F.array()), F.array("stream")), lambda k: k.isNotNull()))).alias("key")))
    first = keys.groupBy("scope", "key").agg(F.min("id").alias("own"))
    history = _stored(named, store, "keys", KEYS, number)
    known = first.withColumn("old", F.lit(None).cast("string")) if history is None else first.join(history.select("scope", "key", F.col("id").alias("old")), ["scope", "key"], "left").groupBy("scope", "key").agg(F.first("own").alias("own"), F.min("old").alias("old"))
    known = checkpoints.cut(known)
    links = keys.join(known, ["scope", "key"]).select(F.col("id").alias("a"), F.coalesce("old", "own").alias("b")).filter("a <> b")
    unknown = known.filter("old is null and startswith(key, 's')").select("scope", F.col("own").alias("id"))
    chunks = checkpoints.cut(chunk_table(with_keys.join(unknown, ["scope", "id"], "left_semi")))
    told = _stored(named, store, "chunks", f"{CHUNKS}, probe boolean", number)
    old = None if told is None else checkpoints.cut(told.drop("batch", "bucket").join(chunks.select("chunk").distinct(), "chunk", "left_semi"))
    new = checkpoints.cut(probing(chunks, old))
    scopes = unknown.select("id", "scope")
    return Checked(links.unionByName(similar(new, old)).distinct(), known.filter("old is null").select("scope", "key", F.col("own").alias("id")), new.drop("shared").join(scopes, "id"))


def accept(checked: Checked, store: str, number: int) -> None:
    """Add a checked batch to the store; done twice, it replaces what it added before."""
    parts = {"keys": checked.keys, "chunks": checked.chunks}
    for name, rows in parts.items():
        placed = rows.withColumn("batch", F.lit(number)).withColumn("bucket", _bucket())
        placed = placed.drop("scope") if name == "chunks" else placed
        # one file for each bucket and task is enough; rows of a chunk lie together
        placed.repartition("bucket").sortWithinPartitions("bucket", "key" if name == "keys" else "chunk").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(f"{store}/{name}")


def components(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """(node, root) of each node of the undirected ``edges`` (a, b), by min-label propagation with pointer jumping.

    Groups of copies of one paper are shallow, so a few rounds suffice; the loop ends when no label changes.
    """
    both = checkpoints.cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpoints.cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "node"))
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        best = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "root", F.least("root", "near").alias("best"))
        jump = best.join(labels.select(F.col("node").alias("best"), F.col("root").alias("far")), "best", "left")
        lowest = F.least("best", F.coalesce("far", "best"))
        moved = checkpoints.cut(jump.select("node", lowest.alias("root"), (F.col("root") != lowest).alias("moved")))
        labels = moved.select("node", "root")
        if moved.filter("moved").isEmpty():
            return labels
    raise RuntimeError(f"labels still change after {rounds} rounds")


def file_hash(value: Column) -> Column:
    """The 64 hex digits of a SHA-256 hash however it is written; NULL if it has none."""
    return F.nullif(F.regexp_extract(F.lower(value), r"([0-9a-f]{64})", 1), F.lit(""))


def papers(documents: DataFrame, store: str, rounds: int = 3) -> DataFrame:
    """(id, paper): documents that are a paper of several, with the paper's least id.

    ``documents`` are (scope, id, hashes, figures, text, batch, at).  Batches are taken in by the time ``at`` of their first document, in ``rounds``
    intakes of about the same number of documents (a parameter of how often, not of what is compared): each is checked
    against the store of those before it and then accepted.
    """
    batched = documents.withColumn("batch", F.coalesce("batch", F.concat(F.lit("alone "), "id")))
    began = batched.groupBy("batch").agg(F.min("at").alias("began"), F.count("*").alias("n"))
    bounds = documents.agg(F.percentile_approx(F.col("at").cast("double"), [k / rounds for k in range(1, rounds)], 1000)).first()[0] or []
    intake = sum(((F.col("began").cast("double") > b).cast("int") for b in bounds), F.lit(0))
    placed = checkpoints.cut(batched.join(began.select("batch", F.coalesce(intake, F.lit(0)).alias("intake")), "batch").drop("batch", "at"))
    links = []
    for k in range(rounds):
        checked = check_batch(placed.filter(F.col("intake") == k), store, k)
        links.append(checkpoints.cut(checked.links))
        if k + 1 < rounds:
            accept(checked, store, k)
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    return components(every).select(F.col("node").alias("id"), F.col("root").alias("paper"))


def pairs_of(members: DataFrame) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: all pairs of documents of one paper, for reports that need them; ``members`` says the same in one row each."""
    a, b = members.select("paper", F.col("id").alias("doc_a")), members.select("paper", F.col("id").alias("doc_b"))
    return a.join(b, "paper").filter("doc_a < doc_b").select("doc_a", "doc_b")
