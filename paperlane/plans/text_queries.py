"""Queries over text, tables, matches, quality and geometry."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlane.functions import geometry as G
from paperlane.functions import markdown as M
from paperlane.functions import text as X
from paperlane.operators import lifecycle, matching, quality
from paperlane.operators import relational as R
from paperlane.sources import sinks, table
from paperlane.streaming import intake

SQL: dict[str, str] = {}
QUERIES: dict = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_KEYWORDS = ", ".join(f"({i}, '{kind}', '{word}')" for i, (kind, word) in enumerate(X.CATEGORY_KEYWORDS))
_LABELS = " ".join(f"WHEN '{kind}' THEN '{label}'" for kind, label in X.CATEGORY_LABELS.items())


@query(f"""WITH k(o, kind, word) AS (VALUES {_KEYWORDS}), f AS (SELECT d.doc_id, arg_min(k.kind, instr(d.text, k.word) * 100 + k.o) AS kind FROM documents d, k WHERE instr(d.text, k.word) > 0 GROUP BY 1)
SELECT d.doc_id, f.kind AS category, CASE f.kind {_LABELS} ELSE f.kind END AS label FROM documents d LEFT JOIN f USING (doc_id)""")
def document_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Category of every document by its earliest keyword."""
    rows = table(spark, folder, "documents").select("doc_id", X.category(F.col("text")).alias("category"))
    return rows.withColumn("label", X.category_label(F.col("category")))


@query(r"""SELECT doc_id, nullif(replace(regexp_extract(text, '[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+'), ',', ''), '') AS amount, nullif(replace(regexp_extract(text, '[-+]?[0-9][0-9,]*\.?[0-9]*'), ',', ''), '') AS number,
CASE WHEN regexp_matches(text, '([0-9]{2,4})[年/\-.]([0-9]{1,2})[月/\-.]([0-9]{1,2})') THEN printf('%04d-%02d-%02d', CASE WHEN y < 100 THEN y + 2000 ELSE y END, m, d) END AS date
FROM (SELECT *, TRY_CAST(regexp_extract(text, '([0-9]{2,4})[年/\-.]([0-9]{1,2})[月/\-.]([0-9]{1,2})', 1) AS INT) y, TRY_CAST(regexp_extract(text, '([0-9]{2,4})[年/\-.]([0-9]{1,2})[月/\-.]([0-9]{1,2})', 2) AS INT) m,
TRY_CAST(regexp_extract(text, '([0-9]{2,4})[年/\-.]([0-9]{1,2})[月/\-.]([0-9]{1,2})', 3) AS INT) d FROM documents)""")
def typed_values(spark: SparkSession, folder: str) -> DataFrame:
    """First amount, number and date of every document."""
    text = F.col("text")
    return table(spark, folder, "documents").select("doc_id", X.typed_amount(text).alias("amount"), X.typed_number(text).alias("number"), X.typed_date(text).alias("date"))


@query(r"SELECT p_partkey, trim(regexp_replace(lower(p_name || ' #' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug, regexp_replace(lower(trim(p_name || '!')), '[^a-z0-9_]', '_', 'g') AS field FROM part")
def slugs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "part")
    return rows.select("p_partkey", X.name_slug(F.concat("p_name", F.lit(" #"), "p_brand")).alias("slug"), X.field_slug(F.concat("p_name", F.lit("!"))).alias("field"))


@query(r"SELECT id, CASE WHEN contains(original_filename, '.') THEN regexp_replace(original_filename, '\.[^.]*$', '') ELSE original_filename END AS stem, lower(regexp_extract(original_filename, '[^/\\.](\.[^./\\]*)$', 1)) AS suffix, sha256(original_filename) AS digest FROM scan_documents")
def file_names(spark: SparkSession, folder: str) -> DataFrame:
    name = F.col("original_filename")
    return table(spark, folder, "scan_documents").select("id", X.stem(name).alias("stem"), X.suffix(name).alias("suffix"), F.sha2(name, 256).alias("digest"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 < 5 THEN '''' ELSE '' END || p AS cell FROM (SELECT c_custkey, (CASE c_custkey % 7 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' WHEN 4 THEN chr(9) WHEN 5 THEN ' =' ELSE '' END) || c_name AS p FROM customer)""")
def guarded_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Names behind every prefix that a spreadsheet would take for a formula, and behind two that it wouldn't."""
    prefix = F.array(*map(F.lit, ("=", "+", "-", "@", "\t", " =", "")))[(F.col("c_custkey") % 7).cast("int")]
    return table(spark, folder, "customer").select("c_custkey", X.guarded_cell(F.concat(prefix, "c_name")).alias("cell"))


@query("""SELECT id, array_to_string(['"' || replace(e.value, '"', '""') || '"' FOR e IN map_entries(data) IF e.value IS NOT NULL], ',') AS line FROM master_records""")
def field_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Each record's values as one fully quoted CSV line."""
    values = F.filter(F.map_values("data"), lambda v: v.isNotNull())
    return table(spark, folder, "master_records").select("id", sinks.csv_line(values).alias("line"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, trim(line) AS line FROM l WHERE trim(line) LIKE '|%|' AND length(trim(line)) > 1),
c AS (SELECT doc_id, [trim(x) FOR x IN string_split(line[2:-2], '|')] AS cells FROM r)
SELECT doc_id, count(*) AS table_rows, CAST(sum(len(cells)) AS BIGINT) AS cells, CAST(sum(len(list_filter(cells, lambda x: x <> ''))) AS BIGINT) AS filled FROM c WHERE len(list_filter(cells, lambda x: NOT regexp_full_match(x, ':?-{3,}:?'))) > 0 GROUP BY 1""")
def table_cell_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and cells of the tables of every document that has any."""
    rows = table(spark, folder, "documents").select("doc_id", F.explode(M.table_cells(F.col("text"))).alias("cells"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("table_rows"), F.sum(F.size("cells")).alias("cells"), F.sum(F.size(F.filter("cells", lambda c: c != ""))).alias("filled"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, i, trim(line) AS line FROM l WHERE trim(line) <> ''),
k AS (SELECT *, CASE WHEN line LIKE '|%' THEN 'table' WHEN regexp_matches(line, '^!\[[^\]]*\]\([^)]*\)') THEN 'image' ELSE 'text' END AS kind FROM t),
g AS (SELECT *, CASE WHEN kind = 'table' AND lag(kind) OVER (PARTITION BY doc_id ORDER BY i) = 'table' THEN 0 ELSE 1 END AS fresh FROM k)
SELECT doc_id, kind, count(*) AS n FROM g WHERE fresh = 1 GROUP BY 1, 2""")
def block_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of each kind of every document; adjacent table rows are one."""
    blocks = table(spark, folder, "documents").filter("text is not null").select("doc_id", F.explode(M.blocks(F.col("text"))).alias("b"))
    return blocks.groupBy("doc_id", F.col("b.kind").alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT r_regionkey, '| nation | key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || replace(n_name, 'I', '\\|') || ' | ' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) AS drawn FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1""")
def rendered_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Nations of each region as a Markdown table; bars in cells are escaped."""
    rows = table(spark, folder, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    cells = F.transform("n", lambda x: F.array(F.replace(x["n_name"], F.lit("I"), F.lit("|")), x["n_nationkey"].cast("string")))
    return rows.select("r_regionkey", M.rendered_table(F.concat(F.array(F.array(F.lit("nation"), F.lit("key"))), cells)).alias("drawn"))


@query("""SELECT n_nationkey, '| ' || n_name || ' |  | ' || n_nationkey || ' |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| a<br>b | & | x |' AS drawn FROM nation""")
def html_tables(spark: SparkSession, folder: str) -> DataFrame:
    """HTML tables with spanned columns, line breaks and entities as Markdown."""
    html = F.concat(F.lit("<table><tr><th colspan='2'>"), "n_name", F.lit("</th><td>"), "n_nationkey", F.lit("</td></tr><tr></tr><tr><td>a<br/>b</td><td>&amp;</td><td>x</td></tr></table>"))
    return table(spark, folder, "nation").select("n_nationkey", M.html_table(html).alias("drawn"))


@query()
def match_error_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Error rate of matched text against its master value, of all rows that have both; in code points of the normal form (SQL counts bytes)."""
    return _error_rates(table(spark, folder, "master_matches").filter("matched_text is not null and master_value is not null"))


def _error_rates(matches: DataFrame) -> DataFrame:
    rows = matches.select("id", "field_key", "matched_text", "master_value").distinct()
    a, b = X.normal_form(F.col("master_value")), X.normal_form(F.col("matched_text"))
    return rows.select("id", "field_key", F.length("matched_text").alias("characters"), X.error_rate(a, b).alias("cer"))


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "ocr_results").filter("is_current and markdown is not null").select("company_id", "page_id", F.col("id").alias("ocr_result_id"), "markdown")


@query()
def best_matches(spark: SparkSession, folder: str) -> DataFrame:
    """The best unit of every page for every master value of its company: the flagship query."""
    return matching.best_matches(_pages(spark, folder), table(spark, folder, "master_records"), table(spark, folder, "master_types"))


#: Single characters whose normal form is longer, as the normal form's length counts.
_EXPANDED = ", ".join(f"'{c}'" for c in map(chr, range(0x80, 0xFF00)) if not 0xD800 <= ord(c) <= 0xDFFF and len(unicodedata.normalize("NFKC", c).strip()) > 1)
_VALUES = """f AS (SELECT id AS master_type_id, unnest(fields) AS f FROM master_types), v AS (SELECT DISTINCT r.company_id, trim(r.data[f.f.key]) AS value FROM master_records r JOIN f USING (master_type_id) WHERE f.f.matchable AND r.data[f.f.key] IS NOT NULL)"""


@query(f"""WITH {_VALUES}, u AS (SELECT company_id, page_id, unnest(string_split(markdown, chr(10))) AS line FROM ocr_results WHERE is_current AND markdown IS NOT NULL)
SELECT u.page_id, v.value, count(*) AS lines FROM u JOIN v ON v.company_id = u.company_id AND contains(u.line, v.value) 
WHERE (length(v.value) >= 2 AND NOT regexp_full_match(v.value, '[ｦ-ﾝ][ﾞﾟ]')) OR v.value IN ({_EXPANDED}) GROUP BY 1, 2""")
def contained_values(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of each page in which a master value of its company stands, of all values whose normal form has two characters or more."""
    values = matching.matchable_values(table(spark, folder, "master_records"), table(spark, folder, "master_types"))
    lines = _pages(spark, folder).select("company_id", "page_id", F.explode(F.split("markdown", "\n", -1)).alias("line")).filter("line <> ''")
    return matching.contained(lines, values, "company_id", "line", "value").groupBy("page_id", "value").agg(F.count("*").alias("lines"))


@query()
def rematch(spark: SparkSession, folder: str) -> DataFrame:
    """New proposals of every page beside what was decided."""
    best = best_matches(spark, folder)
    return matching.proposals(best, table(spark, folder, "master_matches").select("status", "page_id", "master_record_id", "field_key", "matched_text"))


@query()
def learned_aliases(spark: SparkSession, folder: str) -> DataFrame:
    """All records with the upper-case spelling of their name learned, where it is a new variant; NULL texts and keys are empty."""
    return _upper_learned(table(spark, folder, "master_records"))


def _upper_learned(records: DataFrame) -> DataFrame:
    name = F.try_element_at("data", F.lit("name"))
    norm = X.normal_form(name)
    learned = matching.learned_aliases(F.col("aliases"), F.lit("name"), F.upper(name), norm, norm)
    spelled = F.transform(learned, lambda a: F.concat(F.coalesce(a["field_key"], F.lit("")), F.lit(":"), F.coalesce(a["text"], F.lit(""))))
    return records.select("id", F.array_join(F.array_sort(spelled), "|").alias("aliases"))


#: White space and line ends as :mod:`functions.text` has them, for DuckDB.
SQL_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SQL_EOL = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SQL_WS}+|{SQL_WS}+$', '', 'g')"


def _superseded(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "ocr_results").select("id", "page_id", "markdown", "is_current")
    now = rows.filter("is_current").select("page_id", F.col("markdown").alias("reference"))
    return rows.filter("not is_current").join(now, "page_id")


_LINE, _CELL = sql_strip(f"unnest(regexp_split_to_array(t, '{SQL_EOL}'))"), sql_strip(f"regexp_replace(x, '{SQL_WS}+', ' ', 'g')")


@query(f"""WITH p AS (SELECT o.id, unnest(['a', 'b']) AS side, unnest([coalesce(n.markdown, ''), coalesce(o.markdown, '')]) AS t FROM ocr_results o JOIN ocr_results n ON n.page_id = o.page_id AND n.is_current WHERE NOT o.is_current),
l AS (SELECT id, side, {_LINE} AS line FROM p), r AS (SELECT id, side, [{_CELL} FOR x IN string_split(line[2:-2], '|')] AS cells FROM l WHERE line LIKE '|%|' AND length(line) > 1),
c AS (SELECT id, side, cell, count(*) AS n FROM (SELECT id, side, unnest(cells) AS cell FROM r WHERE len(list_filter(cells, lambda x: NOT regexp_full_match(x, ':?-{{3,}}:?'))) > 0) WHERE cell <> '' GROUP BY ALL),
s AS (SELECT id, sum(least(a, b)) AS common, sum(a) AS a, sum(b) AS b FROM (SELECT id, cell, coalesce(sum(n) FILTER (side = 'a'), 0) AS a, coalesce(sum(n) FILTER (side = 'b'), 0) AS b FROM c GROUP BY 1, 2) GROUP BY 1)
SELECT i.id, CASE WHEN a IS NULL THEN 1.0::DOUBLE WHEN a = 0 OR b = 0 THEN 0.0::DOUBLE ELSE round(2.0::DOUBLE * common / (a + b), 9) END AS f1 FROM (SELECT DISTINCT id FROM p) i LEFT JOIN s USING (id)""")
def result_cell_f1(spark: SparkSession, folder: str) -> DataFrame:
    """Table cells of superseded results against the current result of their page."""
    return quality.cell_f1(_superseded(spark, folder), "id", "reference", "markdown").select("id", F.round("f1", 9).alias("f1"))


@query()
def result_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """Error rate and cells of superseded results against the current result of their page."""
    return quality.golden_evaluation(_superseded(spark, folder), "id", "reference", "markdown")


@query("""SELECT name, CASE WHEN NOT (CASE WHEN bh > 0 THEN (bh - nh) / bh ELSE 0 END >= 0.02) THEN 'too little improvement' WHEN ng - bg > 0.005 THEN 'golden error rate is worse' WHEN bf - nf > 0.01 THEN 'table cells are worse' ELSE 'passed' END AS reason
FROM (SELECT engine AS name, 1.1 - avg(avg_confidence) AS bh, 1.0 - avg(avg_confidence) AS nh, 0.05 AS bg, 0.05 + 0.01 * (count(*) % 2) AS ng, 0.9 AS bf, 0.9 - 0.02 * (count(*) % 3) AS nf FROM ocr_results GROUP BY 1)""")
def promotion_gate(spark: SparkSession, folder: str) -> DataFrame:
    """The gate over figures derived from each engine's results."""
    n = F.count("*")
    rows = table(spark, folder, "ocr_results").groupBy(F.col("engine").alias("name")).agg(
        (1.1 - F.avg("avg_confidence")).alias("base_holdout"), (1.0 - F.avg("avg_confidence")).alias("new_holdout"), F.lit(0.05).alias("base_golden"),
        (0.05 + 0.01 * (n % 2)).alias("new_golden"), F.lit(0.9).alias("base_f1"), (0.9 - 0.02 * (n % 3)).alias("new_f1"))
    return quality.gate(rows).select("name", "reason")


@query("""WITH s AS (SELECT *, lag(received_at) OVER (PARTITION BY device_id ORDER BY received_at, path, state) AS before FROM (SELECT DISTINCT device_id, path, sha256, state, received_at FROM upload_journal))
SELECT device_id, count(*) FILTER (before IS NULL OR received_at - before >= INTERVAL 60 SECOND) AS sessions, count(*) AS n FROM s GROUP BY 1""")
def upload_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Upload sessions per device: a file opens a new one when 60 seconds passed since the one before."""
    rows = table(spark, folder, "upload_journal").select("device_id", "path", "sha256", "state", "received_at").distinct().withColumn("tie", F.concat_ws("\x01", "path", "state"))
    return R.sessions(rows, "device_id", "received_at", 60, "tie").groupBy("device_id").agg(F.max("session").alias("sessions"), F.count("*").alias("n"))


@query("""SELECT batch_id, count(DISTINCT sha256) AS total, count(DISTINCT CASE WHEN state = 'done' THEN sha256 END) AS completed,
CASE WHEN count(DISTINCT CASE WHEN state = 'done' THEN sha256 END) >= count(DISTINCT sha256) THEN 'completed' ELSE 'processing' END AS status FROM (SELECT batch_id, lower(sha256) AS sha256, state FROM upload_journal WHERE batch_id IS NOT NULL) GROUP BY 1""")
def batch_counters(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "upload_journal").filter("batch_id is not null").withColumn("sha256", F.lower("sha256"))
    counts = rows.groupBy("batch_id").agg(F.count_distinct("sha256").alias("total"), F.count_distinct(F.when(F.col("state") == "done", F.col("sha256"))).alias("completed"))
    return counts.withColumn("status", F.when(F.col("completed") >= F.col("total"), "completed").otherwise("processing"))


@query("SELECT company_id, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'pending') > 1 AS rejected FROM ocr_pages GROUP BY 1")
def backpressure(spark: SparkSession, folder: str) -> DataFrame:
    """Companies whose pending pages exceed the limit, here 1."""
    return intake.within_limit(table(spark, folder, "ocr_pages"), 1).select("company_id", "pending", (~F.col("accepted")).alias("rejected"))


@query("SELECT id, CASE WHEN status = 'processing' AND created_at < TIMESTAMPTZ '2025-01-01 00:00:00+00' THEN 'failed' ELSE status END AS status FROM scan_documents")
def stale_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Documents after those in work since before a moment were given up."""
    return lifecycle.swept(table(spark, folder, "scan_documents").select("id", "status", "created_at"), F.lit("2025-01-01 00:00:00+00:00").cast("timestamp"), ("processing",), "failed").select("id", "status")


@query("""SELECT device_id, sha, arg_max(state, (updated_at, CASE state WHEN 'done' THEN 3 WHEN 'failed' THEN 2 WHEN 'uploading' THEN 1 ELSE 0 END)) AS state FROM (SELECT *, lower(regexp_extract(lower(sha256), '[0-9a-f]{64}')) AS sha FROM upload_journal) GROUP BY 1, 2""")
def journal_state(spark: SparkSession, folder: str) -> DataFrame:
    """The last state of each file of a device."""
    place = F.when(F.col("state") == "done", 3).when(F.col("state") == "failed", 2).when(F.col("state") == "uploading", 1).otherwise(0)
    rows = table(spark, folder, "upload_journal").withColumn("sha", F.regexp_extract(F.lower("sha256"), "[0-9a-f]{64}", 0))
    return rows.groupBy("device_id", "sha").agg(F.max_by("state", F.struct("updated_at", place)).alias("state"))


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, max(ts) - min(ts) >= INTERVAL 1 HOUR AS long FROM events WHERE event_type LIKE 'c%' GROUP BY 1""")
def progress_fold(spark: SparkSession, folder: str) -> DataFrame:
    """The last event of each user among those of a topic prefix."""
    rows = table(spark, folder, "events").filter(F.col("event_type").startswith("c")).withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts")) >= 3_600_000_000).alias("long"))


@query("""WITH s AS (SELECT device_id, lower(sha256) AS sha, state, lead(state) OVER (PARTITION BY device_id, lower(sha256), path ORDER BY updated_at, state) AS nxt FROM (SELECT DISTINCT device_id, sha256, path, state, updated_at FROM upload_journal))
SELECT state, nxt AS to_state, count(*) AS n, (state, nxt) IN (('pending', 'uploading'), ('pending', 'done'), ('uploading', 'done'), ('uploading', 'failed'), ('failed', 'pending')) AS allowed FROM s WHERE nxt IS NOT NULL GROUP BY 1, 2""")
def state_transitions(spark: SparkSession, folder: str) -> DataFrame:
    """Transitions between the states of journalled files, with whether they are allowed."""
    from pyspark.sql import Window

    steps = [("pending", "uploading"), ("pending", "done"), ("uploading", "done"), ("uploading", "failed"), ("failed", "pending")]
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, b in steps])
    rows = table(spark, folder, "upload_journal").select("device_id", "sha256", "path", "state", "updated_at").distinct()
    order = Window.partitionBy("device_id", F.lower("sha256"), "path").orderBy("updated_at", "state")
    moves = rows.withColumn("to_state", F.lead("state").over(order)).filter("to_state is not null").groupBy("state", "to_state").agg(F.count("*").alias("n"))
    return moves.withColumn("allowed", F.array_contains(allowed, F.concat("state", F.lit(">"), "to_state")))


_BOX = "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey % 97 * 10.0 AS x0, l_suppkey % 89 * 8.0 AS y0, l_partkey % 97 * 10.0 + l_quantity * 4 AS x1, l_suppkey % 89 * 8.0 + l_quantity * 2 AS y1 FROM lineitem"


def _boxes(spark: SparkSession, folder: str) -> DataFrame:
    x0, y0 = F.col("l_partkey") % 97 * 10.0, F.col("l_suppkey") % 89 * 8.0
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", G.box(x0, y0, x0 + F.col("l_quantity") * 4, y0 + F.col("l_quantity") * 2).alias("b"))


@query(f"SELECT l_orderkey, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM ({_BOX}) GROUP BY 1")
def box_unions(spark: SparkSession, folder: str) -> DataFrame:
    """The box around all boxes of a page (an order's lines)."""
    b = F.col("b")
    return _boxes(spark, folder).groupBy("l_orderkey").agg(F.min(b["x0"]).alias("x0"), F.min(b["y0"]).alias("y0"), F.max(b["x1"]).alias("x1"), F.max(b["y1"]).alias("y1"), F.count("*").alias("n"))


@query(f"""WITH b AS ({_BOX}), p AS (SELECT a.l_orderkey, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) AS aa, (b.x1 - b.x0) * (b.y1 - b.y0) AS ab
FROM b a JOIN b ON a.l_orderkey = b.l_orderkey WHERE (a.l_linenumber, a.l_suppkey) < (b.l_linenumber, b.l_suppkey)) SELECT l_orderkey, count(*) AS pairs, count(*) FILTER (i / (aa + ab - i) > 0.25) AS overlapping FROM p GROUP BY 1""")
def box_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of boxes of a page, and those that overlap by more than a quarter of their union."""
    boxes = _boxes(spark, folder).select("l_orderkey", F.struct("l_linenumber", "l_suppkey").alias("k"), "b")
    other = boxes.select("l_orderkey", F.col("k").alias("k2"), F.col("b").alias("c"))
    pairs = boxes.join(other, "l_orderkey").filter("k < k2")
    return pairs.groupBy("l_orderkey").agg(F.count("*").alias("pairs"), F.count_if(G.overlap(F.col("b"), F.col("c")) > 0.25).alias("overlapping"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey % 50 * 10.0 AS s, l_partkey % 50 * 10.0 + l_quantity AS e FROM lineitem),
m AS (SELECT *, max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e, l_linenumber, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r)
SELECT l_orderkey, count(*) FILTER (reach IS NULL OR s - reach > 15) AS strips FROM m GROUP BY 1""")
def gap_islands(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of intervals that are more than 15 apart: a running maximum of ends, no self-join."""
    s = F.col("l_partkey") % 50 * 10.0
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", s.alias("s"), (s + F.col("l_quantity")).alias("e"))
    return G.islands(rows, ["l_orderkey"], "s", "e", 15.0, ["l_linenumber", "l_suppkey"]).groupBy("l_orderkey").agg(F.max("island").alias("strips"))
