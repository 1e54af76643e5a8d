"""Queries over documents, pages, results and masters: scans, filters, joins, aggregates, order and paging."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperlane.functions import text as X
from paperlane.operators import lifecycle
from paperlane.operators import relational as R
from paperlane.sources import table

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


@query("SELECT status, count(*) AS n FROM scan_documents GROUP BY 1")
def documents_by_status(spark: SparkSession, folder: str) -> DataFrame:
    return R.counts_by(table(spark, folder, "scan_documents"), "status")


@query("SELECT company_id, status, count(*) AS n FROM scan_documents GROUP BY 1, 2")
def company_status_counts(spark: SparkSession, folder: str) -> DataFrame:
    return R.counts_by(table(spark, folder, "scan_documents"), "company_id", "status")


@query("SELECT company_id, count(DISTINCT uploaded_by_user_id) AS users, count(*) AS n FROM scan_documents WHERE uploaded_by_user_id IS NOT NULL GROUP BY 1")
def uploaders_per_company(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "scan_documents").filter("uploaded_by_user_id is not null")
    return rows.groupBy("company_id").agg(F.count_distinct("uploaded_by_user_id").alias("users"), F.count("*").alias("n"))


@query("SELECT t.id, t.name, coalesce(r.n, 0) AS n FROM master_types t LEFT JOIN (SELECT master_type_id, count(*) n FROM master_records WHERE master_type_id IS NOT NULL GROUP BY 1) r ON r.master_type_id = t.id")
def types_with_record_counts(spark: SparkSession, folder: str) -> DataFrame:
    return R.with_counts(table(spark, folder, "master_types").select("id", "name"), table(spark, folder, "master_records"), "id", "master_type_id")


@query("SELECT c.id, c.slug, coalesce(d.n, 0) AS documents, coalesce(m.n, 0) AS records FROM companies c LEFT JOIN (SELECT company_id, count(*) n FROM scan_documents GROUP BY 1) d ON d.company_id = c.id LEFT JOIN (SELECT company_id, count(*) n FROM master_records GROUP BY 1) m ON m.company_id = c.id")
def companies_with_counts(spark: SparkSession, folder: str) -> DataFrame:
    companies = table(spark, folder, "companies").select("id", "slug")
    return R.with_counts(R.with_counts(companies, table(spark, folder, "scan_documents"), "id", "company_id", "documents"), table(spark, folder, "master_records"), "id", "company_id", "records")


@query("SELECT template_id, count(*) AS n FROM scan_documents WHERE template_id IS NOT NULL GROUP BY 1")
def documents_per_template(spark: SparkSession, folder: str) -> DataFrame:
    return R.counts_by(table(spark, folder, "scan_documents").filter("template_id is not null"), "template_id")


@query("""WITH d AS (SELECT CAST(created_at AT TIME ZONE 'UTC' AS DATE) AS day, count(*) n FROM scan_documents GROUP BY 1),
c AS (SELECT CAST(unnest(generate_series(max(day) - INTERVAL 6 DAY, max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d)
SELECT CAST(c.day AS VARCHAR) AS day, coalesce(d.n, 0) AS n FROM c LEFT JOIN d USING (day)""")
def daily_volume(spark: SparkSession, folder: str) -> DataFrame:
    return R.daily_volume(table(spark, folder, "scan_documents"), 7).select(F.col("day").cast("string").alias("day"), "n")


@query("""SELECT count(*) AS documents, count(*) FILTER (status IN ('processing', 'queued', 'uploaded')) AS open, count(*) FILTER (status = 'failed') AS failed,
count(*) FILTER (visibility = 'shared') AS shared, CAST(sum(byte_size) AS BIGINT) AS bytes, CAST(sum(page_count) AS BIGINT) AS pages FROM scan_documents""")
def dashboard_scalars(spark: SparkSession, folder: str) -> DataFrame:
    """All figures of a dashboard in one pass."""
    rows = table(spark, folder, "scan_documents")
    return rows.agg(
        F.count("*").alias("documents"), F.count_if(F.col("status").isin("processing", "queued", "uploaded")).alias("open"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("visibility") == "shared").alias("shared"), F.sum("byte_size").alias("bytes"), F.sum("page_count").alias("pages"))


@query("SELECT id, original_filename, status FROM scan_documents ORDER BY created_at DESC, id LIMIT 6")
def recent_documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "scan_documents").orderBy(*R.newest_first()).limit(6).select("id", "original_filename", "status")


@query("""SELECT id, original_filename FROM scan_documents WHERE status IN ('completed', 'partially_failed') AND original_filename ILIKE '%a%'
AND created_at >= TIMESTAMPTZ '2023-06-01 00:00:00+00' AND created_at < TIMESTAMPTZ '2025-06-01 00:00:00+00' AND visibility = 'shared' ORDER BY created_at DESC, id LIMIT 25 OFFSET 25""")
def document_list_page(spark: SparkSession, folder: str) -> DataFrame:
    """Second page of a filtered listing."""
    wanted = R.Listing(statuses=("completed", "partially_failed"), name_like="a", since=date(2023, 6, 1), until=date(2025, 5, 31), page=2)
    rows = R.listed(table(spark, folder, "scan_documents"), R.Principal(None), wanted)
    return R.page_of(rows, wanted.page, wanted.size, *R.newest_first()).select("id", "original_filename")


@query("""SELECT count(*) AS total FROM scan_documents WHERE status IN ('completed', 'partially_failed') AND original_filename ILIKE '%a%'
AND created_at >= TIMESTAMPTZ '2023-06-01 00:00:00+00' AND created_at < TIMESTAMPTZ '2025-06-01 00:00:00+00' AND visibility = 'shared'""")
def document_list_total(spark: SparkSession, folder: str) -> DataFrame:
    wanted = R.Listing(statuses=("completed", "partially_failed"), name_like="a", since=date(2023, 6, 1), until=date(2025, 5, 31))
    return R.listed(table(spark, folder, "scan_documents"), R.Principal(None), wanted).agg(F.count("*").alias("total"))


@query("SELECT d.id FROM scan_documents d JOIN (SELECT company_id, min(uploaded_by_user_id) AS me FROM scan_documents GROUP BY 1) u ON u.company_id = d.company_id WHERE d.visibility = 'shared' OR d.uploaded_by_user_id = u.me")
def visible_documents(spark: SparkSession, folder: str) -> DataFrame:
    """What the first user of each company sees of it."""
    rows = table(spark, folder, "scan_documents")
    return R.visible_to(rows, rows.groupBy("company_id").agg(F.min("uploaded_by_user_id").alias("user_id"))).select("id")


@query("SELECT id, status FROM scan_documents WHERE status IN ('failed', 'partially_failed', 'processing') AND error_message IS NOT NULL AND doc_type IS NULL")
def in_and_null_predicates(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "scan_documents")
    return rows.filter(F.col("status").isin("failed", "partially_failed", "processing") & F.col("error_message").isNotNull() & F.col("doc_type").isNull()).select("id", "status")


@query("""SELECT DISTINCT m.id, m.field_key, m.matched_text, t.name AS type_name, m.score FROM master_matches m JOIN master_records r ON r.id = m.master_record_id
JOIN master_types t ON t.id = m.master_type_id WHERE m.status <> 'dismissed' ORDER BY m.score DESC, m.id LIMIT 200""")
def matches_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Best matches with their record and type."""
    matches = table(spark, folder, "master_matches").filter("status <> 'dismissed'").select("id", "field_key", "matched_text", "score", "master_record_id", "master_type_id").distinct()
    records, types = table(spark, folder, "master_records").select(F.col("id").alias("master_record_id")), table(spark, folder, "master_types").select(F.col("id").alias("master_type_id"), F.col("name").alias("type_name"))
    joined = matches.join(records, "master_record_id").join(types, "master_type_id")
    return joined.orderBy(F.desc("score"), "id").limit(200).select("id", "field_key", "matched_text", "type_name", "score")


@query("""SELECT r.id, p.page_number, d.original_filename FROM ocr_results r JOIN ocr_pages p ON p.id = r.page_id JOIN scan_documents d ON d.id = p.document_id
WHERE NOT r.is_current ORDER BY r.created_at DESC, r.id LIMIT 200""")
def superseded_results(spark: SparkSession, folder: str) -> DataFrame:
    """The newest results that were replaced, with page and document."""
    results = table(spark, folder, "ocr_results").filter("not is_current").select("id", "page_id", "created_at")
    pages = table(spark, folder, "ocr_pages").select(F.col("id").alias("page_id"), "document_id", "page_number")
    documents = table(spark, folder, "scan_documents").select(F.col("id").alias("document_id"), "original_filename")
    joined = results.join(pages, "page_id").join(documents, "document_id")
    return joined.orderBy(*R.newest_first()).limit(200).select("id", "page_number", "original_filename")


@query("SELECT p.id, p.status, coalesce(length(r.markdown), 0) AS characters FROM ocr_pages p LEFT JOIN ocr_results r ON r.page_id = p.id AND r.is_current")
def pages_with_current_result(spark: SparkSession, folder: str) -> DataFrame:
    """Every page with its current result, where it has one."""
    results = table(spark, folder, "ocr_results").filter("is_current").select("page_id", F.length("markdown").alias("k"))
    pages = table(spark, folder, "ocr_pages").select("id", "status")
    return pages.join(results, F.col("id") == F.col("page_id"), "left").select("id", "status", F.coalesce("k", F.lit(0)).alias("characters"))


@query("""SELECT company_id, id, status FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY created_at DESC, id DESC) AS k FROM scan_documents) WHERE k = 1""")
def latest_per_company(spark: SparkSession, folder: str) -> DataFrame:
    return R.latest_per(table(spark, folder, "scan_documents"), "company_id", "created_at", "id", "id", "status")


@query("""WITH o AS (SELECT company_id, max(template_id) AS template_id FROM scan_documents GROUP BY 1), g AS (SELECT min(template_id) AS template_id FROM scan_documents)
SELECT o.company_id, coalesce(o.template_id, g.template_id) AS template_id FROM o, g""")
def scope_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Each company's own template, else the general one."""
    rows = table(spark, folder, "scan_documents")
    own = rows.groupBy("company_id").agg(F.max("template_id").alias("template_id"))
    return R.coalesced_lookup(own.select("company_id"), "company_id", own, rows.agg(F.min("template_id").alias("template_id")), "template_id")


@query("""SELECT d.id, d.page_count, count(p.id) FILTER (p.status IN ('completed', 'failed')) AS done FROM scan_documents d LEFT JOIN ocr_pages p ON p.document_id = d.id GROUP BY 1, 2""")
def page_progress(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "ocr_pages").groupBy("document_id").agg(F.count_if(F.col("status").isin("completed", "failed")).alias("done"))
    documents = table(spark, folder, "scan_documents").select("id", "page_count")
    return documents.join(pages, F.col("id") == F.col("document_id"), "left").select("id", "page_count", F.coalesce("done", F.lit(0)).alias("done"))


@query("""SELECT document_id, left(concat(count(*) FILTER (status = 'failed'), '/', count(*), ' pages failed — ', coalesce(arg_min(error_message, page_number) FILTER (status = 'failed' AND error_message IS NOT NULL), 'no reason given')), 2000) AS summary
FROM ocr_pages GROUP BY 1 HAVING count(*) FILTER (status = 'failed') > 0""")
def failed_pages_summary(spark: SparkSession, folder: str) -> DataFrame:
    failed = F.col("status") == "failed"
    pages = table(spark, folder, "ocr_pages").groupBy("document_id").agg(F.count_if(failed).alias("k"), F.count("*").alias("n"), F.min_by(F.when(failed, F.col("error_message")), F.when(failed & F.col("error_message").isNotNull(), F.col("page_number"))).alias("first"))
    text = F.concat(F.col("k"), F.lit("/"), F.col("n"), F.lit(" pages failed — "), F.coalesce("first", F.lit("no reason given")))
    return pages.filter("k > 0").select("document_id", F.substring(text, 1, 2000).alias("summary"))


@query("""SELECT p.document_id, string_agg(coalesce(r.markdown, '<!-- page ' || p.page_number || ': no text -->'), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY p.page_number, p.id) AS markdown
FROM ocr_pages p LEFT JOIN ocr_results r ON r.page_id = p.id AND r.is_current GROUP BY 1""")
def assembled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's Markdown: its pages in order, a comment where a page has no text."""
    results = table(spark, folder, "ocr_results").filter("is_current").select("page_id", "markdown")
    pages = table(spark, folder, "ocr_pages").select("id", "document_id", "page_number").join(results, F.col("id") == F.col("page_id"), "left")
    text = F.coalesce("markdown", F.concat(F.lit("<!-- page "), F.col("page_number"), F.lit(": no text -->")))
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "id", text.alias("text"))))  # a document's pages: few
    return pages.groupBy("document_id").agg(ordered.alias("p")).select("document_id", F.array_join("p.text", "\n\n---\n\n").alias("markdown"))


@query("SELECT engine, count(*) AS n, round(avg(avg_confidence), 6) AS mean, round(median(avg_confidence), 6) AS middle FROM ocr_results GROUP BY 1")
def confidence_by_engine(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "ocr_results")
    return rows.groupBy("engine").agg(F.count("*").alias("n"), F.round(F.avg("avg_confidence"), 6).alias("mean"), F.round(F.median("avg_confidence"), 6).alias("middle"))


@query("SELECT CASE WHEN avg_confidence < 0.7 THEN 'low' WHEN avg_confidence < 0.9 THEN 'warn' ELSE 'ok' END AS band, count(*) AS n FROM ocr_results WHERE avg_confidence IS NOT NULL GROUP BY 1")
def confidence_bands(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("avg_confidence")
    rows = table(spark, folder, "ocr_results").filter(c.isNotNull())
    return rows.groupBy(F.when(c < 0.7, "low").when(c < 0.9, "warn").otherwise("ok").alias("band")).agg(F.count("*").alias("n"))


@query("""SELECT id, CASE WHEN content_sha256 IS NULL THEN id ELSE first_value(id) OVER (PARTITION BY company_id, content_sha256, coalesce(uploaded_by_user_id, uploaded_by_device_id) ORDER BY created_at, id) END AS first_id FROM scan_documents""")
def first_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Each document with the first upload of the same bytes by the same user (or device) of its company."""
    keys = [F.col("content_sha256"), F.col("company_id"), F.coalesce("uploaded_by_user_id", "uploaded_by_device_id")]
    return R.first_copies(table(spark, folder, "scan_documents"), keys, "created_at", "id")


@query("""WITH s AS (SELECT id, master_type_id, array_to_string(list_sort([chr(2) || e.key || chr(31) || e.value FOR e IN map_entries(data) IF e.value IS NOT NULL AND e.value <> '']), chr(30)) AS sig FROM master_records)
SELECT master_type_id, count(*) AS records, count(DISTINCT sig) AS signatures FROM s GROUP BY 1""")
def record_signatures(spark: SparkSession, folder: str) -> DataFrame:
    """Records and distinct records of each type."""
    rows = table(spark, folder, "master_records").select("master_type_id", R.signature(F.col("data")).alias("sig"))
    return rows.groupBy("master_type_id").agg(F.count("*").alias("records"), F.count_distinct("sig").alias("signatures"))


@query("SELECT id FROM master_records WHERE len(list_filter(map_values(data), lambda v: contains(lower(v), 'optic'))) > 0")
def record_search(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "master_records").filter(R.any_value_contains(F.col("data"), "Optic")).select("id")


@query("SELECT event_id, coalesce(json_extract_string(props, '$.ref'), 'none') AS ref FROM events")
def settings_default(spark: SparkSession, folder: str) -> DataFrame:
    """A member of a JSON object with a default."""
    return table(spark, folder, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.ref"), F.lit("none")).alias("ref"))


@query("SELECT c_custkey FROM customer WHERE lower(replace(c_name || chr(13), chr(13), '')) = lower(trim(' ' || upper(c_name) || ' '))")
def normalized_equality(spark: SparkSession, folder: str) -> DataFrame:
    """Names that are equal but for case, carriage returns and outer blanks."""
    stored, given = F.concat("c_name", F.lit("\r")), F.concat(F.lit(" "), F.upper("c_name"), F.lit(" "))
    return table(spark, folder, "customer").filter(F.lower(F.replace(stored, F.lit("\r"), F.lit(""))) == F.lower(F.trim(given))).select("c_custkey")


@query("SELECT kind, count(*) AS n, CASE kind WHEN 'product' THEN 1 WHEN 'client' THEN 2 WHEN 'supplier' THEN 3 WHEN 'other' THEN 4 ELSE 0 END AS place FROM master_types GROUP BY 1")
def types_in_fixed_order(spark: SparkSession, folder: str) -> DataFrame:
    order = F.array(*map(F.lit, ("product", "client", "supplier", "other")))
    counts = R.counts_by(table(spark, folder, "master_types"), "kind").withColumn("place", F.array_position(order, F.col("kind")).cast("int"))
    return counts.orderBy("place")


@query("SELECT m.id FROM master_matches m WHERE m.status = 'suggested' AND NOT EXISTS (SELECT 1 FROM master_matches o WHERE o.status <> 'suggested' AND o.page_id = m.page_id AND o.master_record_id = m.master_record_id AND o.field_key = m.field_key AND o.matched_text IS NOT DISTINCT FROM m.matched_text)")
def undecided_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Suggestions whose (page, record, field, text) nobody has decided."""
    rows = table(spark, folder, "master_matches").select("id", "status", "page_id", "master_record_id", "field_key", F.coalesce("matched_text", F.lit("\x00")).alias("t"))
    keys = ["page_id", "master_record_id", "field_key", "t"]
    return rows.filter("status = 'suggested'").join(rows.filter("status <> 'suggested'").select(*keys), keys, "left_anti").select("id")


@query("""SELECT page_id, id FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY created_at DESC, id DESC) AS k FROM ocr_results) WHERE k = 1""")
def current_results(spark: SparkSession, folder: str) -> DataFrame:
    """The one result of each page that is to be current: its newest."""
    return R.latest_per(table(spark, folder, "ocr_results"), "page_id", "created_at", "id", "id")


@query("SELECT p.id AS page_id, p.document_id FROM ocr_pages p WHERE NOT EXISTS (SELECT 1 FROM scan_documents d WHERE d.id = p.document_id AND d.status = 'failed')")
def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that are left when failed documents are deleted with theirs."""
    gone = table(spark, folder, "scan_documents").filter("status = 'failed'")
    return lifecycle.without(table(spark, folder, "ocr_pages").select(F.col("id").alias("page_id"), "document_id"), gone, "document_id")


@query("SELECT company_id, count(DISTINCT uploaded_by_user_id) AS used, count(DISTINCT uploaded_by_user_id) < 5 AS may_add FROM scan_documents GROUP BY 1")
def quota_check(spark: SparkSession, folder: str) -> DataFrame:
    used = table(spark, folder, "scan_documents").groupBy("company_id").agg(F.count_distinct("uploaded_by_user_id").alias("used"))
    return used.withColumn("may_add", F.col("used") < 5)


@query("SELECT device_id, path, sha256, state, count(*) AS n FROM upload_journal GROUP BY 1, 2, 3, 4 HAVING count(*) > 1")
def repeated_journal_rows(spark: SparkSession, folder: str) -> DataFrame:
    return R.repeated_keys(table(spark, folder, "upload_journal"), "device_id", "path", "sha256", "state")


@query("""SELECT company_id, completed >= 20 AS eligible, completed FROM (SELECT company_id, count(*) FILTER (status = 'completed') AS completed FROM scan_documents GROUP BY 1)""")
def training_eligibility(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "scan_documents").groupBy("company_id").agg(F.count_if(F.col("status") == "completed").alias("completed"))
    return rows.select("company_id", (F.col("completed") >= 20).alias("eligible"), "completed")


@query("""SELECT id, row_number() OVER (PARTITION BY lang_key ORDER BY h, id) <= greatest(1, CAST(floor(0.1 * n) AS BIGINT)) AS holdout FROM
(SELECT doc_id AS id, coalesce(lang, '') AS lang_key, md5('42' || doc_id) AS h, count(*) OVER (PARTITION BY coalesce(lang, '')) AS n FROM documents)""")
def holdout_split(spark: SparkSession, folder: str) -> DataFrame:
    """A tenth of each language's documents, at least one, by hash order."""
    from paperlane.operators.quality import holdout

    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("lang_key"))
    return holdout(rows, "id", "lang_key", 0.1, "42").select("id", "holdout")


@query("""SELECT o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE n.n_regionkey = 1 GROUP BY 1""")
def region_order_volume(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of a region by priority: a fact table, two dimensions, one shuffle on a small key."""
    nations = table(spark, folder, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey").join(nations, "c_nationkey").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, folder, "orders").join(customers, "o_custkey").groupBy("o_orderpriority").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def lineitem_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("""SELECT l_orderkey, k, l_partkey, l_extendedprice FROM (SELECT l_orderkey, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey) AS k FROM lineitem) WHERE k <= 2""")
def best_per_group(spark: SparkSession, folder: str) -> DataFrame:
    """The two dearest lines of each order."""
    best = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_suppkey")
    return table(spark, folder, "lineitem").withColumn("k", F.row_number().over(best)).filter("k <= 2").select("l_orderkey", "k", "l_partkey", "l_extendedprice")


@query("SELECT id, n AS page_number FROM scan_documents, range(1, 10000) r(n) WHERE n <= page_count")
def page_fanout(spark: SparkSession, folder: str) -> DataFrame:
    """The pages that documents are to have."""
    rows = table(spark, folder, "scan_documents").filter("page_count > 0")
    return rows.select("id", F.explode(F.sequence(F.lit(1), "page_count")).alias("page_number"))


@query(r"""SELECT d.id, d.company_id || '/documents/' || d.id || '/original' || coalesce(nullif(lower(regexp_extract(original_filename, '[^/\\.](\.[^./\\]*)$', 1)), ''), '.bin') AS original, d.company_id || '/documents/' || d.id || '/results/document.md' AS markdown FROM scan_documents d""")
def document_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Where documents and their Markdown are stored."""
    rows = table(spark, folder, "scan_documents")
    return rows.select("id", X.original_path(F.col("company_id"), F.col("id"), F.col("original_filename")).alias("original"), X.markdown_path(F.col("company_id"), F.col("id")).alias("markdown"))


@query("""SELECT device_id, path, state, strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f') AS updated FROM (SELECT DISTINCT device_id, path, state, updated_at FROM upload_journal WHERE state IN ('pending', 'failed')) ORDER BY updated_at DESC, device_id, path, state LIMIT 100""")
def journal_listing(spark: SparkSession, folder: str) -> DataFrame:
    """The hundred newest journal entries that are still to be sent: the listing's page."""
    rows = table(spark, folder, "upload_journal").filter(F.col("state").isin("pending", "failed")).select("device_id", "path", "state", "updated_at").distinct()
    newest = R.page_of(rows, 1, 100, F.desc("updated_at"), F.asc("device_id"), F.asc("path"), F.asc("state"))
    return newest.select("device_id", "path", "state", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("updated"))


@query("SELECT id, kind, row_number() OVER (PARTITION BY company_id ORDER BY kind, created_at, id) AS place FROM master_types")
def types_in_listing_order(spark: SparkSession, folder: str) -> DataFrame:
    """Each company's types as its listing has them: by kind, then by age."""
    order = Window.partitionBy("company_id").orderBy("kind", "created_at", "id")
    return table(spark, folder, "master_types").select("id", "kind", F.row_number().over(order).alias("place"))


@query("""WITH p AS (SELECT id, document_id, page_number FROM ocr_pages WHERE page_number IN (1, 2)) SELECT p.document_id, p.page_number, count(*) AS n, max(m.score) AS best FROM (SELECT DISTINCT * FROM master_matches) m JOIN p ON p.id = m.page_id JOIN master_records r ON r.id = m.master_record_id WHERE m.status <> 'dismissed' GROUP BY 1, 2""")
def matches_by_page(spark: SparkSession, folder: str) -> DataFrame:
    """The matches of a set of pages with their records, by page."""
    pages = table(spark, folder, "ocr_pages").filter(F.col("page_number").isin(1, 2)).select(F.col("id").alias("page_id"), "document_id", "page_number")
    matches = table(spark, folder, "master_matches").filter("status <> 'dismissed'").distinct()
    records = table(spark, folder, "master_records").select(F.col("id").alias("master_record_id"))
    return matches.join(pages, "page_id").join(records, "master_record_id").groupBy("document_id", "page_number").agg(F.count("*").alias("n"), F.max("score").alias("best"))


@query("SELECT device_id, path, CASE WHEN state = 'uploading' THEN 'pending' ELSE state END AS state, count(*) AS n FROM upload_journal GROUP BY 1, 2, 3")
def journal_after_restart(spark: SparkSession, folder: str) -> DataFrame:
    """Journal entries after a restart: what was on its way waits again."""
    rows = table(spark, folder, "upload_journal").withColumn("status", F.col("state"))
    waiting = lifecycle.swept(rows, F.lit("9999-01-01").cast("timestamp"), ("uploading",), "pending", "updated_at")
    return waiting.groupBy("device_id", "path", F.col("status").alias("state")).agg(F.count("*").alias("n"))


_KEYWORDS = ", ".join(f"({i}, '{kind}', '{word}')" for i, (kind, word) in enumerate(X.CATEGORY_KEYWORDS))


@query(f"""WITH m AS (SELECT p.document_id, string_agg(coalesce(r.markdown, '<!-- page ' || p.page_number || ': no text -->'), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY p.page_number, p.id) AS t FROM ocr_pages p LEFT JOIN ocr_results r ON r.page_id = p.id AND r.is_current GROUP BY 1),
k(o, kind, word) AS (VALUES {_KEYWORDS}), f AS (SELECT m.document_id, arg_min(k.kind, instr(m.t, k.word) * 100 + k.o) AS kind FROM m, k WHERE instr(m.t, k.word) > 0 GROUP BY 1)
SELECT d.id, CASE WHEN d.doc_type IS NULL OR trim(d.doc_type) IN ('', 'other') THEN coalesce(f.kind, d.doc_type) ELSE d.doc_type END AS doc_type FROM scan_documents d LEFT JOIN f ON f.document_id = d.id WHERE d.status IN ('completed', 'partially_failed')""")
def reclassified_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Finished documents with the category of their text where they have none or the general one."""
    texts = assembled_documents(spark, folder).select(F.col("document_id").alias("id"), X.category(F.col("markdown")).alias("found"))
    rows = table(spark, folder, "scan_documents").filter(F.col("status").isin("completed", "partially_failed")).select("id", "doc_type").join(texts, "id", "left")
    open_type = F.col("doc_type").isNull() | F.trim("doc_type").isin("", "other")
    return rows.select("id", F.when(open_type, F.coalesce("found", "doc_type")).otherwise(F.col("doc_type")).alias("doc_type"))
