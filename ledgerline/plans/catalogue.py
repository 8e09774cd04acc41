"""The operators' queries on the driver's tables, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import html
from ledgerline.functions.text import ascii_fold, canonical_url, contains_term
from ledgerline.operators import catalog, geography, identity, judging, lifecycle, metadata, occupation, outcomes, policy, report, screening, search, sync

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None):
    def kept(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return kept


def _keywords(spark: SparkSession, d: str, text: str) -> DataFrame:
    return search.search(table(spark, d, "documents"), search.Criteria(text)).select("doc_id", "source")


@query(f"SELECT doc_id, source FROM documents WHERE contains({LOWER.format('text')}, 'the') AND contains({LOWER.format('text')}, 'tion')")
def keyword_and(spark, d):
    return _keywords(spark, d, "the AND TION")


@query(f"SELECT doc_id, source FROM documents WHERE contains({LOWER.format('text')}, 'idiot') OR contains({LOWER.format('text')}, 'license')")
def keyword_or(spark, d):
    return _keywords(spark, d, "idiot OR License")


@query(f"SELECT doc_id, source FROM documents WHERE contains({LOWER.format('text')}, 'of the')")
def keyword_phrase(spark, d):
    return _keywords(spark, d, '"of the"')


@query(f"SELECT doc_id, source FROM documents WHERE contains({LOWER.format('text')}, 'é')")
def keyword_short(spark, d):
    return _keywords(spark, d, "é")


@query("SELECT doc_id FROM documents WHERE text LIKE '%\\%%' ESCAPE '\\'")
def like_literal_escape(spark, d):
    return table(spark, d, "documents").filter(contains_term(F.col("text"), "%")).select("doc_id")


@query("SELECT d.doc_id, d.source, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE d.lang = 'en' AND l.quality = 1 AND d.n_chars >= 500")
def facet_filter(spark, d):
    docs = search.search(table(spark, d, "documents"), search.Criteria(equal={"lang": "en"}, at_least={"n_chars": 500}))
    return docs.join(table(spark, d, "labels").filter("quality = 1"), "doc_id").select("doc_id", "source", "quality")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 25")
def search_page(spark, d):
    return search.page(table(spark, d, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), F.asc("doc_id")], 2)


@query(f"SELECT count(*) AS total FROM documents WHERE contains({LOWER.format('text')}, 'the')")
def search_total(spark, d):
    return search.search(table(spark, d, "documents"), search.Criteria("the")).agg(F.count(F.lit(1)).alias("total"))


@query(f"SELECT p_partkey, p_name FROM part ORDER BY {LOWER.format('p_name')}, p_partkey LIMIT 25")
def nocase_sort_topk(spark, d):
    return search.page(table(spark, d, "part").select("p_partkey", "p_name"), [ascii_fold(F.col("p_name")), F.asc("p_partkey")], 1)


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) ORDER BY l.quality DESC NULLS LAST, d.doc_id LIMIT 50")
def nulls_last_sort(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return search.page(rows, [F.desc_nulls_last("quality"), F.asc("doc_id")], 1, 50)


def _log(spark: SparkSession, d: str) -> DataFrame:
    """The events as snapshots: a scope for each type of event, a snapshot a day, users as postings."""
    return table(spark, d, "events").select(F.col("event_type").alias("scope"), F.col("user_id").alias("id"), F.to_date("ts").alias("at")).distinct()


LOG = "WITH log AS (SELECT DISTINCT event_type AS scope, user_id AS id, CAST(ts AS DATE) AS seen FROM events), times AS (SELECT scope, seen, lead(seen) OVER (PARTITION BY scope ORDER BY seen) AS next_at, row_number() OVER (PARTITION BY scope ORDER BY seen) AS n FROM (SELECT DISTINCT scope, seen FROM log)) "


@query(LOG + "SELECT s.scope, s.id, CASE WHEN t.next_at IS NULL THEN 'active' ELSE 'inactive' END AS status, s.first_seen, s.last_seen, t.next_at AS inactive_at FROM (SELECT scope, id, min(seen) AS first_seen, max(seen) AS last_seen FROM log GROUP BY ALL) s JOIN times t ON t.scope = s.scope AND t.seen = s.last_seen")
def lifecycle_reconcile(spark, d):
    return lifecycle.replay(_log(spark, d))


@query(LOG + "SELECT s.scope, s.id, CASE WHEN t.next_at IS NULL THEN 'active' ELSE 'inactive' END AS status, s.first_seen, s.last_seen, t.next_at AS inactive_at FROM (SELECT scope, id, min(seen) AS first_seen, max(seen) AS last_seen FROM log GROUP BY ALL) s JOIN times t ON t.scope = s.scope AND t.seen = s.last_seen")
def lifecycle_last_snapshot(spark, d):
    """The state before each scope's last snapshot, and that snapshot reconciled into it."""
    log = _log(spark, d)
    headers = log.groupBy("scope").agg(F.max("at").alias("at"))
    before = log.join(headers.withColumnRenamed("at", "last_at"), "scope").filter("at < last_at").select("scope", "id", "at")
    return lifecycle.reconcile(lifecycle.replay(before), log.join(headers, ["scope", "at"]).select("scope", "id"), headers)


@query(LOG + "SELECT scope, id, count(*) FILTER (WHERE gap > 1) AS returns FROM (SELECT l.scope, l.id, t.n - lag(t.n) OVER (PARTITION BY l.scope, l.id ORDER BY t.n) AS gap FROM log l JOIN times t USING (scope, seen)) GROUP BY ALL HAVING count(*) FILTER (WHERE gap > 1) > 0")
def reactivation_history(spark, d):
    return lifecycle.reactivations(_log(spark, d))


@query("SELECT event_id, event_type FROM (SELECT event_id, event_type, ts, max(ts) OVER (PARTITION BY event_type ORDER BY (event_id % 97) * 1000000000 + event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM events) WHERE ts <= newest")
def stale_snapshot_guard(spark, d):
    log = table(spark, d, "events").select("event_id", "event_type", F.col("event_type").alias("scope"), F.col("ts").alias("at"), ((F.col("event_id") % 97) * 1_000_000_000 + F.col("event_id")).alias("place"))
    return lifecycle.stale(log, "place").select("event_id", "event_type")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unlinked_anti(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("SELECT o_orderkey, o_totalprice FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45)")
def semi_candidates(spark, d):
    large = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").join(large, "o_orderkey", "left_semi")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def sibling_expand(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return lines.join(lines.filter("l_quantity > 49").select("l_orderkey"), "l_orderkey", "left_semi")


@query(r"""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), CASE WHEN lower(url) LIKE 'https:%' THEN ':443$' ELSE ':80$' END, '') || regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^#]*)', 1) AS canonical FROM pages""")
def url_canonical(spark, d):
    return table(spark, d, "pages").select("page_id", canonical_url(F.col("url")).alias("canonical"))


NORMAL = r"trim(regexp_replace(lower(text), '[ \t\n\x0b\f\r]+', ' ', 'g'))"


def _fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", report.text_print(F.col("text")).alias("fingerprint"))


@query(f"SELECT sha256({NORMAL}) AS fingerprint, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def content_fingerprint_groups(spark, d):
    return report.content_groups(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id")


@query(f"SELECT sha256({NORMAL}) AS fingerprint, count(DISTINCT source) AS sources FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def cross_source_duplicates(spark, d):
    return report.shared_groups(_fingerprints(spark, d), "fingerprint")


POLICY = policy.Policy(title_exclude=("src1",), description_include=("the", "der", "la"), description_exclude=("idiot", "license"))


#: The same on a catalog's columns; its companies are languages.
CATALOG_POLICY = policy.Policy(company_exclude=("ES",), description_include=POLICY.description_include, description_exclude=POLICY.description_exclude)


def _decided(spark: SparkSession, d: str) -> DataFrame:
    return policy.decide(table(spark, d, "documents").select("doc_id", "source", "text"), POLICY, title="source", company=None, description="text")


REASONS = f"""WITH r AS (SELECT doc_id, 'title' AS field, 'exclude_match' AS kind, 'src1' AS term FROM documents WHERE contains(lower(source), 'src1')
UNION ALL SELECT doc_id, 'description', 'exclude_match', t FROM documents, (VALUES ('idiot'), ('license')) v(t) WHERE contains({NORMAL}, t)
UNION ALL SELECT doc_id, 'description', 'no_include_match', NULL FROM documents WHERE NOT (contains({NORMAL}, 'the') OR contains({NORMAL}, 'der') OR contains({NORMAL}, 'la'))) """


@query(REASONS + "SELECT d.doc_id, count(r.field) > 0 AS rejected, count(r.field) AS n_reasons FROM documents d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id")
def policy_decisions(spark, d):
    return _decided(spark, d).select("doc_id", "rejected", F.size("reasons").cast("long").alias("n_reasons"))


#: Hundreds of literal terms, by a rule.
TERMS = tuple(a + b + c for a in ("th", "an", "er", "in", "re", "ti", "qu", "zy") for b in ("ou", "ea", "io", "ng", "nd", "st") for c in ("able", "ation", "edly", "ing", "ster", "wh"))


@query(f"SELECT doc_id, list_filter({list(TERMS)}, lambda t: contains(n, t)) AS l, len(l) > 0 AS rejected, len(l)::BIGINT AS n_reasons, coalesce(array_to_string(l, ','), '') AS terms FROM (SELECT doc_id, {NORMAL} AS n FROM documents)".replace("SELECT doc_id, list_filter", "SELECT doc_id, rejected, n_reasons, terms FROM (SELECT doc_id, list_filter", 1) + ")")
def policy_many_terms(spark, d):
    """Hundreds of excluded terms in one pass over each text."""
    rules = policy.Policy(description_exclude=TERMS)
    decided = policy.decide(table(spark, d, "documents").select("doc_id", "source", "text"), rules, title="source", company=None, description="text")
    return decided.select("doc_id", "rejected", F.size("reasons").cast("long").alias("n_reasons"), F.array_join(F.transform("reasons", lambda r: r["term"]), ",").alias("terms"))


@query(REASONS + "SELECT field, kind, term, count(*) AS n FROM r GROUP BY ALL")
def policy_reason_counts(spark, d):
    return report.reason_counts(_decided(spark, d))


def _postings(spark: SparkSession, d: str) -> DataFrame:
    """Documents as postings: a logical entity for each source and language, labels as status and outcome."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    outcome = F.when(F.col("toxic") == 1, "exclude").when(F.col("quality") == 1, "keep").otherwise("defer")
    return docs.join(labels, "doc_id", "left").select(F.concat_ws("/", "source", "lang").alias("logical_id"), "doc_id", F.concat(F.lit("t"), "doc_id").alias("title"), F.when(F.col("quality").isNotNull(), "active").otherwise("inactive").alias("status"), outcome.alias("outcome"), F.col("n_chars").alias("first_seen"), F.col("n_chars").alias("last_seen"), F.col("n_chars").alias("posted_at"))


POSTINGS = "WITH p AS (SELECT d.source || '/' || d.lang AS logical_id, d.doc_id, 't' || d.doc_id AS title, l.quality IS NOT NULL AS active, CASE WHEN l.toxic = 1 THEN 0 WHEN l.quality = 1 THEN 2 ELSE 1 END AS r, d.n_chars FROM documents d LEFT JOIN labels l USING (doc_id)), k AS (SELECT *, CASE WHEN active THEN r ELSE 0 END AS priority FROM p) "


@query(POSTINGS + "SELECT logical_id, CASE max(r) WHEN 2 THEN 'keep' WHEN 1 THEN 'defer' ELSE 'exclude' END AS outcome FROM p WHERE active GROUP BY logical_id")
def outcome_rank(spark, d):
    return outcomes.by_logical(_postings(spark, d).filter("status = 'active'"))


@query(POSTINGS + "SELECT logical_id, arg_min(title, (-priority) * 1000000000000 + doc_id) AS title, arg_min(doc_id, (-priority) * 1000000000000 + doc_id) AS rep_doc_id, min(n_chars) AS first_seen, max(n_chars) AS last_seen, CASE max(CASE WHEN active THEN r END) WHEN 2 THEN 'keep' WHEN 1 THEN 'defer' ELSE 'exclude' END AS outcome, min(CASE WHEN active THEN n_chars END) AS posted_at, count(*) AS n_rows FROM k GROUP BY logical_id")
def logical_summary(spark, d):
    return outcomes.summary(_postings(spark, d), ["doc_id"])


@query(POSTINGS + "SELECT logical_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY logical_id ORDER BY priority DESC, doc_id) AS rn FROM k) WHERE rn = 1")
def representative(spark, d):
    rows = _postings(spark, d)
    priority = outcomes.active_priority(F.col("status"), F.col("outcome"))
    return outcomes.representative(rows.withColumn("priority", priority), [F.desc("priority"), F.asc("doc_id")]).select("logical_id", "doc_id")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality = 1")
def set_difference(spark, d):
    return report.rejected(table(spark, d, "documents"), table(spark, d, "labels").filter("quality = 1"), "doc_id")


@query("SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE toxic = 1")
def set_intersection(spark, d):
    return report.both(table(spark, d, "documents").filter("lang = 'en'"), table(spark, d, "labels").filter("toxic = 1"), "doc_id")


@query("SELECT source, lang, count(*) AS n, count(*) FILTER (WHERE n_chars > 2000) AS n_long FROM documents GROUP BY GROUPING SETS ((source), (source, lang), ())")
def report_by_scope(spark, d):
    return report.by_scope(table(spark, d, "documents"), ["source", "lang"], n_long=F.col("n_chars") > 2000)


@query("SELECT count(*) AS postings, count(DISTINCT source) AS sources, count(*) FILTER (WHERE l.quality = 1) AS kept, count(*) FILTER (WHERE l.doc_id IS NULL) AS unlinked, CASE WHEN count(*) = 0 THEN 0.0 ELSE round(100.0 * count(*) FILTER (WHERE l.quality = 1) / count(*), 2) END AS kept_percent FROM documents d LEFT JOIN labels l USING (doc_id)")
def report_counters(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels").withColumn("linked", F.lit(True)), "doc_id", "left")
    return report.counters(rows, "source", F.col("quality") == 1, F.col("linked").isNotNull())


def _masks() -> list[Column]:
    return [F.col("n_chars") > 4000, contains_term(F.col("text"), "idiot"), F.col("lang") == "es"]


@query(f"""WITH g AS (SELECT source || '/' || lang AS logical_id, max(CASE WHEN n_chars > 4000 THEN 0 ELSE 1 END) AS m1, max(CASE WHEN n_chars > 4000 OR contains({LOWER.format('text')}, 'idiot') THEN 0 ELSE 1 END) AS m2, max(CASE WHEN n_chars > 4000 OR contains({LOWER.format('text')}, 'idiot') OR lang = 'es' THEN 0 ELSE 1 END) AS m3 FROM documents GROUP BY 1)
SELECT count(*) AS eligible, count(*) FILTER (WHERE m1 = 0) AS first_removed, count(*) FILTER (WHERE m1 = 1 AND m2 = 0) AS second_removed, count(*) FILTER (WHERE m2 = 1 AND m3 = 0) AS third_removed, count(*) FILTER (WHERE m3 = 1) AS remaining FROM g""")
def funnel_incremental(spark, d):
    a, b, c = _masks()
    return report.funnel(table(spark, d, "documents"), F.concat_ws("/", "source", "lang"), {"first_removed": a, "second_removed": b, "third_removed": c})


@query(f"SELECT count(*) FILTER (WHERE n_chars > 4000 AND contains({LOWER.format('text')}, 'idiot')) AS long_and_rude, count(*) FILTER (WHERE n_chars > 4000 AND lang = 'es') AS long_and_es, count(*) FILTER (WHERE contains({LOWER.format('text')}, 'idiot') AND lang = 'es') AS rude_and_es FROM documents")
def pair_overlap(spark, d):
    a, b, c = _masks()
    return report.overlaps(table(spark, d, "documents"), {"long": a, "rude": b, "es": c})


@query("SELECT CASE WHEN doc_id % 11 = 0 THEN 'deleted' WHEN doc_id % 11 = 1 THEN 'new' WHEN doc_id % 11 = 2 THEN 'text' WHEN doc_id % 11 = 3 THEN 'screen' WHEN doc_id % 11 = 4 THEN 'metadata' ELSE 'same' END AS change, count(*) AS n FROM documents GROUP BY 1")
def incremental_change_class(spark, d):
    """The table against a variant of itself that has every kind of change."""
    docs, kind = table(spark, d, "documents"), F.col("doc_id") % 11
    parts = {"keys": ["doc_id"], "text": ["text"], "inputs": ["source"], "metadata": ["lang"]}
    changed = docs.withColumns({"text": F.when(kind == 2, F.concat("text", F.lit("+"))).otherwise(F.col("text")), "source": F.when(kind == 3, F.lit("moved")).otherwise(F.col("source")), "lang": F.when(kind == 4, F.lit("xx")).otherwise(F.col("lang"))})
    found = sync.changes(sync.hashed(docs.filter(kind != 1), **parts), sync.hashed(changed.filter(kind != 0), **parts), ["doc_id"])
    return found.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, strftime(ts - INTERVAL 8 HOUR, '%Y-%m-%d %I:%M %p') AS shown FROM events")
def display_fixed_offset(spark, d):
    return table(spark, d, "events").select("event_id", report.shown_time(F.col("ts")).alias("shown"))


@query("SELECT event_id, ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' AS in_range FROM events")
def epoch_range_guard(spark, d):
    return table(spark, d, "events").select("event_id", ((F.col("ts") >= F.expr("TIMESTAMP_NTZ '2024-01-10'")) & (F.col("ts") < F.expr("TIMESTAMP_NTZ '2024-01-20'"))).alias("in_range"))


@query(r"SELECT doc_id, left(trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g')), 320) AS shown FROM documents")
def description_preview(spark, d):
    return table(spark, d, "documents").select("doc_id", report.shown(F.col("text")).alias("shown"))


CATALOG = """WITH p AS (SELECT d.source || '/' || d.lang AS g, d.doc_id, d.text, d.n_chars, l.quality IS NOT NULL AS active, CASE WHEN l.toxic = 1 THEN 0 WHEN l.quality = 1 THEN 2 ELSE 1 END AS r FROM documents d LEFT JOIN labels l USING (doc_id)),
m AS (SELECT DISTINCT g FROM p WHERE active AND contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'idiot')),
e AS (SELECT g AS id, arg_min('t' || doc_id, (CASE WHEN active THEN -r ELSE 0 END) * 1000000000000 + doc_id) AS title, min(n_chars) AS first_seen, max(n_chars) AS last_seen, CASE max(r) FILTER (WHERE active) WHEN 2 THEN 'keep' WHEN 1 THEN 'defer' ELSE 'exclude' END AS outcome FROM p WHERE g IN (FROM m) GROUP BY g) """


def _catalog(spark: SparkSession, d: str) -> catalog.Catalog:
    """Documents as a catalog: an entity for each source and language, labels as status, times in seconds of n_chars."""
    docs = table(spark, d, "documents").select(F.col("source").alias("source"), F.lit("all").alias("source_scope"), F.col("doc_id").alias("source_job_id"), F.col("lang").alias("company"), F.concat(F.lit("t"), "doc_id").alias("title"), F.col("text").alias("description"), F.lit(None).cast("string").alias("location"), F.lit("").alias("job_url"), F.lit("").alias("apply_url"), F.lit(None).cast("timestamp").alias("posted_at"), F.lit(None).cast("string").alias("employment_type"), F.lit(None).cast("string").alias("workplace_type"))
    state = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").select("source", F.lit("all").alias("source_scope"), F.col("doc_id").alias("source_job_id"), F.when(F.col("quality").isNotNull(), "active").otherwise("inactive").alias("status"), F.timestamp_seconds("n_chars").alias("first_seen_at"), F.timestamp_seconds("n_chars").alias("last_seen_at"))
    links = table(spark, d, "documents").select("source", F.lit("all").alias("source_scope"), F.col("doc_id").alias("source_job_id"), F.concat_ws("/", "source", "lang").alias("logical_job_id"))
    return catalog.Catalog(docs, state, links)


def _search(spark: SparkSession, d: str) -> catalog.Results:
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("_id"), "quality", "toxic")
    outcome = F.when(F.col("toxic") == 1, "exclude").when(F.col("quality") == 1, "keep").otherwise("defer")

    def judge(rows: DataFrame) -> DataFrame:
        return rows.join(labels, F.col("source_job_id") == F.col("_id"), "left").withColumns({"outcome": outcome, "reasons": F.array(F.lit("label"))}).drop("_id", "quality", "toxic")

    return catalog.search_catalog(_catalog(spark, d), judge, catalog.CatalogCriteria(keywords="idiot", outcome="all", sort="title"))


@query(CATALOG + "SELECT id, title, first_seen, last_seen, outcome FROM e")
def catalog_search(spark, d):
    """All entities that a search matches."""
    return _search(spark, d).matched.select("id", "title", F.unix_seconds("first_seen").alias("first_seen"), F.unix_seconds("last_seen").alias("last_seen"), "outcome")


JUDGED = REASONS.replace("SELECT doc_id, 'title' AS field, 'exclude_match' AS kind, 'src1' AS term FROM documents WHERE contains(lower(source), 'src1')", "SELECT doc_id, 'company' AS field, 'exclude_match' AS kind, 'es' AS term FROM documents WHERE lang = 'es'") + """, p AS (SELECT d.source || '/' || d.lang AS g, d.doc_id, d.text, d.n_chars, l.quality IS NOT NULL AS active, CASE WHEN d.doc_id IN (SELECT doc_id FROM r) THEN 0 WHEN trim(d.text) = '' THEN 1 ELSE 2 END AS r FROM documents d LEFT JOIN labels l USING (doc_id)),
m AS (SELECT DISTINCT g FROM p WHERE active AND (contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'idiot') OR contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'permission is'))) """


@query(JUDGED + "SELECT g AS id, arg_min('t' || doc_id, (CASE WHEN active THEN -r ELSE 0 END) * 1000000000000 + doc_id) AS title, max(n_chars) AS last_seen, 'keep' AS outcome FROM p WHERE g IN (FROM m) GROUP BY g HAVING max(r) FILTER (WHERE active) = 2")
def catalog_keep(spark, d):
    """A search whose postings are judged by policy, screening and geography, and whose entities are kept."""
    whole = _catalog(spark, d)
    criteria = catalog.CatalogCriteria(keywords='idiot OR "permission is"', outcome="keep")
    return catalog.search_catalog(whole, judging.judge(whole, CATALOG_POLICY), criteria).matched.select("id", "title", F.unix_seconds("last_seen").alias("last_seen"), "outcome")


@query(JUDGED + "SELECT g AS logical_job_id, CASE max(r) WHEN 2 THEN 'keep' WHEN 1 THEN 'defer' ELSE 'exclude' END AS outcome FROM p WHERE active GROUP BY g")
def screened_catalog(spark, d):
    """The outcome of each entity over all its active postings."""
    return judging.logical_outcomes(judging.screen_catalog(_catalog(spark, d), CATALOG_POLICY)).withColumnRenamed("logical_id", "logical_job_id")


@query(CATALOG + ", s AS (SELECT id, title FROM e ORDER BY translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), split_part(id, '/', 2), id LIMIT 25) SELECT s.id, s.title, count(*) AS n_postings, min(p.doc_id) AS first_posting FROM s JOIN p ON p.g = s.id GROUP BY s.id, s.title")
def catalog_page(spark, d):
    """The first page of the same search with its postings."""
    return _search(spark, d).page.select("id", "title", F.size("representations").cast("long").alias("n_postings"), F.array_min(F.transform("representations", lambda r: r["source_job_id"])).alias("first_posting"))


@query("SELECT doc_id, count(*) AS n_clauses, max(length(c)) AS longest FROM (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '[\n.!?]+'), lambda c: trim(regexp_replace(regexp_replace(c, '^[ \\-•\t]+|[ \\-•\t]+$', '', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g'))), lambda c: c <> '')) AS c FROM documents) GROUP BY doc_id")
def occupation_clauses(spark, d):
    parts = table(spark, d, "documents").select("doc_id", F.explode(F.filter(occupation.clauses(F.col("text")), lambda c: c != "")).alias("c"))
    return parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_clauses"), F.max(F.length("c")).cast("long").alias("longest"))


@query(r"""SELECT doc_id, count(*) AS n_clauses, max(length(c)) AS longest FROM (SELECT doc_id, unnest(list_filter(list_transform(
regexp_split_to_array(regexp_replace(replace(text, 'U.S.', 'United States'), '([.!?])\s+([A-Z])', '\1' || chr(10) || '\2', 'g'), '\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]'),
lambda c: trim(regexp_replace(regexp_replace(c, '^[ \-•\t]+|[ \-•\t]+$', '', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g'))), lambda c: c <> '')) AS c FROM documents) GROUP BY doc_id""")
def clause_split(spark, d):
    """Lines and sentences in which geography looks for mentions."""
    parts = table(spark, d, "documents").select("doc_id", F.explode(geography.clauses(F.col("text"))).alias("c"))
    return parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_clauses"), F.max(F.length("c")).cast("long").alias("longest"))


@query(r"""SELECT doc_id, c AS duty FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[\n.!?]+'), lambda c: trim(regexp_replace(regexp_replace(c, '^[ \-•\t]+|[ \-•\t]+$', '', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g'))),
lambda c: regexp_matches(c, '(?i)idiot|license') AND NOT regexp_matches(regexp_extract(c, '(?i)^(.*?)(?:idiot|license)', 1), '(?i)(^|[^\pL\pN_])(not|never|no)([^\pL\pN_]|$)'))[1] AS c FROM documents) WHERE c IS NOT NULL""")
def duty_match(spark, d):
    """The first clause that names a term with no negation before it."""
    return table(spark, d, "documents").select("doc_id", occupation.duty(occupation.clauses(F.col("text")), "idiot|license").alias("duty")).filter("duty is not null")


#: Names that a nation's number stands for: the home country, foreign ones, and one that the gazetteer does not know.
NAMES = ("UNITED STATES", "KENYA", "IRAN", "PERU", "SAUDI ARABIA")
NATIONS = f"SELECT *, n = 'UNITED STATES' AS us, n NOT IN ('UNITED STATES', 'IRAN') AS known FROM (SELECT c_custkey, c_mktsegment AS m, ({list(NAMES)})[c_nationkey % 5 + 1] AS n FROM customer)"


@query(f"""WITH c AS ({NATIONS}), r AS (SELECT *, CASE WHEN us THEN 'US_or_worldwide_work_option' WHEN NOT known THEN 'unknown_work_eligibility' WHEN m = 'BUILDING' THEN 'structured_foreign_work_location'
WHEN m = 'AUTOMOBILE' THEN 'foreign_tag_with_unclear_remote_boundary' WHEN m = 'MACHINERY' THEN 'structured_foreign_remote_boundary' WHEN m = 'HOUSEHOLD' THEN 'possible_country_market_tag' ELSE 'explicit_foreign_employee_location' END AS reason FROM c)
SELECT c_custkey, CASE WHEN us THEN 'keep' WHEN known AND m NOT IN ('AUTOMOBILE', 'HOUSEHOLD') THEN 'exclude' ELSE 'defer' END AS outcome, reason,
CASE WHEN known THEN array_to_string(list_transform(string_split(lower(n), ' '), lambda w: upper(w[1]) || w[2:]), ' ') ELSE '' END AS countries, CASE WHEN m IN ('AUTOMOBILE', 'MACHINERY') THEN 'remote' ELSE 'unspecified' END AS work_mode FROM r""")
def geography_decisions(spark, d):
    """Customers as postings of their nation: the segment decides how the nation is put."""
    m, n = F.col("c_mktsegment"), F.element_at(F.array(*map(F.lit, NAMES)), F.col("c_nationkey") % 5 + 1)
    place = F.when(m == "AUTOMOBILE", F.concat(F.lit("Remote - "), n)).when(m == "MACHINERY", F.concat(F.lit("Remote within "), n)).when(m != "FURNITURE", n)
    text = F.when(m == "HOUSEHOLD", "Write as a freelancer.").when(m == "FURNITURE", F.concat(F.lit("Candidates must reside in "), n, F.lit("."))).otherwise("Fine work.")
    rows = table(spark, d, "customer").select("c_custkey", F.lit("greenhouse").alias("source"), F.lit("Clerk").alias("title"), place.alias("location"), text.alias("description"), F.lit(None).cast("string").alias("payload_json"))
    g = F.col("geography")
    return geography.assess(rows).select("c_custkey", g["outcome"].alias("outcome"), g["reason"].alias("reason"), F.array_join(g["countries"], ",").alias("countries"), g["work_mode"].alias("work_mode"))


@query("""WITH c AS (SELECT c_custkey, c_mktsegment AS m, c_acctbal > 9000 AS blank, c_acctbal < 0 AS denied FROM customer),
j AS (SELECT *, CASE WHEN blank OR denied THEN '' WHEN m = 'BUILDING' THEN 'retail_store_operations' WHEN m = 'MACHINERY' THEN 'licensed_clinical_care' WHEN m = 'HOUSEHOLD' THEN 'food_service_operations' WHEN m = 'FURNITURE' THEN 'paid_survey_participation' ELSE '' END AS job FROM c)
SELECT c_custkey, CASE WHEN job <> '' THEN 'exclude' WHEN blank THEN 'defer' ELSE 'keep' END AS outcome, CASE WHEN blank THEN 'insufficient_description' ELSE job END AS reasons FROM j""")
def screening_outcomes(spark, d):
    """Customers as postings: the segment gives the title, the balance the description."""
    m, balance = F.col("c_mktsegment"), F.col("c_acctbal")
    title = F.when(m == "BUILDING", "Cashier").when(m == "AUTOMOBILE", "Software Cashier").when(m == "MACHINERY", "Registered Nurse").when(m == "HOUSEHOLD", "Line cook").otherwise("Survey taker")
    duties = "You process transactions. Provide good patient care! Bake fresh cookies\nComplete paid surveys"
    text = F.when(balance > 9000, " tbd ").when(balance < 0, "You do not process transactions. Never provide patient care! No need to bake cookies\nDo not complete paid surveys").otherwise(duties)
    rows = table(spark, d, "customer").select("c_custkey", title.alias("title"), text.alias("description"))
    return screening.screen(rows).select("c_custkey", F.col("screening.outcome").alias("outcome"), F.array_join("screening.reasons", ",").alias("reasons"))


@query("SELECT event_type AS kind, CASE event_type WHEN 'click' THEN 'contract' WHEN 'view' THEN 'full_time' WHEN 'purchase' THEN 'part_time' END AS class, count(*) AS n FROM events GROUP BY ALL")
def metadata_map(spark, d):
    """Event types as exact aliases of classes, by a map in the projection."""
    return table(spark, d, "events").select(F.col("event_type").alias("kind"), metadata.alias(F.col("event_type"), {"click": "contract", "view": "full_time", "purchase": "part_time"}).alias("class")).groupBy("kind", "class").agg(F.count(F.lit(1)).alias("n"))


@query(None)
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", html.greenhouse_text(F.col("html")).alias("text"))


OWN = "(length({s})::VARCHAR || ':' || {s} || '3:all' || {i})"


@query(f"""WITH c AS (SELECT c_mktsegment AS s, c_nationkey AS n, lpad(c_custkey::VARCHAR, 9, '0') AS i FROM customer), f AS (SELECT s, n, min(i) AS first FROM c GROUP BY ALL)
SELECT i AS id, regexp_replace(substr(sha256({OWN.format(s="s", i="first")}), 1, 32), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '\\1-\\2-\\3-\\4-\\5') AS logical_id, i <> first AS matched FROM c JOIN f USING (s, n)""")
def identity_links(spark, d):
    """Customers as postings of their segment, whose job URL is their nation's: all of a nation are one entity, the first makes its id."""
    key = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("source"), F.lit("all").alias("scope"), key.alias("id"), F.col("c_mktsegment").alias("company"), F.concat(F.lit("https://H:443/"), F.col("c_nationkey").cast("string")).alias("job_url"), F.lit(None).cast("string").alias("apply_url"), F.lit(None).cast("string").alias("logical_id"))
    return identity.resolve(rows).select("id", "logical_id", "matched")


@query("""WITH r AS (SELECT CASE WHEN c_acctbal < 0 THEN 'greenhouse' ELSE 'lever' END AS source, CASE WHEN c_mktsegment = 'BUILDING' THEN 'full_time' END AS old, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'contract' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'temporary' END AS found, c_acctbal > 9500 AS odd FROM customer)
SELECT source, count(*) AS total, count(*) FILTER (WHERE odd) AS invalid_payload, count(*) FILTER (WHERE NOT odd AND old IS NULL AND found IS NOT NULL) AS employment_type_enriched,
count(*) FILTER (WHERE NOT odd AND (old IS NOT NULL OR found IS NOT NULL)) AS employment_type_populated, count(*) FILTER (WHERE NOT odd AND old IS NULL AND found IS NULL) AS employment_type_missing FROM r GROUP BY source""")
def backfill_counts(spark, d):
    """Customers as postings of two providers, with payloads from their segment and balance."""
    m, balance = F.col("c_mktsegment"), F.col("c_acctbal")
    word = F.when(m == "BUILDING", "Contract").when(m == "MACHINERY", " fixed-term_CONTRACT").when(m == "HOUSEHOLD", "Seasonal").otherwise("a fine job")
    lever = F.concat(F.lit('{"categories": {"commitment": "'), word, F.lit('"}}'))
    board = F.concat(F.lit('{"metadata": [{"name": "Employment  Type", "value": "'), word, F.lit('"}, {"name": "other", "value": "Seasonal"}]}'))
    payload = F.when(balance > 9500, "[1]").when(balance < 0, board).otherwise(lever)
    rows = table(spark, d, "customer").select(F.when(balance < 0, "greenhouse").otherwise("lever").alias("source"), payload.alias("payload_json"), F.expr("TIMESTAMP '2024-01-01 00:00:00Z'").alias("retrieved_at"), F.when(m == "BUILDING", "full_time").alias("employment_type"))
    return metadata.backfill_counters(metadata.extract(rows), ("employment_type",))
