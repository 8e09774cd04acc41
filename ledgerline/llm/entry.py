"""The operators' queries over the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import alignment, ann, bpe_codec, divergence, neardup, orc_ids, packing, quality, sharding, substring, token_counts, toxicity, warc
from ledgerline.llm.scratch import new_folder

WORD_BPE = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words")


def op4_fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(warc.plan(table(spark, sf_dir, "pages")), warc.archive_folder(spark))
    return warc.whole(warc.read(manifest, payloads=False)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    return sharding.shard(rows, [1.0] * 16, grown=1.0).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_dynamic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op8_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))))
    scored = toxicity.score(docs, weights)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_orc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = orc_ids.write(table(spark, sf_dir, "documents"), new_folder(spark, "orc"), public_tokenizers.path(WORD_BPE))
    return orc_ids.digests(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_bpe_codec, op3_quality_rules, op4_fingerprint_index, op5_warc_salvage, op6_rendezvous_shards, op7_dynamic_packing, op8_tensored_minhash, op9_ftrl_toxicity, op10_collision_counting, op11_source_divergence, op12_orc_ids, op13_token_alignment)
}

W = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
#: The sharding's hash of key and salt; with equal weights the greatest hash has the highest score.
UNIT = "((('0x' || substr(md5(doc_id::VARCHAR || ':' || {}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"
STOPS = ", ".join(f"'{w}'" for w in quality.STOP_FORMS)

ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": rf"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS text, {W} AS w FROM documents),
b AS (SELECT *, len(w) AS n_words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM a),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM b, range(1, n_words - 1) r(i)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM d, range(0, 3) s(k) GROUP BY doc_id),
m AS (SELECT doc_id, n_words::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, len(list_filter(w, lambda x: x IN ({STOPS})))::BIGINT AS n_stop_words
  FROM b LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(n_words, 1)::DOUBLE AS nw FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / nw BETWEEN 2 AND 12 AND n_symbols / nw <= 0.2 AND n_stop_words / nw >= 0.02 AND n_dup_lines / greatest(n_lines, 1)::DOUBLE <= 0.5 AS kept, n_lines, n_stop_words FROM f""",
    "op4_fingerprint_index": rf"""
WITH a AS (SELECT doc_id, {W} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS t FROM a, range(1, len(w) - 11) r(i)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY t) AS lo FROM g) WHERE lo < doc_id),
c AS (SELECT doc_id, list(DISTINCT i + k) AS cut FROM d, range(0, 13) s(k) GROUP BY doc_id),
e AS (SELECT doc_id, i, w[i] AS x FROM a, range(1, len(w) + 1) r(i)),
k AS (SELECT e.doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM e LEFT JOIN c USING (doc_id) WHERE cut IS NULL OR NOT list_contains(cut, i) GROUP BY e.doc_id)
SELECT a.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM a LEFT JOIN k USING (doc_id)""",
    "op5_warc_salvage": """
WITH a AS (SELECT page_id, encode(coalesce(html, '')) AS p FROM pages), b AS (SELECT page_id, octet_length(p) AS n, sha1(p) AS h FROM a),
l AS (SELECT h, max(page_id) AS top FROM b GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM b JOIN l USING (h)""",
    "op6_rendezvous_shards": rf"""
WITH t AS (SELECT list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS v, n FROM range(0, 256) r(n)),
tab AS (SELECT list(v ORDER BY n) AS tab FROM t),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM documents),
c AS (SELECT doc_id, CASE WHEN text IS NULL THEN 1 ELSE size END AS size, b FROM d JOIN documents USING (doc_id)),
u AS (SELECT doc_id, list_transform(range(0, 17), lambda i: {UNIT.format("i::VARCHAR")}) AS u, {UNIT.format("'bucket'")} AS k FROM documents),
s AS (SELECT doc_id, floor(k * 4096)::BIGINT AS k, list_position(u[1:16], list_max(u[1:16])) - 1 AS shard, list_position(u, list_max(u)) - 1 AS grown FROM u)
SELECT s.doc_id, size::BIGINT AS size, xor(list_reduce(b, lambda x, y: xor(x >> 8, tab[(xor(x, y) & 255) + 1]), 4294967295), 4294967295)::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY k, s.doc_id) - 1)::BIGINT AS slot, grown::INTEGER AS grown_shard FROM s JOIN c USING (doc_id), tab""",
    "op8_tensored_minhash": rf"""
WITH RECURSIVE a AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS t FROM a, range(1, greatest(len(w) - 3, least(len(w), 1) + 1)) r(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y USING (t) JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id WHERE x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 85 * (nx.n + ny.n - count(*))),
c AS (SELECT doc_id, doc_id AS o FROM documents UNION SELECT l.b, c.o FROM c JOIN l ON l.a = c.doc_id WHERE c.o < l.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(c.o) AS component_id, d.doc_id = min(c.o) AS kept FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id, n.n""",
    "op11_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n) AS size FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, coalesce(sum(n), 0) AS size FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (s.size + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 5)) // (l.size + 5 * l.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) JOIN s USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o) WHERE part = 'pair' OR rank <= 50""",
}
