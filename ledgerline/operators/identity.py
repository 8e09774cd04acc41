"""Postings to logical entities, conservatively: a row joins an entity only if its URLs name exactly one.

Rows are taken in the order of their keys, and what an earlier row was linked to is seen by later ones. Within a
company a URL (of jobs or of applications, each with its own kind) thus names nothing, one entity, or several;
several it stays. That makes most of the work parallel:

- a row that shares no URL is a new entity;
- a row that shares one URL changes nothing for others unless it is the first: it joins what the URL names at
  its place in the order, or is new where that is several;
- only rows that share both URLs tie two URLs together. They go in order through their connected component,
  with the first row of each URL, in one pass that holds the state of the component's URLs and no rows.

So a URL that most rows of a company share is one row of the pass. A component of rows that all share both URLs
is passed over in one task, as a stream.
"""

from __future__ import annotations

import hashlib
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import canonical_url, fingerprint, text_key
from ledgerline.lineage import cut
from ledgerline.operators.components import components

KEYS = ["source", "scope", "id"]
RESULT = "source string, scope string, id string, logical_id string, matched boolean"
#: What a pass gives: results of rows, and of URLs the entity they name and the key from which on they name several.
_PASSED = "url string, single string, source string, scope string, id string, logical_id string, matched boolean"


def new_id(source: str, scope: str, key: str) -> str:
    """A logical id that a repeated task makes again."""
    return str(uuid.UUID(bytes=hashlib.sha256(f"{len(source)}:{source}{len(scope)}:{scope}{key}".encode()).digest()[:16]))


def own_id() -> Column:
    """The same in the JVM."""
    text = F.concat(F.length("source").cast("string"), F.lit(":"), "source", F.length("scope").cast("string"), F.lit(":"), "scope", "id")
    return F.regexp_replace(F.substring(F.sha2(text, 256), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def _url(kind: str, column: str) -> Column:
    """A URL within its company and kind, as a digest; null without one."""
    return F.when(F.col(column).isNotNull(), F.md5(F.to_json(F.array(F.col("company"), F.lit(kind), F.col(column)))))


def keyed(rows: DataFrame) -> DataFrame:
    """KEYS, logical_id, own id, and digests of the URLs."""
    normal = rows.withColumns({"company": F.coalesce(text_key(F.col("company")), F.lit("")), "job_url": canonical_url(F.col("job_url")), "apply_url": canonical_url(F.col("apply_url"))})
    return normal.select(*KEYS, "logical_id", own_id().alias("own"), _url("job", "job_url").alias("j"), _url("apply", "apply_url").alias("a"))


def _pass(parts):
    """Rows sorted by (component, step, key); URLs come before rows. Holds what each URL of a component names."""
    names: dict[str, str | None] = {}  # the first entity, None for none, '' for several from the start
    several: dict[str, tuple] = {}  # the key of the row that made it several
    now = None
    columns = ["url", "single", *KEYS, "logical_id", "matched"]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({"matched": "boolean"})

    def urls() -> list[tuple]:
        return [(u, n, *several.get(u, (None, None, None)), None, None) for u, n in names.items()]

    for part in parts:
        out = []
        for r in part.itertuples(index=False):
            if r.component != now:
                out += urls()
                names, several, now = {}, {}, r.component
            if r.step == 0:
                names[r.j] = r.own if isinstance(r.own, str) else None
                continue
            mine = [u for u in (r.j, r.a) if isinstance(u, str)]
            known = {names[u] for u in mine if names[u] is not None}
            matched = len(known) == 1 and "" not in known and not any(u in several for u in mine)
            logical = known.pop() if matched else r.own
            for u in mine:
                if names[u] is None:
                    names[u] = logical
                elif not matched and names[u] != "":
                    several.setdefault(u, (r.source, r.scope, r.id))
            out.append((None, None, r.source, r.scope, r.id, logical, matched))
        yield frame(out)
    yield frame(urls())


def resolve(rows: DataFrame) -> DataFrame:
    """Links for the unlinked rows of (source, scope, id, company, job_url, apply_url, logical_id); keys are unique and not null.

    Null or blank companies are one company; null and invalid URLs link nothing.
    """
    all_rows = keyed(rows)
    ends = all_rows.select(F.explode(F.array("j", "a")).alias("u"), "logical_id").filter("u is not null")
    shared = ends.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("logical_id").alias("lo"), F.max("logical_id").alias("hi")).filter("n > 1")
    shared = shared.select("u", F.when(F.col("lo") != F.col("hi"), "").otherwise(F.col("lo")).alias("named"))
    flag = lambda c: shared.select(F.col("u").alias(c), F.lit(True).alias(f"{c}_shared"))
    opened = all_rows.filter("logical_id is null").join(flag("j"), "j", "left").join(flag("a"), "a", "left")
    sole = opened.select(*KEYS, "own", F.when(F.col("j_shared"), F.col("j")).alias("j"), F.when(F.col("a_shared"), F.col("a")).alias("a"))
    alone = sole.filter("j is null and a is null").select(*KEYS, F.col("own").alias("logical_id"), F.lit(False).alias("matched"))
    ties = sole.filter("j is not null and a is not null")
    leaves = sole.filter("(j is null) <> (a is null)").select(*KEYS, "own", F.coalesce("j", "a").alias("u"))
    first = leaves.groupBy("u").agg(F.min(F.struct(*KEYS, "own")).alias("first"))
    named = shared.join(first, "u", "left")

    node = lambda c: F.xxhash64(c)  # noqa: E731  # equal hashes only join components
    found = components(ties.select(node("j").alias("a"), node("a").alias("b")))
    tied = named.withColumn("node", node("u")).join(found, "node")
    nothing = F.lit(None).cast("string")
    url_rows = tied.select("component", F.lit(0).alias("step"), *(F.lit("").alias(k) for k in KEYS), F.col("named").alias("own"), F.col("u").alias("j"), nothing.alias("a"))
    first_rows = tied.filter("first is not null").select("component", F.lit(1).alias("step"), *(F.col(f"first.{k}").alias(k) for k in KEYS), F.col("first.own").alias("own"), F.col("u").alias("j"), nothing.alias("a"))
    tie_rows = ties.withColumn("node", node("j")).join(found, "node").select("component", F.lit(1).alias("step"), *KEYS, "own", "j", "a")
    order = ["component", "step", *KEYS]
    passed = url_rows.unionAll(first_rows).unionAll(tie_rows).repartition("component").sortWithinPartitions(*order).mapInPandas(_pass, _PASSED)
    passed = cut(passed)  # it is read for its rows and for its URLs
    of_rows = passed.filter("url is null").select(*KEYS, "logical_id", "matched")
    of_urls = passed.filter("url is not null").select(F.col("url").alias("u"), F.lit(True).alias("tied"), "single", F.when(F.col("source").isNotNull(), F.struct(*KEYS)).alias("until"))

    # A leaf joins what its URL named first, until a row made that several.
    judged = leaves.join(named.join(of_urls, "u", "left"), "u")
    mine = F.struct(*KEYS)
    is_first = F.coalesce(mine == F.struct(*(F.col(f"first.{k}").alias(k) for k in KEYS)), F.lit(False))
    tied = F.coalesce(F.col("tied"), F.lit(False))
    entity = F.coalesce("named", F.when(tied, F.col("single")).otherwise(F.col("first.own")))
    opens = F.col("named").isNull() & ~tied & is_first
    joins = (entity != "") & (F.col("until").isNull() | (mine < F.col("until"))) & ~opens
    by_leaf = judged.filter(~(tied & is_first)).select(*KEYS, F.when(joins, entity).otherwise(F.col("own")).alias("logical_id"), joins.alias("matched"))
    return alone.unionByName(of_rows).unionByName(by_leaf)


def _ends(rows: DataFrame, print_of: Column) -> DataFrame:
    """(kind, value, by) of each row and what it can be found by, with its key and logical id; by is a digest with the company."""
    normal = rows.withColumns({"_company": F.coalesce(text_key(F.col("company")), F.lit("")), "_job": canonical_url(F.col("job_url")), "_apply": canonical_url(F.col("apply_url")), "_print": print_of})
    ways = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(k).alias("kind"), F.col(c).alias("value")) for n, (k, c) in enumerate((("exact_canonical_job_url", "_job"), ("exact_canonical_apply_url", "_apply"), ("exact_content_fingerprint", "_print")))))
    ends = normal.select(*KEYS, "logical_id", "_company", F.explode(ways).alias("w")).filter("w.value is not null")
    company = F.when(F.col("w.n") < 2, F.col("_company")).otherwise("")
    return ends.select(*KEYS, "logical_id", "w.n", "w.kind", "w.value", F.md5(F.to_json(F.array(company, F.col("w.kind"), F.col("w.value")))).alias("by"))


def content_print(rows: DataFrame) -> Column:
    """SHA-256 of company, title, location (null apart from empty) and description, each as a text key."""
    return fingerprint(*(text_key(F.col(c)) for c in ("company", "title", "location", "description")))


def evidence(rows: DataFrame, resolved: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(KEYS, logical_id, created, evidence) of resolved rows: what each was compared with, in order.

    A row sees the rows that were linked before and those resolved before it. Evidence by URLs comes first, in the
    order of the matched keys, job URL before apply URL; then evidence by content. Evidence by URLs is an
    `automatic_link` where the row joined an entity; all else is a `duplicate_candidate`. `wanted` (KEYS) limits the
    rows that evidence is given for, as a run does to its new rows: each is joined with its candidates on a digest,
    so the result is as long as their evidence. For whole catalogs there is `evidence_groups`.
    """
    results = resolved.select(*KEYS, F.col("logical_id").alias("_new"), "matched")
    known = rows.join(results, KEYS, "left").withColumns({"_old": F.col("logical_id").isNotNull(), "logical_id": F.coalesce("logical_id", "_new")})
    ends = _ends(known, content_print(rows)).join(known.select(*KEYS, "_old", "matched"), KEYS)
    asked = ends.filter("not _old")
    asked = asked.join(wanted.select(*KEYS), KEYS, "left_semi") if wanted is not None else asked
    left = asked.select(*(F.col(k).alias(f"_{k}") for k in KEYS), "matched", "n", "kind", "value", "by")
    right = ends.select("by", "_old", *KEYS, "logical_id")
    earlier = F.struct(*KEYS) < F.struct(*(F.col(f"_{k}").alias(k) for k in KEYS))
    pairs = left.join(right, "by").filter(F.col("_old") | earlier)
    disposition = F.when(F.col("matched") & (F.col("n") < 2), "automatic_link").otherwise("duplicate_candidate")
    item = F.struct((F.col("n") == 2).alias("by_content"), *(F.col(k).alias(f"matched_{k}") for k in KEYS), "n", "kind", "value", F.col("logical_id").alias("matched_logical_id"), disposition.alias("disposition"))
    lists = pairs.groupBy(*(F.col(f"_{k}").alias(k) for k in KEYS)).agg(F.array_sort(F.collect_list(item)).alias("found"))
    shown = F.transform(F.coalesce("found", F.array().cast(lists.schema["found"].dataType)), lambda e: F.struct(*(e[f].alias(f) for f in ("kind", "matched_source", "matched_scope", "matched_id", "matched_logical_id", "disposition", "value"))))
    out = resolved.join(wanted.select(*KEYS), KEYS, "left_semi") if wanted is not None else resolved
    return out.join(lists, KEYS, "left").select(*KEYS, "logical_id", (~F.col("matched")).alias("created"), shown.alias("evidence"))


def evidence_groups(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """(kind, value, postings, entities, first): what several postings share, whatever their number; membership follows from the value."""
    results = resolved.select(*KEYS, F.col("logical_id").alias("_new"))
    known = rows.join(results, KEYS, "left").withColumn("logical_id", F.coalesce("logical_id", "_new"))
    ends = _ends(known, content_print(rows))
    by_entity = ends.groupBy("by", "kind", "value", "logical_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*KEYS)).alias("first"))
    return by_entity.groupBy("by", "kind", "value").agg(F.sum("n").alias("postings"), F.count(F.lit(1)).alias("entities"), F.min("first").alias("first")).filter("postings > 1").drop("by")
