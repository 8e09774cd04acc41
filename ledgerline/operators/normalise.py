"""Providers' payloads as normalised postings, with what is wrong in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import html
from ledgerline.operators.metadata import member, text_of
from ledgerline.operators.rows import web_url

COLUMNS = ["source", "source_scope", "source_job_id", "company", "title", "description", "location", "job_url", "apply_url", "retrieved_at", "payload_json", "violations"]


def blank_to_null(c: Column) -> Column:
    trimmed = F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    return F.when(trimmed != "", trimmed)


def _text(p: Column, path: str) -> Column:
    return blank_to_null(text_of(member(p, path)))


def _kind(p: Column, path: str, *kinds: str) -> Column:
    """Whether a member is there, not null, and of another kind."""
    kind = F.schema_of_variant(member(p, path))
    return F.coalesce((kind != "VOID") & ~kind.rlike("^(" + "|".join(kinds) + ")"), F.lit(False))


def _violations(**found: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in found.items()]))


def lever(rows: DataFrame) -> DataFrame:
    """From (source_scope, company, retrieved_at, payload_json). Sections of the description are parted by an empty line; the body stands in for none."""
    p = F.col("_p")
    named = rows.withColumn("_p", F.try_parse_json("payload_json"))
    items = F.array_compact(F.try_variant_get(p, "$.lists", "array<struct<text:string,content:string>>"))
    parts = F.flatten(F.array(F.array(html.lines(_text(p, "$.descriptionPlain"))), F.coalesce(html.list_sections(items), F.array().cast("array<string>")), F.array(html.lines(_text(p, "$.additionalPlain")))))
    sections = F.array_join(F.filter(parts, lambda s: s.isNotNull() & (s != "")), "\n\n")
    body = F.coalesce(html.lines(_text(p, "$.descriptionBodyPlain")), html.lever_text(_text(p, "$.descriptionBody")), F.lit(""))
    members = F.try_variant_get(p, "$.lists", "array<variant>")
    kind_of = lambda m, path: F.coalesce(F.schema_of_variant(member(m, path)), F.lit("VOID"))
    # Headings and contents are texts or null; a number is not read as its digits.
    odd_list = F.exists(members, lambda m: ~F.coalesce(F.schema_of_variant(m).startswith("OBJECT"), F.lit(False)) | ~kind_of(m, "$.text").isin("STRING", "VOID") | ~kind_of(m, "$.content").isin("STRING", "VOID"))
    odd_body = (sections == "") & (_kind(p, "$.descriptionBodyPlain", "STRING") | _text(p, "$.descriptionBodyPlain").isNull() & _kind(p, "$.descriptionBody", "STRING"))
    optional = {n: _kind(p, f"$.{path}", "STRING") for n, path in (("location", "categories.location"), ("apply_url", "applyUrl"), ("description", "descriptionPlain"), ("additional", "additionalPlain"))}
    out = named.withColumns(
        {
            "source": F.lit("lever"), "source_job_id": _text(p, "$.id"), "title": _text(p, "$.text"), "job_url": _text(p, "$.hostedUrl"), "apply_url": _text(p, "$.applyUrl"),
            "location": _text(p, "$.categories.location"), "description": F.when(sections != "", sections).otherwise(body),
        }
    )
    wrong = _violations(payload=~F.coalesce(F.schema_of_variant(p).startswith("OBJECT"), F.lit(False)), id=F.col("source_job_id").isNull(), title=F.col("title").isNull(), job_url=~web_url(F.col("job_url")), bad_apply_url=F.col("apply_url").isNotNull() & ~web_url(F.col("apply_url")), categories=_kind(p, "$.categories", "OBJECT"), lists=_kind(p, "$.lists", "ARRAY"), list_member=odd_list, body=odd_body, **optional)
    return out.withColumn("violations", wrong).select(COLUMNS)


def greenhouse(rows: DataFrame) -> DataFrame:
    """From (source_scope, company, retrieved_at, payload_json); the id is a positive whole number."""
    p = F.col("_p")
    named = rows.withColumn("_p", F.try_parse_json("payload_json"))
    number = F.when(F.schema_of_variant(member(p, "$.id")) == "BIGINT", F.try_variant_get(p, "$.id", "bigint"))
    out = named.withColumns(
        {
            "source": F.lit("greenhouse"), "source_job_id": F.when(number > 0, number.cast("string")), "title": _text(p, "$.title"), "job_url": _text(p, "$.absolute_url"),
            "apply_url": F.lit(None).cast("string"), "location": _text(p, "$.location.name"), "description": F.coalesce(html.greenhouse_text(text_of(member(p, "$.content"))), F.lit("")),
        }
    )
    wrong = _violations(payload=~F.coalesce(F.schema_of_variant(p).startswith("OBJECT"), F.lit(False)), id=F.col("source_job_id").isNull(), title=F.col("title").isNull(), job_url=~web_url(F.col("job_url")), location=_kind(p, "$.location", "OBJECT") | _kind(p, "$.location.name", "STRING"), content=_kind(p, "$.content", "STRING"))
    return out.withColumn("violations", wrong).select(COLUMNS)


def snapshots(normal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of whole snapshots, (source, source_scope, violations) of failed ones).

    One bad posting or a repeated id fails its scope, and no other. Only the names of failed scopes are joined.
    """
    scope = ["source", "source_scope"]
    repeated = normal.groupBy(*scope, "source_job_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*scope, F.lit("repeated_id").alias("v"))
    failed = normal.select(*scope, F.explode("violations").alias("v")).unionAll(repeated).groupBy(*scope).agg(F.array_sort(F.collect_set("v")).alias("violations"))
    return normal.join(failed.select(*scope), scope, "left_anti").drop("violations"), failed
