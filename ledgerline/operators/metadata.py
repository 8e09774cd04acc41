"""Employment, workplace and publication date from providers' payloads, and filling them in where they are missing.

Only exact aliases count. A custom field counts by its name; the recognised values of all fields must be one.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import casefold, collapse, let

# Aliases without spaces, hyphens and underscores, and names of custom fields.
EMPLOYMENT = {
    "fulltime": "full_time", "fulltimeemployment": "full_time", "fulltimeemployee": "full_time", "fulltimeexperienced": "full_time", "regularfulltime": "full_time",
    "clinicalfulltime": "full_time", "fulltimehybrid": "full_time", "fulltimeonsite": "full_time", "parttime": "part_time", "clinicalparttime": "part_time",
    "intern": "internship", "internship": "internship", "contract": "contract", "contractor": "contract", "contractfulltime": "contract", "fixedtermcontract": "contract",
    "temporary": "temporary", "seasonal": "temporary", "fixedterm": "temporary", "other": "other", "unknown": "unknown", "unspecified": "unknown",
}
WORKPLACE = {"remote": "remote", "fullyremote": "remote", "hybrid": "hybrid", "partiallyremotehybrid": "hybrid", "onsite": "onsite", "fullyonsite": "onsite", "inoffice": "onsite", "unknown": "unknown", "unspecified": "unknown"}
EMPLOYMENT_FIELDS = ("employment type", "employmentstatus", "employment status", "employee time type", "time type", "full or part time", "full time/part time", "full-time/ part-time", "th: employment type", "adp employment type")
FIELDS = ("employment_type", "workplace_type", "posted_at")
#: Publication dates from 2000 to 2100, in milliseconds.
MILLIS = (946_684_800_000, 4_102_444_800_000)


def alias(value: Column, table: Mapping[str, str]) -> Column:
    """The class of a value by exact alias, or null."""
    if not table:
        return F.lit(None).cast("string")
    token = F.regexp_replace(casefold(F.trim(value)), r"(?U)[\s\x1c-\x1f_-]+", "")
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[token]


def member(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def text_of(value: Column) -> Column:
    """The string that a variant is; null if it is anything else."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _in_range(date: Column, observed: Column) -> Column:
    return F.when((date >= F.expr("TIMESTAMP '2000-01-01 00:00:00Z'")) & (date <= observed + F.expr("INTERVAL 1 DAY")), date)


def date_of_millis(value: Column, observed: Column) -> Column:
    """The time of a number of milliseconds, from 2000 to a day after the observation."""
    number = F.when(F.schema_of_variant(value).rlike("^(BIGINT|INT|DOUBLE|DECIMAL)"), F.try_variant_get(value, "$", "double"))
    return _in_range(F.when((number >= MILLIS[0]) & (number < MILLIS[1]), F.timestamp_millis(number.cast("bigint"))), observed)


def date_of_text(value: Column, observed: Column) -> Column:
    """The time of an ISO text, which must name its offset."""
    return _in_range(F.when(value.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(value)), observed)


def consensus(fields: Column, names: tuple[str, ...], table: Mapping[str, str], more: Mapping[str, Mapping[str, str]], *, lists: bool = False) -> Column:
    """The one class that the custom fields (array of variant) give; null without any or with several.

    more: aliases of further or the same fields, by name. With lists, a list must be of one recognised class, or nothing counts.
    """
    known = [*names, *(n for n in more if n not in names)]

    def of(field: Column) -> Column:
        name = casefold(collapse(text_of(member(field, "$.name"))))
        value = member(field, "$.value")

        def scalar(x: Column) -> Column:
            text = text_of(x)
            general = F.when(name.isin(*names), alias(text, table)) if names else F.lit(None).cast("string")
            return F.coalesce(general, *[F.when(name == n, alias(text, t)) for n, t in more.items()])

        members = F.transform(F.try_variant_get(value, "$", "array<variant>"), scalar)
        mixed = F.exists(members, lambda x: x.isNull()) | (F.size(F.array_distinct(members)) != 1)
        is_list = F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False)) if lists else F.lit(False)
        counts = F.coalesce(name.isin(*known), F.lit(False)) if known else F.lit(False)
        void = counts & is_list & (F.size(members) > 0) & mixed
        found = F.when(counts & is_list, F.get(members, F.lit(0))).when(counts, scalar(value))
        return F.struct(found.alias("found"), F.coalesce(void, F.lit(False)).alias("void"))

    def agreed(all_of: Column) -> Column:
        values = F.array_distinct(F.array_compact(F.transform(all_of, lambda x: x["found"])))
        return F.when(~F.exists(all_of, lambda x: x["void"]) & (F.size(values) == 1), F.get(values, F.lit(0)))

    return let(F.transform(fields, of), agreed)


def extract(rows: DataFrame, *, lever_aliases: Mapping[str, str] | None = None, employment_fields: Mapping[str, Mapping[str, str]] | None = None, workplace_fields: Mapping[str, Mapping[str, str]] | None = None, workplace_names: tuple[str, ...] = ("workplace type",)) -> DataFrame:
    """The rows (source, payload_json, retrieved_at) with found_employment_type, found_workplace_type, found_posted_at and invalid_payload.

    Aliases that are special to a provider or a custom field are parameters. Unknown sources give nulls; a
    payload that is no JSON object is invalid.
    """
    p = F.try_parse_json("payload_json")
    valid = F.coalesce(F.schema_of_variant(p).startswith("OBJECT"), F.lit(False))
    commitment = text_of(member(p, "$.categories.commitment"))
    custom = F.try_variant_get(p, "$.metadata", "array<variant>")
    lever, greenhouse = F.col("source") == "lever", F.col("source") == "greenhouse"
    return rows.withColumns(
        {
            "invalid_payload": ~valid,
            "found_employment_type": F.when(valid & lever, F.coalesce(alias(commitment, EMPLOYMENT), alias(commitment, lever_aliases or {}))).when(valid & greenhouse, consensus(custom, EMPLOYMENT_FIELDS, EMPLOYMENT, employment_fields or {})),
            "found_workplace_type": F.when(valid & lever, alias(text_of(member(p, "$.workplaceType")), WORKPLACE)).when(valid & greenhouse, consensus(custom, workplace_names, WORKPLACE, workplace_fields or {}, lists=True)),
            "found_posted_at": F.when(valid & lever, date_of_millis(member(p, "$.createdAt"), F.col("retrieved_at"))).when(valid & greenhouse, date_of_text(text_of(member(p, "$.first_published")), F.col("retrieved_at"))),
        }
    )


def backfill(extracted: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The rows with nulls of the chosen fields filled from what was found; values that are there stay."""
    if not fields or set(fields) - set(FIELDS):
        raise ValueError(f"fields are some of {FIELDS}")
    return extracted.withColumns({f: F.coalesce(F.col(f), F.col(f"found_{f}")) for f in fields})


def disagreements(extracted: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Rows of which a value would be found differently; a strict backfill requires none."""
    differs = F.lit(False)
    for f in fields:
        differs = differs | (F.col(f).isNotNull() & ~F.col(f).eqNullSafe(F.col(f"found_{f}")))
    return extracted.filter(F.col("invalid_payload") | differs)


def backfill_counters(extracted: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """For each source: total, invalid_payload, and for each field how many are enriched, populated and missing."""
    ok, out = ~F.col("invalid_payload"), []
    for f in fields:
        old, new = F.col(f).isNotNull(), F.col(f"found_{f}").isNotNull()
        out += [F.count_if(ok & ~old & new).alias(f"{f}_enriched"), F.count_if(ok & (old | new)).alias(f"{f}_populated"), F.count_if(ok & ~old & ~new).alias(f"{f}_missing")]
    return extracted.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count_if("invalid_payload").alias("invalid_payload"), *out)


