"""A registry of companies from JSON: an array of {site, company}; entries that are not right are issues, not errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.operators.metadata import member, text_of
from ledgerline.operators.normalise import blank_to_null


def registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(companies: position, site, company; issues: position, site, message). The first entry of a site counts."""
    files = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    root = F.schema_of_variant("v").startswith("ARRAY")
    checked = files.select(F.when(F.coalesce(root, F.lit(False)), F.try_variant_get("v", "$", "array<variant>")).otherwise(F.raise_error(F.lit("a registry is a JSON array")).cast("array<variant>")).alias("v"))
    entries = checked.select(F.posexplode("v").alias("position", "e"))
    named = entries.select("position", blank_to_null(text_of(member(F.col("e"), "$.site"))).alias("site"), blank_to_null(text_of(member(F.col("e"), "$.company"))).alias("company"), (~F.coalesce(F.schema_of_variant("e").startswith("OBJECT"), F.lit(False))).alias("odd"))
    whole = F.col("site").isNotNull() & F.col("company").isNotNull()
    # Entries that lack something do not take their site's place.
    place = F.row_number().over(Window.partitionBy("site", whole).orderBy("position"))
    judged = named.withColumn("message", F.when(F.col("odd"), "not an object").when(F.col("site").isNull(), "no site").when(F.col("company").isNull(), "no company").when(place > 1, "repeated site"))
    return judged.filter("message is null").select("position", "site", "company"), judged.filter("message is not null").select("position", "site", "message")
