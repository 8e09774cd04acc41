"""From raw documents to packed sequences: five stages, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents (doc_id, text,
lang, source, n_chars); the last returns a row for each piece of a sequence. Other input columns,
whatever their names, are left behind by the first stage. Null texts count as empty; an empty table
passes all stages as an empty table; nulls in lang, source and n_chars pass unchanged.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import neardup, packing, quality, substring, toxicity
from ledgerline.llm.entry import WORD_BPE, held_out, table
from ledgerline.llm.scratch import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC = 0.3


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold the threshold table's rules, each row judged alone; null and empty texts have under 50 words and go."""
    return quality.keep(docs.select(COLUMNS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; labels are learnt from outside the held-out quarter.

    Rows with a null id are scored but not learnt from; repeated rows score alike; null and empty texts get
    the bias's score; without labelled rows every score is 0.5 and all documents go.
    """
    weights = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))))
    carried = ["text", "lang", "source", "n_chars"]
    return toxicity.score(docs, weights, carry=carried).filter(F.col("score") < TOXIC).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates: five-word shingles, similarity 0.8.

    Rows with a null id stay; rows that repeat an id are one document and stay or go together; texts
    without words are in no group and stay.
    """
    found = neardup.near_duplicates(docs, percent=80)
    return docs.join(found.filter("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; what is left keeps its lines and spaces.

    Rows with a null id, null texts and texts without such a passage are unchanged, n_chars included.
    """
    found = substring.dedup(docs, carry=["text", "lang", "source", "n_chars"], layout=True)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    chars = F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", text.alias("text"), "lang", "source", chars.alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens; each row is a document of its own, null and empty texts one end token."""
    return packing.pack(docs, public_tokenizers.path(WORD_BPE))


STAGES = [
    ("quality", quality_rules),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("packing", pack),
]

#: Hashed features, minhashes and dynamic programming are not SQL; tests/llm hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table is dropped once the next one's is complete."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for before, (name, stage) in zip([None, *(n for n, _ in STAGES)], STAGES, strict=False):
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
    return docs
