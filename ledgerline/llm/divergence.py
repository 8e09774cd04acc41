"""How far the sources of a language differ in their use of words, from an inverted index of baseline corrections.

A language keeps the V terms of at least `min_docs` of its documents. A group (language, source) gives a
kept term with count c the scaled share p = 1 + floor(scale * (c + pseudo) / (N + pseudo * V)), N being the
group's count of all kept terms; z is the share of count 0. The distance of two groups is the sum of
abs(p - q) over the kept terms. Most counts are 0, so that each pair starts at its baseline, V * abs(z - y)
with the other group's y, and the index emits what is not 0 beside it:

    a term that only one group has     abs(p - y) - abs(z - y)
    a term that both have, besides     abs(p - q) - abs(p - y) - abs(z - q) + abs(z - y)

The first kind depends on p alone, so that a group's equal shares are one row with a multiplicity. The second
comes from postings of one term, and rows are summed before they are shuffled. What is typical of a group are
the terms with a share above the language's, ranked in a window that Spark limits before the shuffle.

Work: one pass over the texts in Arrow batches, whose counters are emptied at ENTRIES terms or BYTES of text;
after that only counts of (language, source, term) move. Pairs of groups are the result itself; a
language's groups meet in SALTS parts.

Defined results: nulls in text, language and source are ''; each row is a document, repeated rows too; a
group without terms is a group like the others; a language without kept terms gives pairs of value 0 and no
terms; ties are ranked by the item's UTF-8; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.scratch import Scratch

#: Terms and bytes of text that a task counts before it hands counts on.
ENTRIES, BYTES = 300_000, 64 << 20
#: Parts in which the groups of one language are paired.
SALTS = 16

#: Terms are runs of letters A to Z, in lower case, and of bytes of characters beyond ASCII.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(_TERMS).split()


def term_counts(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """(lang, source, term, n, docs), summed; a row with a null term marks each group."""
    empty = F.lit("")
    read = docs.select(*(F.coalesce(F.col(c).cast("string"), empty) for c in (lang, source)), F.col(text).cast("binary"))

    def batches(it):
        groups: dict[tuple, tuple[Counter, Counter]] = {}
        held = entries = 0

        def out():
            for (a, b), (n, d) in groups.items():
                for at in range(0, len(n) + 1, 50_000):
                    words = [None, *n][at : at + 50_000]
                    columns = [pa.array([x] * len(words), pa.string()) for x in (a, b)]
                    columns.append(pa.array(words, pa.binary()).cast(pa.string()))
                    columns += [pa.array([x.get(w, 0) for w in words], pa.int64()) for x in (n, d)]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

        for batch in it:
            for key, x in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(2), strict=True):
                raw = x.as_py()
                words = terms(raw)
                if key not in groups:
                    groups[key] = Counter(), Counter()
                n, d = groups[key]
                entries -= len(n)
                n.update(words)
                d.update(set(words))
                entries += len(n)
                held += len(raw or b"")
                if held >= BYTES or entries >= ENTRIES:
                    yield from out()
                    groups, held, entries = {}, 0, 0
        yield from out()

    found = read.mapInArrow(batches, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, size: Column, v: Column, pseudo: int, scale: int) -> Column:
    """1 + floor(scale * (n + pseudo) / (size + pseudo * v)), exact; null where nothing is kept."""
    whole = lambda c: c.cast("decimal(19,0)")
    product = whole(n + pseudo) * F.lit(scale).cast("decimal(10,0)")
    return F.when(v > 0, 1 + F.call_function("div", product, whole(size + pseudo * v)))


def _met(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Rows of one language, each left row in one of SALTS parts and each right row in all of them."""
    a = left.withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(SALTS)).cast("int")).alias("a")
    b = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).alias("b")
    return a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.salt") == F.col("b.salt")) & on)


def divergence(docs: DataFrame, *, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = 30, top: int = 50, pseudo: int = 5, scale: int = 1_000_000_000) -> DataFrame:
    """(lang, source, part, item, value, rank): all other sources of the language by distance, and the `top` typical terms."""
    scratch = Scratch(docs.sparkSession, "divergence")
    found = scratch.keep(term_counts(docs, lang, source, text), "found")
    marks = found.filter("term is null").select("lang", "source")
    frequent = found.filter("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("d"), F.sum("n").alias("all_n")).filter(F.col("d") >= min_docs).drop("d")
    kept = scratch.keep(found.drop("docs").join(frequent, ["lang", "term"]), "kept")
    langs = frequent.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all_n").alias("all_size"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    zero = F.lit(0).cast("long")
    groups = marks.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["size", "v", "all_size"])
    groups = scratch.keep(groups.withColumn("z", share(zero, F.col("size"), F.col("v"), pseudo, scale)), "groups")
    with_share = kept.join(groups, ["lang", "source"]).select(
        "lang", "term", "source", "z",
        share(F.col("n"), F.col("size"), F.col("v"), pseudo, scale).alias("p"),
        share(F.col("all_n"), F.col("all_size"), F.col("v"), pseudo, scale).alias("q"),
    )
    postings = scratch.keep(with_share, "postings")
    scratch.drop("found", "kept")

    gap = lambda x, y: F.abs(F.col(x) - F.col(y))
    pair = [F.col("a.lang").alias("lang"), F.least("a.source", "b.source").alias("one"), F.greatest("a.source", "b.source").alias("other")]
    baseline = _met(groups, groups, F.col("a.source") < F.col("b.source")).select(*pair, F.coalesce(F.col("a.v") * gap("a.z", "b.z"), zero).alias("value"))
    equal = postings.groupBy("lang", "source", "z", "p").agg(F.count(F.lit(1)).alias("m"))
    single = _met(equal, groups, F.col("a.source") != F.col("b.source")).select(*pair, (F.col("m") * (gap("a.p", "b.z") - gap("a.z", "b.z"))).alias("value"))
    same_term = (F.col("a.lang") == F.col("b.lang")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.source") < F.col("b.source"))
    both = postings.alias("a").join(postings.alias("b"), same_term).select(*pair, (gap("a.p", "b.p") - gap("a.p", "b.z") - gap("a.z", "b.p") + gap("a.z", "b.z")).alias("value"))
    # The baseline stays even where it is 0; of corrections only the others count.
    parts = [baseline, *(x.filter("value <> 0").groupBy("lang", "one", "other").agg(F.sum("value").alias("value")) for x in (single, both))]
    distance = reduce(DataFrame.unionAll, parts).groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))
    ways = F.array(*(F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in (("one", "other"), ("other", "one"))))
    pairs = distance.select("lang", F.explode(ways).alias("w"), "value").select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")
    typical = postings.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item")))
    return pairs.withColumn("rank", place).unionAll(typical.withColumn("rank", place).filter(F.col("rank") <= top))
