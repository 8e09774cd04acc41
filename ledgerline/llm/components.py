"""Connected components by alternating large and small stars; every step is a join or an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.scratch import Scratch


def components(links: DataFrame, scratch: Scratch, name: str, *, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of (a, b) links, the component being its smallest node.

    A star's centre is found by a minimum with map-side combining and joined back, so that a node with
    very many links is never one group in one task. Each round is written; rounds grow with the
    logarithm of the longest path.
    """

    def large(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b")

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.col("b").alias("n"), F.col("a").alias("v"))  # v < n
        least = down.groupBy("n").agg(F.min("v").alias("m"))
        return down.join(least, "n").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b").unionAll(least.select(F.col("m").alias("a"), F.col("n").alias("b")))

    edges = scratch.keep(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), f"{name}-0")
    print_of = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()  # noqa: E731  of the whole set, two numbers
    before = print_of(edges)
    for k in range(1, most_rounds + 1):
        edges = scratch.keep(small(large(edges).distinct()).distinct(), f"{name}-{k}")
        now = print_of(edges)
        if k > 1:
            scratch.drop(f"{name}-{k - 2}")
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
