"""Nearest neighbours by counting collisions on sorted projections, with virtual rehashing.

Vectors are scaled to length one. Each is projected on `projections` random lines, each line a sorted
array of one block of vectors. A query's window on each line is centred on its own projection. A
vector collides with the query on a line if it is in the window; a vector with `threshold` collisions
or more is verified by its cosine. Virtual rehashing widens all windows by a factor, which only adds
the new ends of the windows to the counts, until `candidates` of the block or a share of it is
verified.

Blocks. Rows are hashed to blocks of about `block` rows, queries to blocks of their own, and each pair
of blocks is one group of a cogroup: its memory is bounded whatever the input, and no rows are lost.
Both are replicated over the other's blocks, so with q query blocks the rows move q times, not once a
query. A block gives its `k` best for each query; the best of all blocks are merged by a window of
k x blocks rows a query.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, as
query or candidate, nor do vectors of another length than the query's (each length is a group of its
own); ties go to the smaller id; fewer candidates than k give what there is; ids are expected to be
unique, and rows that repeat an id are candidates each, but never for their own id; a null id takes no
part; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows and queries of a block.
BLOCK, QUERY_BLOCK = 16_384, 2_048
PROJECTIONS, THRESHOLD, FACTOR, FIRST = 128, 100, 1.05, 0.5
#: A block's candidates of a query: this many or this share of it, whichever is more.
CANDIDATES, SHARE = 200, 0.1
MARGIN = 1e-6


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


class Lines:
    """One block's projections, sorted line by line."""

    def __init__(self, unit: np.ndarray, projections: int, seed: int = 7):
        self.axes = np.random.default_rng([seed, unit.shape[1]]).standard_normal((unit.shape[1], projections))
        values = (unit @ self.axes).T
        self.order = np.argsort(values, axis=1, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(values, self.order, axis=1)

    def candidates(self, queries: np.ndarray, wanted: int, threshold: int, factor: float, first: float):
        """(query's place, places of its candidates) of each query, from its narrowest windows with so many candidates.

        Windows are `first` wide to either side, widened by the factor. A few queries start with the narrowest
        ones; the others start at these queries' median width and are widened or narrowed from there.
        """
        pilots = np.linspace(0, len(queries) - 1, min(len(queries), PILOTS)).astype(int)
        centres = (queries @ self.axes).T
        halves, at, levels = [first], 0, []
        for part in (pilots, np.setdiff1d(np.arange(len(queries)), pilots)):
            for q, found, level in self._from(part, centres, at, halves, min(wanted, self.values.shape[1]), threshold, factor):
                levels.append(level)
                yield q, found
            at = int(np.median(levels))

    def _windows(self, centres: np.ndarray, half: float):
        low = np.array([v.searchsorted(c - half) for v, c in zip(self.values, centres, strict=True)])
        return low, np.array([v.searchsorted(c + half, "right") for v, c in zip(self.values, centres, strict=True)])

    def _counts(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Collisions of one query's windows; of a window with most of a line, the rest of the line is counted."""
        n = self.values.shape[1]
        wide = 2 * (high - low) > n
        inside = [o[a:b] for o, a, b in zip(self.order[~wide], low[~wide].tolist(), high[~wide].tolist(), strict=True)]
        outside = [x for o, a, b in zip(self.order[wide], low[wide].tolist(), high[wide].tolist(), strict=True) for x in (o[:a], o[b:])]
        return (wide.sum() + _times(inside, n) - _times(outside, n)).astype(np.int16)

    def _from(self, part: np.ndarray, centres: np.ndarray, at: int, halves: list[float], enough: int, threshold: int, factor: float):
        """(query's place, its candidates, the level of its windows): all queries of the part start at one level."""
        n = self.values.shape[1]
        low, high = self._windows(centres[:, part], _half(halves, at, factor))
        counts = np.array([self._counts(low[:, k], high[:, k]) for k in range(len(part))]).reshape(len(part), n)
        have = (counts >= threshold).sum(axis=1) >= enough
        whole = (low == 0).all(axis=0) & (high == n).all(axis=0)
        for step, active in ((1, np.flatnonzero(~have & ~whole)), (-1, np.flatnonzero(have | whole))):
            level, l, h, own = at, low[:, active], high[:, active], counts[active]
            while len(active):
                if level + step < 0:  # no narrower windows
                    yield from ((int(part[k]), np.flatnonzero(c >= threshold), level) for k, c in zip(active, own, strict=True))
                    break
                new_l, new_h = self._windows(centres[:, part[active]], _half(halves, level + step, factor))
                on = np.zeros(len(active), bool)
                for k in range(len(active)):
                    (a, b), (c, d) = ((new_l, l), (h, new_h)) if step > 0 else ((l, new_l), (new_h, h))
                    ends = [o[x:y] for lo, hi in ((a[:, k], b[:, k]), (c[:, k], d[:, k])) for o, x, y in zip(self.order, lo.tolist(), hi.tolist(), strict=True) if x < y]
                    new = own[k] + (step * _times(ends, n)).astype(np.int16)
                    full = (np.count_nonzero(new >= threshold) >= enough) or ((new_l[:, k] == 0).all() and (new_h[:, k] == n).all())
                    if step > 0 and full:
                        yield int(part[active[k]]), np.flatnonzero(new >= threshold), level + 1
                    elif step < 0 and not full:
                        yield int(part[active[k]]), np.flatnonzero(own[k] >= threshold), level
                    else:
                        own[k], on[k] = new, True
                level, active, l, h, own = level + step, active[on], new_l[:, on], new_h[:, on], own[on]


#: Queries of a part that look for the width at which the others start.
PILOTS = 4


def _half(halves: list[float], level: int, factor: float) -> float:
    while len(halves) <= level:
        halves.append(halves[-1] * factor)
    return halves[level]


def _times(places: list[np.ndarray], n: int) -> np.ndarray:
    """How often each of n places is listed."""
    return np.bincount(np.concatenate(places), minlength=n) if places else np.zeros(n, np.int64)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """The vectors by powers of two, which is exact, so that squares of large and small components neither overflow nor vanish."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def nearest_in_block(queries: pd.DataFrame, rows: pd.DataFrame, k: int, options: dict, verified: list | None = None) -> pd.DataFrame:
    """The k nearest of a block for each query. verified: takes (query, number of vectors verified)."""
    out: list[tuple] = []
    if len(queries) and len(rows):
        ids, asked = rows["id"].to_numpy(), queries["id"].tolist()
        vectors = scaled(np.stack(rows["vector"].to_numpy()).astype(np.float64))
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        lines = Lines(vectors / norms[:, None], options["projections"])
        points = scaled(np.stack(queries["vector"].to_numpy()).astype(np.float64))
        lengths = np.sqrt((points * points).sum(axis=1))
        wanted = max(options["candidates"], int(options["share"] * len(ids)))
        for at in range(0, len(asked), 256):  # so that the counts take no more than 256 x block
            part = slice(at, at + 256)
            for q, found in lines.candidates(points[part] / lengths[part, None], wanted, options["threshold"], options["factor"], options["first"]):
                name, x, length = asked[at + q], points[at + q], lengths[at + q]
                if verified is not None:
                    verified.append((name, len(found)))
                found = found[ids[found] != name]
                if len(found) > k:  # a product of matrices, off by much less than the margin, finds those that can be among the k
                    rough = vectors[found] @ x / (norms[found] * length)
                    found = found[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - MARGIN]
                cosine = (vectors[found] * x).sum(axis=1) / (norms[found] * length)
                best = np.lexsort((ids[found], -cosine))[:k]
                out += zip([name] * len(best), ids[found][best].tolist(), cosine[best].tolist(), strict=True)
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK, **options) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for each query among the other rows."""
    known = {"projections": PROJECTIONS, "threshold": THRESHOLD, "factor": FACTOR, "first": FIRST, "candidates": CANDIDATES, "share": SHARE} | options
    rows = vectors.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.size(vector_col).alias("dim"))
    n, m = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-m // query_block))
    # Blocks by a hash of the id: equal vectors, or vectors of one hot source, are spread evenly.
    data = rows.select("id", "vector", "dim", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"))
    asked = rows.filter("asks").select("id", "vector", "dim", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(query_blocks)).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    found = asked.groupBy("b", "q", "dim").cogroup(data.groupBy("b", "q", "dim")).applyInPandas(lambda x, y: nearest_in_block(x, y, k, known), "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
