"""Toxicity by FTRL-proximal logistic regression on hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs with one word between, lower-case and without
punctuation, hashed to 2**20 places; each is there or not. FTRL-proximal keeps for every place a sum
z and a squared sum n of gradients, so that each has a learning rate of its own, and L1 leaves all
but a few weights at 0. What is broadcast are these few, (place, weight), at most 2**20 of them.

Fitting takes a bounded sample: of the labelled rows those `sample` ones at most (20,000) with the
least hash of their id, in that order; features are made on all executors, the steps over the sample
in one task. Scoring is one pass over whole texts, without a shuffle.

Defined results: null and empty texts have no features and get the bias's score; unlabelled rows,
null labels and labels without a document are not learnt from; repeated rows count as often as they
occur; without labelled rows all scores are 0.5; only id and text are read; an empty table gives an
empty table.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import words as W

BITS = 20
BIAS = 1 << BITS
SAMPLE, EPOCHS = 20_000, 4
#: Rate, smoothing, L1 and L2 of FTRL-proximal.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 1.0

_WORD = re.compile(rb"[a-z0-9'\x80-\xff]+")


def features(raw: bytes | None) -> np.ndarray:
    """The sorted distinct places of a text's words, pairs and skip-pairs."""
    h = W.hashes(_WORD.findall((raw or b"").lower()))
    skip = W.runs(np.stack([h[:-2], h[2:]], 1).ravel(), 2, 3)[::2] if len(h) > 2 else h[:0]
    return np.unique(np.concatenate([h, W.runs(h, 2, 2), skip]) >> np.uint64(64 - BITS)).astype(np.int32)


def fit(samples: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights that are not 0."""
    z, n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)
    bias = np.array([BIAS], np.int32)

    def weights(at: np.ndarray, l1: np.ndarray | float) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    l1 = np.full(BIAS + 1, L1)
    l1[BIAS] = 0.0
    for _ in range(epochs):
        for found, label in samples:
            at = np.concatenate([found, bias])
            w = weights(at, l1[at])
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    every = np.arange(BIAS + 1)
    w = weights(every, l1)
    kept = np.flatnonzero(w)
    return kept, w[kept]


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, epochs: int = EPOCHS) -> dict[int, float]:
    """Weights by place, from at most `sample` labelled rows."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1) and _id is not null").withColumn("_order", F.xxhash64("_id"))
    chosen = known.orderBy("_order", "_id", "label").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_raw")).join(F.broadcast(chosen), "_id").select("_order", "_raw", "label")

    def made(it):
        for batch in it:
            found = [features(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32())), batch.column(2)], names=["_order", "places", "label"])

    def fitted(part: pa.Table) -> pa.Table:
        part = part.sort_by([("_order", "ascending"), ("label", "ascending")])
        samples = [(p.values.to_numpy(zero_copy_only=False), y) for p, y in zip(part.column("places").combine_chunks(), part.column("label").to_pylist(), strict=True)]
        at, w = fit(samples, epochs)
        return pa.table({"place": pa.array(at, pa.int32()), "weight": pa.array(w, pa.float64())})

    placed = rows.mapInArrow(made, "_order bigint, places array<int>, label int")
    got = placed.groupBy(F.lit(0).alias("all")).applyInArrow(fitted, "place int, weight double").toPandas()
    return dict(zip(got["place"].tolist(), got["weight"].tolist(), strict=True))


def score(docs: DataFrame, weights: dict[int, float], *, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Id, the carried columns and `score`, from 0 to 1, of each text."""
    at = np.array(sorted(weights), np.int32)
    sent = docs.sparkSession.sparkContext.broadcast((at, np.array([weights[i] for i in at.tolist()])))
    kept = [id_col, *carry]

    def batches(it):
        at, w = sent.value
        dense = np.zeros(BIAS + 1)
        dense[at] = w
        for batch in it:
            sums = [dense[BIAS] + dense[features(x.as_py())].sum() for x in batch.column(len(kept))]
            scores = pa.array(1.0 / (1.0 + np.exp(-np.clip(np.array(sums, float), -35, 35))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], scores], names=[*kept, "score"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "score double"])
    return docs.select(*(F.col(f"`{c}`") for c in kept), F.col(text_col).cast("binary").alias("_raw")).mapInArrow(batches, schema)
