"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are emitted.

A word begins as its symbols in a doubly linked list. A heap holds the mergeable neighbours; the
lowest rank, leftmost first, is popped and merged until none is left. The count is the number of
initial symbols less the number of merges.

Defined results: a null or empty text has 0 tokens and 0 bytes; every row gives one row, repeated
rows included; other input columns are not carried, so their names cannot clash; an empty table
gives an empty table. Texts of any length are counted whole.
"""

from __future__ import annotations

from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.vocab import Cache, vocabulary


def merged_count(symbols: list[int], pairs: dict[int, int]) -> int:
    """Tokens left of a word's symbols, which are used up, when no pair can be merged any more."""
    n = len(symbols)
    if n == 1:
        return 1
    heap = []
    for i in range(n - 1):
        found = pairs.get(symbols[i] << 16 | symbols[i + 1])
        if found is not None:
            heap.append((found >> 16) << 32 | i)
    if not heap:
        return n
    heapify(heap)
    here, after, before, merges = symbols, list(range(1, n + 1)), list(range(-1, n - 1)), 0
    while heap:
        top = heappop(heap)
        i = top & 0xFFFFFFFF
        j = after[i]
        if here[i] < 0 or j >= n:
            continue
        found = pairs.get(here[i] << 16 | here[j])
        if found is None or found >> 16 != top >> 32:
            continue  # one of the two has been merged since
        merges += 1
        here[i], here[j] = found & 0xFFFF, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            found = pairs.get(here[i] << 16 | here[k])
            if found is not None:
                heappush(heap, (found >> 16) << 32 | i)
        k = before[i]
        if k >= 0:
            found = pairs.get(here[k] << 16 | here[i])
            if found is not None:
                heappush(heap, (found >> 16) << 32 | k)
    return n - merges


@lru_cache(maxsize=2)
def _counts(path: str) -> Cache:
    vocab = vocabulary(path)
    words = Cache(lambda word: merged_count(vocab.symbols(word), vocab.pairs))
    return Cache(lambda chunk: sum([1 if isinstance(w, int) else words[w] for w in vocab.words(chunk)]))


def count_tokens(text: str | bytes | None, path: str) -> int:
    raw = text.encode() if isinstance(text, str) else text or b""
    return sum(map(_counts(path).__getitem__, raw.split()))


def token_counts(docs: DataFrame, vocab_path: str, *, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, n_bytes, n_tokens and over_limit (more tokens than `limit`) of each text. No shuffle."""
    keep = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("_raw"))
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_tokens bigint"

    def batches(it):
        get = _counts(vocab_path).__getitem__
        for batch in it:
            sizes, counts = [], []
            for x in batch.column(1):
                raw = x.as_py() or b""
                sizes.append(len(raw))
                counts.append(sum(map(get, raw.split())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    return keep.mapInArrow(batches, schema).withColumn("over_limit", F.col("n_tokens") > limit)
