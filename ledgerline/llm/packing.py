"""Order-preserving packing: the best cuts of a stream of documents into sequences, by dynamic programming.

Documents follow each other in the order of ids within a partition. A cut may lie behind a document,
behind a sentence, or, where a sentence is long, behind each 64th token of it. cost(j), the least cost
of a stream that is cut at j, is the minimum over earlier cuts i, at most `length` tokens back, of

    cost(i) + padding of j - i tokens + penalty(j) + SEQUENCE.

Padding is length - (j - i), so that all but cost(i) + i depends on j alone, and the minimum over the
sliding window is the front of a monotone queue: constant amortised time for each cut. A sequence of a
power of two has no padding; those few lengths are tried apart. The penalties are in tokens: nothing
behind a document, a little behind a sentence, more elsewhere.

A partition is worked on in blocks of whole documents. All sequences of a block but the last are
final; the last goes on into the next block. So memory is bounded by a block and the longest document,
and a partition has one short sequence at most. Partitions are those of the scan: there is no shuffle
and a lost task is repeated alone. Sequence ids are partition << 40 | number in the partition.

Defined results: a sequence length under STEP narrows the gap between possible cuts to itself; a null or empty text is the end token alone; repeated rows are packed each; only id
and text are read; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.vocab import BYTE_LETTERS, Cache, vocabulary

LENGTH = 4096
#: Costs in tokens: of a sequence as such, of a cut behind a sentence, of a cut within one.
SEQUENCE, SENTENCE, WITHIN = 256.0, 16.0, 96.0
#: Longest gap between possible cuts.
STEP = 64
#: Tokens in a block.
BLOCK = 400_000

_CLOSING = b".,;:!?"
#: Letters that are composed and have one lower-case form.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_END = re.compile(r"[.!?]")


def cuts(stream: np.ndarray, ends: np.ndarray, stops: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Possible cuts of a stream, ascending, and their penalties. ends: behind documents; stops: whether an id ends a sentence."""
    n = len(stream)
    penalty = np.full(n + 1, np.inf)
    penalty[np.arange(0, n + 1, step)] = WITHIN
    penalty[np.flatnonzero(stops[np.minimum(stream, len(stops) - 1)]) + 1] = SENTENCE
    penalty[ends] = 0.0
    at = np.flatnonzero(np.isfinite(penalty))
    return at, penalty[at]


def best_cuts(at: list[int], penalty: list[float], length: int = LENGTH) -> list[int]:
    """The cuts, first and last included, of the cheapest way from at[0] to at[-1]."""
    n, places = len(at), np.asarray(at)
    cost, back = [0.0] * n, [0] * n
    exact: dict[int, list[int]] = {}  # earlier cuts that are a power of two away
    for p in [1 << k for k in range(length.bit_length()) if 1 << k < length]:
        k = np.searchsorted(places, places - p)
        for j in np.flatnonzero(places[k] == places - p).tolist():
            exact.setdefault(j, []).append(int(k[j]))
    queue: deque[int] = deque([0])  # by cost(i) + i ascending, and by place
    for j in range(1, n):
        here = at[j]
        while at[queue[0]] < here - length:
            queue.popleft()
        i = queue[0]
        least, source = cost[i] + length - (here - at[i]), i
        for k in exact.get(j, ()):
            if cost[k] < least:
                least, source = cost[k], k
        cost[j] = least + penalty[j] + SEQUENCE
        back[j] = source
        value = cost[j] + here
        while queue and cost[queue[-1]] + at[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    path, j = [n - 1], n - 1
    while j:
        j = back[j]
        path.append(j)
    return [at[j] for j in reversed(path)]


@lru_cache(maxsize=2)
def _library_ids(path: str) -> Cache:
    """Packed ids of a chunk, its words put through the tokenizers library's model."""
    vocab = vocabulary(path)
    tokenize = vocab.model.tokenize
    words = Cache(lambda word: array("I", [t.id for t in tokenize(word)]).tobytes())
    one = lambda w: array("I", [w]).tobytes() if isinstance(w, int) else words[w]

    def made(chunk: bytes) -> bytes:
        if chunk.isalpha():  # ASCII letters alone are one word
            return array("I", [t.id for t in tokenize(chunk.lower().decode())]).tobytes()
        text = chunk.decode()
        if chunk[-1] in _CLOSING and _LETTERS.fullmatch(text, 0, len(text) - 1):  # and a mark behind them is another
            return chunks[chunk[:-1]] + chunks[chunk[-1:]]
        if _LETTERS.fullmatch(text):
            return array("I", [t.id for t in tokenize(text.lower().encode().decode("latin-1").translate(BYTE_LETTERS))]).tobytes()
        return b"".join([one(w) for w in vocab.words(chunk)])

    chunks = Cache(made)
    return chunks


@lru_cache(maxsize=2)
def sentence_stops(path: str) -> np.ndarray:
    """Of each id, whether it ends a word and holds a full stop, question or exclamation mark; the last entry is of all further ids."""
    vocab = vocabulary(path)
    out = np.zeros(max(vocab.tokens) + 2, bool)
    out[[i for t, i in vocab.ids.items() if t.endswith(vocab.suffix) and _END.search(t)]] = True
    return out


def token_ids(raw: bytes | None, path: str, end_id: int) -> np.ndarray:
    raw = raw or b""
    # Case is lost anyway; but special strings have theirs, and a mark that is put on a letter may compose with one case alone.
    if b"<|" not in raw and b"\xcc" not in raw and b"\xcd" not in raw:
        raw = raw.lower()
    packed = b"".join(map(_library_ids(path).__getitem__, raw.split()))
    return np.append(np.frombuffer(packed, np.uint32), np.uint32(end_id))


class Packer:
    """Takes documents in order and gives pieces of finished sequences."""

    def __init__(self, length: int, stops: np.ndarray):
        self.length, self.stops, self.made = length, stops, 0
        self.docs: list[tuple[object, np.ndarray, int]] = []  # id, ids still to be packed, where they start in the document
        self.size = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, ids, 0))
        self.size += len(ids)

    def pieces(self, last: bool):
        """(doc_id, start, ids, doc_tokens, sequence, offset) of what is final."""
        if not self.docs:
            return
        ends = np.cumsum([len(ids) for _, ids, _ in self.docs])
        at, penalty = cuts(np.concatenate([ids for _, ids, _ in self.docs]), np.concatenate([[0], ends]), self.stops, min(STEP, self.length))
        chosen = best_cuts(at.tolist(), penalty.tolist(), self.length)
        stop = len(chosen) - 1 if last or len(chosen) == 2 and self.size >= self.length else len(chosen) - 2
        d, used, carried = 0, 0, []  # used: of the document d
        for k in range(stop):
            left, offset = chosen[k + 1] - chosen[k], 0
            while left:
                doc_id, ids, start = self.docs[d]
                take = min(left, len(ids) - used)
                yield doc_id, start + used, ids[used : used + take], start + len(ids), self.made, offset
                left, offset, used = left - take, offset + take, used + take
                if used == len(ids):
                    d, used = d + 1, 0
            self.made += 1
        for n, (doc_id, ids, start) in enumerate(self.docs[d:]):
            carried.append((doc_id, ids[used:], start + used) if n == 0 and used else (doc_id, ids, start))
        self.docs, self.size = carried, sum(len(ids) for _, ids, _ in carried)


PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, vocab_path: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """A row for each piece: its document, place in it, length, CRC-32 of its ids, sequence and offset there; ids on demand."""
    if length < 1:
        raise ValueError("length must be 1 or more")
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {PIECES}" + (", ids array<int>" if with_ids else "")
    names = [id_col, *(x.split()[0] for x in PIECES.split(", ")), *(["ids"] if with_ids else [])]

    def batches(it):
        packer, base = Packer(length, sentence_stops(vocab_path)), TaskContext.get().partitionId() << 40
        type_of = None

        def rows(last: bool):
            found = list(packer.pieces(last))
            for at in range(0, len(found), 5000):
                part = found[at : at + 5000]
                columns = [pa.array([p[0] for p in part], type_of)]
                for values in ([p[1] for p in part], [len(p[2]) for p in part], [zlib.crc32(p[2].tobytes()) for p in part], [p[3] for p in part], [base | p[4] for p in part], [p[5] for p in part]):
                    columns.append(pa.array(values, pa.int64()))
                if with_ids:
                    columns.append(pa.array([p[2].view(np.int32) for p in part], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

        for batch in it:
            type_of = batch.column(0).type
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(i, token_ids(x.as_py(), vocab_path, end_id))
                if packer.size >= BLOCK:
                    yield from rows(False)
        yield from rows(True)

    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("_raw")).sortWithinPartitions(id_col).mapInArrow(batches, schema)
