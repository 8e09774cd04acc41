"""Incremental substring dedup with a log-structured fingerprint index.

A fingerprint of a 13-word window is the least hash of its nine 5-word runs. Equal windows have equal
fingerprints, and neighbouring windows mostly share one, so a text has about a fifth as many distinct
fingerprints as windows. The index is a series of immutable runs, each of two tables:

- prints (fp, first, last): a fingerprint with its least and greatest document, in sorted buckets;
- windows (hi, lo, first): digests of the windows whose fingerprint has had two documents or more.

A batch is handled as follows.

1. Compaction: while a level has `fanout` runs, they are merged into one run of the next level. Prints
   are merged bucket by bucket without a shuffle.
2. The batch's fingerprints are written as a new run of prints, one row each, made with map-side
   combining, so that a passage of a third of all documents is one row.
3. The new run is merge-joined with the historical ones on sorted buckets. What is left are the
   fingerprints that the batch shares with another document.
4. Verification: each window of the batch under such a fingerprint is given a 128-bit digest of the
   text of its 13 words. A historical fingerprint that had one document only is opened: that document
   is read again for its windows; those of other historical fingerprints are in the runs. A window
   whose words also start in an earlier document (less id; all of history is earlier) is removed.

Batches come in the order of ids: the query cuts the table at quantiles of doc_id. Rows of a hot
passage meet only in plain joins, which AQE splits; documents are only grouped by their own id.

Defined results: a null or empty text has no words, nothing removed and an empty rest; texts under
13 words keep all; rows with one id repeated are one document each, whatever their texts, and not earlier than each other;
a null id is left alone; only id, text and carried columns are read, and a carried column named as a result gives way to it;
an empty table gives an empty table.
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import words as W
from ledgerline.llm.scratch import Scratch

WINDOW, GRAM = 13, 5
#: Batches that a whole table is taken in; from the third on, the index compacts.
BATCHES = 3
#: Marks of a window: in the batch, or of documents opened for it; in an earlier run.
OWN, KNOWN = 1, 2


class Block(W.Spaced):
    """The words of several texts in a row, and which 13-word windows lie in one text."""

    def __init__(self, texts: list[bytes | None]):
        super().__init__(texts)
        h = W.hashes_at(self.bytes, self.starts)
        n = max(len(h) - WINDOW + 1, 0)
        last = np.repeat(self.first + self.sizes, self.sizes)[:n]
        #: Places of windows, and the text that each is in.
        self.at = np.flatnonzero(np.arange(n) + WINDOW <= last)
        self.owner = np.repeat(np.arange(len(texts)), self.sizes)[self.at]
        self.grams = W.runs(h, GRAM)

    def fingerprints(self) -> np.ndarray:
        """The fingerprint of each window."""
        out = self.grams[self.at]
        for j in range(1, WINDOW - GRAM + 1):
            np.minimum(out, self.grams[self.at + j], out=out)
        return out

    def digests(self, chosen: np.ndarray) -> np.ndarray:
        """128 bits of the text of each chosen window, as two columns of longs."""
        text, at = self.bytes.tobytes(), self.at[chosen]
        digest = xxhash.xxh3_128_digest
        raw = b"".join(map(digest, map(text.__getitem__, map(slice, self.starts[at].tolist(), self.ends[at + WINDOW - 1].tolist()))))
        return np.frombuffer(raw, np.int64).reshape(-1, 2)


def _blocks(batch: pa.RecordBatch, rows: int = 256, size: int = 1 << 20):
    """Slices of so many rows, or of about so many bytes of text (the second column) if that is less."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
        end = min(max(end, at + 1), at + rows)
        yield batch.slice(at, end - at)
        at = end


def covered(n_words: int, starts: np.ndarray) -> np.ndarray:
    """Which words lie in a window that begins at one of the starts."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + WINDOW, n_words), -1)
    return np.cumsum(edge[:-1]) > 0


def _heads(fp: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which windows begin a stretch with one fingerprint in one text; there is a window at least."""
    return np.concatenate([[True], (fp[1:] != fp[:-1]) | (owner[1:] != owner[:-1])])


def _fingerprint_rows(docs: DataFrame) -> DataFrame:
    """(fp, doc_id), once for each stretch of windows with one fingerprint."""

    def batches(it):
        for batch in it:
            for part in _blocks(batch):
                block = Block(part.column(1).to_pylist())
                fp = block.fingerprints()
                if len(fp):
                    new = _heads(fp, block.owner)
                    yield pa.RecordBatch.from_arrays([pa.array(fp[new].view(np.int64)), part.column(0).take(pa.array(block.owner[new]))], names=["fp", "doc_id"])

    return docs.filter("doc_id is not null").mapInArrow(batches, "fp bigint, doc_id bigint")


def _window_rows(docs: DataFrame) -> DataFrame:
    """(hi, lo, doc_id, text_hash, at): windows whose fingerprint is in the document's `shared`.

    docs: doc_id, raw, shared and text_hash, in this order. Without a text_hash the places are not asked for.
    """

    def batches(it):
        for batch in it:
            for part in _blocks(batch):
                block = Block(part.column(1).to_pylist())
                shared = part.column(2)
                owners = np.repeat(np.arange(part.num_rows), pc.list_value_length(shared).to_numpy(zero_copy_only=False))
                fp = block.fingerprints()
                if not len(fp) or not len(owners):
                    continue
                # Neighbouring windows mostly share a fingerprint, which is looked up once.
                heads = np.flatnonzero(_heads(fp, block.owner))
                salt = np.uint64(0x9E3779B97F4A7C15)
                wanted = np.sort(W.mix(shared.flatten().to_numpy(zero_copy_only=False).view(np.uint64) + owners.astype(np.uint64) * salt))
                asked = W.mix(fp[heads] + block.owner[heads].astype(np.uint64) * salt)
                met = wanted[np.minimum(np.searchsorted(wanted, asked), len(wanted) - 1)] == asked
                hit = np.flatnonzero(np.repeat(met, np.diff(np.append(heads, len(fp)))))
                if len(hit):
                    digests, owner = block.digests(hit), pa.array(block.owner[hit])
                    at = (block.at[hit] - block.first[block.owner[hit]]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(digests[:, 0]), pa.array(digests[:, 1]), part.column(0).take(owner), part.column(3).take(owner), pa.array(at)], names=["hi", "lo", "doc_id", "text_hash", "at"])

    return docs.mapInArrow(batches, "hi bigint, lo bigint, doc_id bigint, text_hash bigint, at int")


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def without(raw: bytes, cut: list[bool]) -> bytes:
    """The text without the words that are cut and the white space behind each; all else stays as it is."""
    starts = [m.start() for m in _WORD.finditer(raw)]
    ends = [*starts[1:], len(raw)]
    return raw[: starts[0]] + b"".join([raw[a:b] for a, b, c in zip(starts, ends, cut, strict=True) if not c]) if starts else raw


def _kept_words(texts: list[bytes | None], starts: list[np.ndarray | None]):
    """(numbers of words, numbers of words removed, the kept words joined by a space) of texts with the starts of their removed windows."""
    block = W.Spaced(texts)
    keep = np.ones(len(block.starts), bool)
    for first, n, own in zip(block.first.tolist(), block.sizes.tolist(), starts, strict=True):
        if own is not None and n:
            keep[first : first + n] = ~covered(n, own)
    edges = np.concatenate([[0], np.cumsum(keep)])
    kept = edges[block.first + block.sizes] - edges[block.first]
    widths = block.ends - block.starts + 1
    rest = np.repeat(keep, widths)
    last = np.flatnonzero(keep)[edges[block.first + block.sizes][kept > 0] - 1]
    rest[block.ends[last]] = False  # no space behind a text's last word
    bounds = np.concatenate([[0], np.cumsum(rest)])[np.append(block.starts, len(rest))][np.append(block.first, len(keep))]
    text = pa.StringArray.from_buffers(len(texts), pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(block.bytes[rest].tobytes()))
    return pa.array(block.sizes), pa.array(block.sizes - kept), text


def _cut_rows(docs: DataFrame, carry: list[str], layout: bool) -> DataFrame:
    """doc_id, the carried columns, n_words, n_removed and kept_text: the kept words joined by a space, or, with layout, as they stand in the text.

    docs: doc_id, raw, starts and the carried columns, in this order.
    """

    def batches(it):
        for batch in it:
            for part in _blocks(batch):
                if not layout:
                    places = [x.values.to_numpy(zero_copy_only=False).astype(np.int64) if x.is_valid else None for x in part.column(2)]
                    yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[3:], *_kept_words(part.column(1).to_pylist(), places)], names=["doc_id", *carry, "n_words", "n_removed", "kept_text"])
                    continue
                n, gone, kept = [], [], []
                for x, starts in zip(part.column(1), part.column(2), strict=True):
                    raw = x.as_py() or b""
                    words = W.split(raw)
                    n.append(len(words))
                    cut = covered(len(words), starts.values.to_numpy(zero_copy_only=False).astype(np.int64)).tolist() if starts.is_valid else [False] * len(words)
                    gone.append(sum(cut))
                    kept.append((without(raw, cut) if gone[-1] else raw).decode("utf-8"))
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[3:], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", *carry, "n_words", "n_removed", "kept_text"])

    carried = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]
    return docs.mapInArrow(batches, ", ".join(["doc_id bigint", *carried, "n_words bigint", "n_removed bigint", "kept_text string"]))


@dataclass
class Run:
    """A run of the index; its tables are named by its number and never changed."""

    level: int
    number: int
    prints: DataFrame
    windows: DataFrame


class FingerprintIndex:
    """Runs are tables below a shared folder."""

    def __init__(self, spark: SparkSession, *, fanout: int = 2):
        if fanout < 2:
            raise ValueError("fanout must be 2 or more")
        self.scratch, self.fanout, self.written = Scratch(spark, "fingerprints"), fanout, 0
        self.runs: list[Run] = []

    def _prints(self, rows: DataFrame, number: int) -> DataFrame:
        return self.scratch.keep_sorted(rows, f"prints-{number}", "fp", plain=["fp"])

    def compact(self) -> None:
        """Merges the runs of a level that is full; the merged runs are dropped once their successor is complete."""
        while full := [level for level, n in Counter(r.level for r in self.runs).items() if n >= self.fanout]:
            old = [r for r in self.runs if r.level == full[0]]
            merged = old[0].prints
            for r in old[1:]:
                merged = merged.join(r.prints.select("fp", F.col("first").alias("a"), F.col("last").alias("b")), "fp", "full_outer").select("fp", F.least("first", "a").alias("first"), F.greatest("last", "b").alias("last"))
            self.written += 1
            prints = self._prints(merged, self.written)
            windows = self.scratch.keep(reduce(DataFrame.unionAll, [r.windows for r in old]), f"windows-{self.written}", plain=["hi", "lo"])  # runs have no window in common
            self.runs = [r for r in self.runs if r.level != full[0]] + [Run(full[0] + 1, self.written, prints, windows)]
            for r in old:
                self.scratch.drop(f"prints-{r.number}", f"windows-{r.number}")

    def _met(self, new: DataFrame) -> DataFrame:
        """(fp, opened): the new run's fingerprints that two documents or more have. `opened` is the one historical document of a fingerprint that had only one."""
        found = new
        for k, r in enumerate(self.runs):
            found = found.join(r.prints.select("fp", F.col("first").alias(f"first_{k}"), F.col("last").alias(f"last_{k}")), "fp", "left")
        olds = range(len(self.runs))
        times = reduce(operator.add, [F.col(f"first_{k}").isNotNull().cast("int") for k in olds], F.lit(0))
        single = [F.when(F.col(f"first_{k}") == F.col(f"last_{k}"), F.col(f"first_{k}")) for k in olds]
        opened = F.when(times == 1, F.coalesce(*single)) if self.runs else F.lit(None).cast("long")
        return found.filter((F.col("first") < F.col("last")) | (times > 0)).select("fp", opened.alias("opened"))

    def add(self, batch: DataFrame, history: DataFrame | None = None, *, layout: bool = False) -> DataFrame:
        """doc_id, n_words, n_removed and kept_text of the batch (doc_id, raw, others), which joins the index.

        history holds the texts of the documents in the index, all of lesser ids; only those that have to be
        opened go any further.
        """
        self.compact()
        keep, drop = self.scratch.keep, self.scratch.drop
        self.written += 1
        k = self.written
        postings = keep(_fingerprint_rows(batch.select("doc_id", "raw")), f"postings-{k}", plain=["fp"])
        new = self._prints(postings.groupBy("fp").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), k)
        met = keep(self._met(new), f"met-{k}", plain=["fp"])
        # Hash joins: the right sides have a row a key, so the larger left sides needn't be sorted.
        wanted = postings.join(met.hint("shuffle_hash"), "fp", "left_semi").select("doc_id", "fp").unionAll(met.filter("opened is not null").select("opened", "fp"))
        shared = wanted.groupBy("doc_id").agg(F.collect_list("fp").alias("shared"))
        # The shared fingerprints of an id may come from several texts; places are of one text each.
        texts = batch.select("doc_id", "raw", F.xxhash64("raw").alias("text_hash"))
        if history is not None and self.runs:
            texts = texts.unionAll(history.select("doc_id", "raw", F.lit(None).cast("long")))
        places = keep(_window_rows(texts.join(shared.hint("shuffle_hash"), "doc_id").select("doc_id", "raw", "shared", "text_hash")), f"places-{k}", plain=["hi", "lo"])
        drop(f"postings-{k}", f"met-{k}")
        rows = places.select("hi", "lo", "doc_id", F.lit(OWN).alias("marks"))
        for r in self.runs:
            rows = rows.unionAll(r.windows.select("hi", "lo", "first", F.lit(KNOWN)))
        seen = rows.groupBy("hi", "lo").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.bit_or("marks").alias("marks"))
        # The run's new windows are those of this table that no run had before.
        seen = keep(seen.filter((F.col("marks") != KNOWN) & ((F.col("first") < F.col("last")) | (F.col("marks") == OWN))), f"windows-{k}", plain=["hi", "lo"])
        windows = seen.filter(F.col("marks") == OWN).select("hi", "lo", "first")
        repeated = places.filter("text_hash is not null").join(seen.filter("first < last").select("hi", "lo", "first").hint("shuffle_hash"), ["hi", "lo"]).filter("doc_id > first")
        starts = keep(repeated.groupBy("doc_id", "text_hash").agg(F.collect_list("at").alias("starts")), f"starts-{k}")
        drop(f"places-{k}")
        self.runs.append(Run(0, k, new, windows))
        carry = [c for c in batch.columns if c not in ("doc_id", "raw")]
        found = starts.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("starts").alias("_starts"))
        cut = batch.join(found.hint("shuffle_hash"), (F.col("doc_id") == F.col("_id")) & (F.xxhash64("raw") == F.col("_hash")), "left")
        return _cut_rows(cut.select("doc_id", "raw", "_starts", *carry), carry, layout)

    def close(self) -> None:
        """Drops all runs. Results of add() stay readable."""
        for r in self.runs:
            self.scratch.drop(f"prints-{r.number}", f"windows-{r.number}")
        self.runs = []


#: Names of results, which carried columns give way to.
RESULTS = ("doc_id", "n_words", "n_removed", "kept_text")


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, fanout: int = 2, carry: Sequence[str] = (), layout: bool = False) -> DataFrame:
    """doc_id, the carried columns, n_words, n_removed and kept_text of each document, the table taken as batches in the order of ids.

    layout: kept_text keeps the white space between kept words; a text without repeats is unchanged.
    """
    kept = [c for c in carry if c.lower() not in (*RESULTS, "raw", "_starts", "_id", "_hash")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw"), *(F.col(f"`{c}`") for c in kept))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    bounds = [None, *sorted(set(cuts or [])), None]
    index, out = FingerprintIndex(docs.sparkSession, fanout=fanout), None
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        low_ok = F.lit(True) if low is None else F.col("doc_id") > low
        high_ok = F.lit(True) if high is None else F.col("doc_id") <= high
        part = rows.filter(low_ok & (high_ok if low is not None else high_ok | F.col("doc_id").isNull()))
        found = index.add(part, None if low is None else rows.filter(F.col("doc_id") <= low), layout=layout)
        out = found if out is None else out.unionAll(found)
    index.close()
    return out
