"""Alignment of two tokenizers' tokens by the bytes that they stand for, with counts of linked id pairs.

Both tokenizers see the same bytes. Two pointers run over the ends of A's and B's tokens; where both end, a
group closes, and each token of A in a group is linked with each token of B in it. A pair's count is the
number of documents that hold it linked, over the whole corpus; a link is best if no pair of its A id counts
more.

Texts are cut into units before a space or line feed that stands alone between characters that are no white
space, and between a word's letters and the marks around them. No token of either vocabulary reaches across such
a place (A's pre-tokens end there; B has no piece in which another character is followed by a space, a letter
stands beside a mark, or a line feed occurs), which is checked when a vocabulary is loaded, so units are tokenized
and merged once and cached. Units whose tokens don't give their bytes send
the whole text through the tokenizers.

The documents of a task fall into blocks of about BLOCK tokens. A block writes its documents, each with its
pairs as places in the block's own sorted list, and the list itself with the documents of each pair. Spark
sums these lists to counts, takes the maximum of each id's pairs on either side, and joins both back to the
blocks' lists, in which each pair is one row a block, so that a frequent pair is no hot key. The lists return
to their blocks' documents in a cogroup by block, which is bounded by BLOCK.

Defined results: null and empty texts, and texts whose tokens give other bytes than a space and the text,
have no tokens: counts of 0 and '' as digest; each row is a document, repeated rows too, and counts in the
corpus once a row; only id and text are read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerline.llm.scratch import Scratch
from ledgerline.llm.vocab import BYTE_LETTERS

#: Tokens of A in a block, units in a worker's cache, and the longest unit that is cached.
BLOCK, CACHE_ENTRIES, LONGEST = 2_000_000, 300_000, 64
#: Characters of texts that are split together.
TOGETHER = 200_000

#: Letters whose neighbours are looked at, and marks that no token has together with one; an apostrophe may be.
_LETTER, _MARK = "A-Za-zÀ-ÖØ-öø-ÿ", re.escape("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
#: Where a unit may end: before white space that stands alone, or at the end.
_OVER = r"(?=[ \n]\S|\Z)"
#: A unit goes on over any white space but one space or line feed before another character.
_ON = r"(?:(?:\s{2,}|[^\S \n])\S*|[ \n]\Z)*"
_UNITS = re.compile(rf"\A\s{{2,}}\S*{_ON}|[ \n]?[{_LETTER}]+(?:(?=[{_MARK}])|{_OVER})|[{_MARK}]+(?:(?=[{_LETTER}])|{_OVER})|[ \n]?\S+{_ON}")
_WORD = re.compile(rf"[ \n]?([{_LETTER}]+)")


class Pair:
    """Two tokenizers, and what they make of a text."""

    def __init__(self, path_a: str, path_b: str):
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        letters = {chr(c): b for b, c in BYTE_LETTERS.items()}
        raw_of = lambda t: bytes(letters.get(c, ord(c) & 0xFF) for c in t)
        known = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        by_id = {i: raw_of(t) for t, i in known.items()}
        self.bytes_a = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if len(self.bytes_a) > 1 << 16 or len(pieces) > 1 << 16:
            raise ValueError("ids over 65,535 do not fit the packed pairs")
        plain = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.words_a, self.feed = self.a.model.tokenize, self.a.token_to_id("Ċ")
        self.splits = not any(re.search(f"[^▁]▁|\n|[{_LETTER}][{_MARK}]|[{_MARK}][{_LETTER}]", p) for p in plain)
        self.cache: dict[str, tuple | None] = {}

    def aligned(self, text: str, lead: str) -> tuple | None:
        """(n_a, n_b, n_groups, n_links, groups as text, {pair: links}) of lead and text, of which B adds the lead; None if bytes differ."""
        ids_a = self.a.encode(lead + text, add_special_tokens=False).ids
        ids_b = self.b.encode(text)
        return self._grouped(ids_a, ids_b, (lead + text).encode())

    def learn(self, units: list[str]) -> dict[str, tuple | None]:
        """What units give; the short ones are cached, with each of their pairs as often as it is linked."""
        if len(self.cache) + len(units) > CACHE_ENTRIES:
            self.cache.clear()
        out = {}
        # B puts a space first; before what has none, a line feed keeps it apart, and both go again.
        for unit, ids_b in zip(units, self.b.encode([u[1:] if u[0] == " " else u if u[0] == "\n" else "\n" + u for u in units], num_threads=1), strict=True):
            if unit[0] != " ":
                ids_b = ids_b[1 if unit[0] == "\n" else 2 :]
            out[unit] = found = self._grouped(self._ids_a(unit), ids_b, unit.encode())
            if len(unit) <= LONGEST:
                if found:
                    out[unit] = found = (*found[:5], tuple([k for k, n in found[5].items() for _ in range(n)]))
                self.cache[unit] = found
        return out

    def _ids_a(self, unit: str) -> list[int]:
        word = _WORD.fullmatch(unit)
        if not word:
            return self.a.encode(unit, add_special_tokens=False).ids
        letters = word[1] if unit.isascii() else word[1].encode().decode("latin-1").translate(BYTE_LETTERS)
        if unit[0] == "\n":
            return [self.feed, *(t.id for t in self.words_a(letters))]
        return [t.id for t in self.words_a("Ġ" + letters if unit[0] == " " else letters)]

    def _grouped(self, ids_a: list[int], ids_b: list[int], raw: bytes) -> tuple | None:
        """The two-pointer merge. Tokens of A always stand for the bytes they were made of, so that their length tells whether any is lost."""
        of_a, of_b = self.bytes_a, self.bytes_b
        n = len(ids_a)
        if b"".join([of_b[q] for q in ids_b]) != raw or sum([len(of_a[p]) for p in ids_a]) != len(raw):
            return None
        if n == 1 == len(ids_b):
            return 1, 1, 1, 1, f"{ids_a[0]}|{ids_b[0]}", {ids_a[0] << 16 | ids_b[0]: 1}
        i = j = links = end_a = end_b = 0
        shown: list[str] = []
        pairs: dict[int, int] = {}
        while i < n:
            x, y, p, q = i, j, ids_a[i], ids_b[j]
            end_a, end_b, i, j = end_a + len(of_a[p]), end_b + len(of_b[q]), i + 1, j + 1
            if end_a == end_b:  # one token on either side
                shown.append(f"{p}|{q}")
                key = p << 16 | q
                pairs[key] = pairs.get(key, 0) + 1
                links += 1
                continue
            while end_a != end_b:
                if end_a < end_b:
                    end_a, i = end_a + len(of_a[ids_a[i]]), i + 1
                else:
                    end_b, j = end_b + len(of_b[ids_b[j]]), j + 1
            some_a, some_b = ids_a[x:i], ids_b[y:j]
            shown.append(f"{','.join(map(str, some_a))}|{','.join(map(str, some_b))}")
            links += len(some_a) * len(some_b)
            few = links < 100  # then ids seldom repeat, and need not be counted first
            times_b = [(q, 1) for q in some_b] if few else Counter(some_b).items()
            for p, m in [(p, 1) for p in some_a] if few else Counter(some_a).items():
                for q, times in times_b:
                    pairs[p << 16 | q] = pairs.get(p << 16 | q, 0) + m * times
        return n, len(ids_b), len(shown), links, ";".join(shown), pairs

    def units(self, texts: list[str | None]) -> list[list[str] | None]:
        """The units of each text; those that are new are learnt at once."""
        if not self.splits:
            return [None] * len(texts)
        found = [_UNITS.findall(" " + t) if t else [] for t in texts]
        new = {u for units in found for u in units if u not in self.cache and len(u) <= LONGEST}
        if new:
            self.learn(list(new))
        return found

    def document(self, text: str | None, units: list[str] | None = None) -> tuple | None:
        """As `aligned`, of a space and the text, whose units may be given; None without tokens."""
        if not text:
            return None
        if not self.splits:
            return self.aligned(text, " ")
        units = units or _UNITS.findall(" " + text)
        times = Counter(units)
        cache = self.cache
        seen = {u: cache[u] for u in times if u in cache}
        if len(seen) < len(times):
            seen |= self.learn([u for u in times if u not in seen])
        if None in seen.values():
            return self.aligned(text, " ")
        pairs: dict[int, int] = {}
        get = pairs.get
        for unit, k in times.items():
            linked = seen[unit][5]
            if type(linked) is tuple:
                for pair in linked:
                    pairs[pair] = get(pair, 0) + k
            else:
                for pair, n in linked.items():
                    pairs[pair] = get(pair, 0) + n * k
        n_a, n_b, n_groups, n_links, shown, _ = zip(*map(seen.__getitem__, units), strict=True)
        return sum(n_a), sum(n_b), sum(n_groups), sum(n_links), ";".join(shown), pairs


@lru_cache(maxsize=1)
def pair_of(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


COUNTS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint"
#: Rows of documents have no pairs, and rows of pairs no document.
ROWS = f"block bigint, {COUNTS}, groups_sha256 string, places array<int>, links array<bigint>, pairs array<bigint>, docs array<int>"


def _rows(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def batches(it):
        both, task = pair_of(path_a, path_b), TaskContext.get().partitionId() << 32
        held, size, block = [], 0, 0

        def out(type_of):
            """A row for each document and, last, one for the block's pairs."""
            every = np.concatenate([linked[0] for _, _, _, linked in held])
            links = np.concatenate([linked[1] for _, _, _, linked in held])
            pairs, places, times = np.unique(every, return_inverse=True, return_counts=True)
            offsets = np.cumsum([0, *(len(linked[0]) for _, _, _, linked in held)])
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                order = np.argsort(places[a:b])  # ascending places compress best
                places[a:b], links[a:b] = places[a:b][order], links[a:b][order]
            n = len(held)
            lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(np.append(offsets, offsets[-1]).astype(np.int32)), pa.array(values.astype(kind)))
            whole = lambda values, kind: pa.ListArray.from_arrays(pa.array([0] * (n + 1) + [len(values)], pa.int32()), pa.array(values.astype(kind)))
            sums = [pa.array([counts[k] for _, counts, _, _ in held] + [None], pa.int64()) for k in range(4)]
            shas = pa.array([sha for _, _, sha, _ in held] + [None], pa.string())
            columns = [pa.array([key for key, _, _, _ in held] + [None], type_of), pa.array([task | block] * (n + 1), pa.int64()), *sums, shas, lists(places, np.int32), lists(links, np.int64), whole(pairs, np.int64), whole(times, np.int32)]
            return pa.RecordBatch.from_arrays(columns, names=[id_col, *(x.split()[0] for x in ROWS.split(", "))])

        def with_units(batch, both):
            """Rows of a batch, of which some short texts or one long one are split at a time."""
            keys, some, size = batch.column(0).to_pylist(), [], 0
            for k, x in enumerate(batch.column(1)):
                some.append(x.as_py())
                size += len(some[-1] or "")
                if size >= TOGETHER or k + 1 == len(keys):
                    yield from zip(keys[k + 1 - len(some) : k + 1], some, both.units(some), strict=True)
                    some, size = [], 0

        type_of = None
        for batch in it:
            type_of = batch.column(0).type
            for key, text, units in with_units(batch, both):
                found = both.document(text, units)
                sha = hashlib.sha256(found[4].encode()).hexdigest() if found else ""
                linked = [np.fromiter(x, np.int64) for x in ((found[5].keys(), found[5].values()) if found else ((), ()))]
                held.append((key, found[:4] if found else (0, 0, 0, 0), sha, linked))
                size += found[0] if found else 1
                if size >= BLOCK:
                    yield out(type_of)
                    held, size, block = [], 0, block + 1
        if held:
            yield out(type_of)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(batches, f"`{id_col}` {kind}, {ROWS}")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best_a, best_b): a pair's documents, and the most of any pair of its A id and of its B id."""
    n = rows.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).groupBy("x.pairs").agg(F.sum("x.docs").alias("n"))
    ids = n.select(F.col("pairs").alias("pair"), "n", F.shiftright("pairs", 16).alias("a"), F.col("pairs").bitwiseAND(0xFFFF).alias("b"))
    for side in ("a", "b"):
        ids = ids.join(ids.groupBy(side).agg(F.max("n").alias(f"best_{side}")), side)
    return ids


def align(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's tokens, groups, links and their digest, with n_best and count_sum from the corpus's counts."""
    scratch = Scratch(docs.sparkSession, "alignment")
    rows = scratch.keep(_rows(docs, path_a, path_b, id_col, text_col), "rows")
    lists = rows.filter("pairs is not null and size(pairs) > 0").select("block", "pairs", "docs")
    counts = scratch.keep(pair_counts(lists), "counts")
    listed = lists.select("block", F.posexplode("pairs").alias("place", "pair"))
    known = listed.join(counts.select("pair", "n", (F.col("n") == F.col("best_a")).alias("best")), "pair").select(F.col("block").alias("in_block"), "place", "n", "best")
    kind = rows.schema[id_col].dataType.simpleString()
    names = [id_col, *(x.split()[0] for x in COUNTS.split(", ")), "n_best", "count_sum", "groups_sha256"]

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        n, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        place = right.column("place").to_numpy()
        n[place], best[place] = right.column("n").to_numpy(), right.column("best").to_numpy()
        sums = []
        for places, links in zip(left.column("places"), left.column("links"), strict=True):
            at, times = places.values.to_numpy(), links.values.to_numpy()
            sums.append((int(best[at] @ times), int(n[at] @ times)))
        columns = [left.column(x) for x in names[:5]] + [pa.array([s[k] for s in sums], pa.int64()) for k in range(2)] + [left.column("groups_sha256")]
        return pa.Table.from_arrays(columns, names=names)

    of_docs = rows.filter("n_a is not null").drop("pairs", "docs")
    return of_docs.groupBy("block").cogroup(known.groupBy("in_block")).applyInArrow(joined, f"`{id_col}` {kind}, {COUNTS}, n_best bigint, count_sum bigint, groups_sha256 string")
