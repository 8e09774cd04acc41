"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

Encoding. An Aho-Corasick automaton of the reversed tokens, run once over the reversed word, gives
the longest token that starts at each place. The encoder takes the longest token there, or else its
next shorter prefix that is a token, as long as it is compatible with the token before it; a place
where none fits is marked dead and the last token is taken back. A prefix of a word has one valid
encoding, so each place is left at most once for good: linear time in the word's length.

Two tokens are compatible if merging their joined symbols gives just these two. The table of that
is filled on demand: the merges of both sides are undone along the boundary, latest first, and at no
time may a pair across the boundary have had a rank that was due before.

Decoding. The token strings lie in one byte string, with a table of offsets.

Defined results: a null text is empty and has no ids; every row gives one row, repeated rows
included; other columns are not carried; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from array import array
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.vocab import Cache, vocabulary

NONE, NEVER = -1, 1 << 60
#: Entries of the compatibility table that a worker keeps.
TABLE_ENTRIES = 1_000_000


class Codec:
    def __init__(self, path: str):
        self.vocab = v = vocabulary(path)
        # A token's spelling: one character for each symbol, last symbols apart from the inner ones.
        self.ending = {c: chr(0xE000 + ord(c)) for c in v.last}
        spelt = {i: t[: -len(v.suffix) - 1] + self.ending[t[-len(v.suffix) - 1]] if len(t) > len(v.suffix) and t.endswith(v.suffix) else t for t, i in v.ids.items()}
        by_text = {t: i for i, t in spelt.items()}
        self.length = {i: len(t) for i, t in spelt.items()}
        self.shorter = {i: next((by_text[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in by_text), NONE) for i, t in spelt.items()}
        self.automaton = ahocorasick.Automaton()
        for i, t in spelt.items():
            self.automaton.add_word(t[::-1], i)
        self.automaton.make_automaton()
        self.table: dict[int, bool] = {}
        self.cached = Cache(self.encode_word)
        # Decoding: all token strings in a row, and where each begins.
        at, self.offsets, strings = 0, array("q", [0]), []
        for i in range(max(v.tokens) + 1):
            raw = v.tokens.get(i, "").encode("utf-8")
            strings.append(raw)
            self.offsets.append(at := at + len(raw))
        self.strings = b"".join(strings)

    def compatible(self, a: int, b: int) -> bool:
        key = a << 16 | b
        found = self.table.get(key)
        if found is None:
            if len(self.table) >= TABLE_ENTRIES:
                self.table.clear()
            found = self.table[key] = self._compatible(a, b)
        return found

    def _compatible(self, a: int, b: int) -> bool:
        pairs, parts = self.vocab.pairs, self.vocab.parts
        due_a = due_b = NEVER  # ranks of the merges that end a's and b's time at the boundary
        while True:
            across = pairs.get(a << 16 | b)
            if across is not None:
                rank = across >> 16
                # Of equal ranks the leftmost is merged first: a's own before the pair, the pair before b's.
                if rank < due_a and rank <= due_b:
                    return False
            made_a, made_b = parts.get(a), parts.get(b)
            if made_a is None and made_b is None:
                return True
            if made_b is None or made_a is not None and made_a[2] > made_b[2]:
                _, a, due_a = made_a
            else:
                b, _, due_b = made_b

    def encode_word(self, word: str) -> list[int]:
        n = len(word)
        longest = [NONE] * n
        for end, token in self.automaton.iter(self.ending[word[-1]] + word[-2::-1] if n > 1 else self.ending[word]):
            at = n - 1 - end
            if longest[at] == NONE:  # of the tokens that start here the longest is reported first
                longest[at] = token
        ids, at, dead, length, shorter, compatible = [], 0, bytearray(n + 1), self.length, self.shorter, self.compatible
        token = longest[0]
        while at < n:
            while token != NONE and (dead[at + length[token]] or ids and not compatible(ids[-1], token)):
                token = shorter[token]
            if token == NONE:
                dead[at] = 1
                token = ids.pop()
                at -= length[token]
                token = shorter[token]
            else:
                ids.append(token)
                at += length[token]
                token = longest[at] if at < n else NONE
        return ids

    def encode_chunk(self, chunk: bytes) -> list[int]:
        ids: list[int] = []
        for word in self.vocab.words(chunk):
            if isinstance(word, int):
                ids.append(word)
            else:
                ids += self.cached[word]
        return ids

    def decode(self, ids) -> bytes:
        """The token strings joined by a space, as the vocabulary file names no decoder."""
        strings, offsets = self.strings, self.offsets
        return b" ".join([strings[offsets[i] : offsets[i + 1]] for i in ids])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


@lru_cache(maxsize=2)
def packed_ids(path: str) -> Cache:
    """Ids of a chunk as little-endian unsigned 32-bit integers."""
    c = codec(path)
    return Cache(lambda chunk: array("I", c.encode_chunk(chunk)).tobytes())


@lru_cache(maxsize=2)
def _both(path: str) -> Cache:
    c = codec(path)

    def made(chunk: bytes) -> tuple[bytes, bytes]:
        ids = c.encode_chunk(chunk)
        return array("I", ids).tobytes(), c.decode(ids) + b" " if ids else b""

    return Cache(made)


def encode(text: str | bytes | None, path: str) -> array:
    raw = text.encode() if isinstance(text, str) else text or b""
    return array("I", b"".join(map(packed_ids(path).__getitem__, raw.split())))


def decode(ids, path: str) -> str:
    return codec(path).decode(ids).decode("utf-8")


def encode_documents(docs: DataFrame, vocab_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and `ids` (array of int) of each text."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>"

    def batches(it):
        get = packed_ids(vocab_path).__getitem__
        for batch in it:
            ids = [array("i", b"".join(map(get, (x.as_py() or b"").split()))) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("_raw")).mapInArrow(batches, schema)


def decode_documents(encoded: DataFrame, vocab_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Id and the decoded `text` of each array of ids; null ids give an empty text."""
    schema = f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, text string"

    def batches(it):
        c = codec(vocab_path)
        for batch in it:
            texts = [c.decode(x.as_py() or ()).decode("utf-8") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(batches, schema)


def round_trip(docs: DataFrame, vocab_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, n_tokens and the SHA-256 of ids and of decoded text, without moving either out of the task."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def batches(it):
        get = _both(vocab_path).__getitem__
        for batch in it:
            counts, ids, texts = [], [], []
            for x in batch.column(1):
                found = list(map(get, (x.as_py() or b"").split()))
                packed = b"".join([f[0] for f in found])
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                texts.append(hashlib.sha256(b"".join([f[1] for f in found])[:-1]).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids), pa.array(texts)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("_raw")).mapInArrow(batches, schema)
