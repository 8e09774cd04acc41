"""A word-level BPE vocabulary file: symbols, merges, special strings and pre-tokenisation.

The file is the JSON of a public tokenizer whose words end in a suffix symbol. A text's ids are the
concatenation of the ids of its chunks between ASCII white space: neither the special strings nor the
pre-tokens hold white space, and normalisation does not reach across it. So ids, counts and decoded
text are found once for each distinct chunk, in a bounded cache.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

from tokenizers import Tokenizer

#: Chunks and words longer than this are worked on but not cached.
LONGEST_CACHED = 64
#: Entries in each of a worker's caches; one is emptied when full.
CACHE_ENTRIES = 400_000

#: The format's pre-token pattern on printable, lower-case ASCII without white space.
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")

#: The same on lower-case letters of Latin-1 too. These letters are composed and have one lower-case form, so
#: that normalisation is lower() alone; chunks with other characters go to the library.
LATIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
LATIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

#: Byte-level alphabet: printable bytes are themselves, the others follow from 256 on, in order.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LETTERS = {b: 256 + k for k, b in enumerate(sorted({*range(256)} - {*_SHOWN}))}


class Vocabulary:
    """Merges by symbol id: pairs[a << 16 | b] = rank << 16 | merged id.

    A word is a string in the byte-level alphabet, one character for each byte. Its last symbol is
    the one with the end-of-word suffix. Chunks of printable ASCII are split here; the others by the
    file's own normaliser and pre-tokenizer, so that the Unicode tables are the library's.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: dict[int, str] = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.specials.items()}
        if len(self.tokens) > 1 << 16 or max(self.tokens) >= 1 << 16:
            raise ValueError(f"{path}: ids over 65,535 do not fit the packed pairs")
        self.pairs: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            x, y, z = self.ids[a], self.ids[b], self.ids[a + b]
            self.pairs[x << 16 | y] = rank << 16 | z
            self.parts[z] = (x, y, rank)
        self.inner = {t: i for t, i in self.ids.items() if len(t) == 1}
        self.last = {t: self.ids[t + self.suffix] for t in self.inner}
        self._special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")")
        library = Tokenizer.from_file(path)
        self._normal, self._pre = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.model = library.model

    def words(self, chunk: bytes) -> Iterator[str | int]:
        """The words of a chunk without ASCII white space, or the ids of special strings in it."""
        text = chunk.decode("utf-8")
        for part in self._special.split(text) if self.specials and "<|" in text else (text,):
            if part in self.specials:
                yield self.specials[part]
            elif part.isascii() and part.isprintable():
                part = part.lower()
                if part.isalpha():
                    yield part
                else:
                    yield from ASCII_WORDS.findall(part)
            elif LATIN.fullmatch(part):
                for word in LATIN_WORDS.findall(part.lower()):
                    yield word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS)
            else:
                for word, _ in self._pre(self._normal(part)):
                    yield word

    def symbols(self, word: str) -> list[int]:
        inner = self.inner
        out = [inner[c] for c in word]
        out[-1] = self.last[word[-1]]
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Cache(dict):
    """What a function gives for each short key, for as many keys as fit."""

    def __init__(self, made: Callable):
        super().__init__()
        self.made = made

    def __missing__(self, key):
        value = self.made(key)
        if len(key) <= LONGEST_CACHED:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[key] = value
        return value
