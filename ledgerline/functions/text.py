"""Text expressions: folding, keys, fingerprints and URLs, all in the JVM."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the text key: Unicode's, and the separators U+001C to U+001F.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def ascii_fold(c: Column) -> Column:
    """Lower case for A to Z only, as in the catalog's case-insensitive matches and sorts."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row, however often body uses it and wherever a filter on it is pushed."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def casefold(c: Column) -> Column:
    """Case folding for columns and literals alike: sharp s, ligatures, long s and final sigma are one with their folds."""
    return F.lower(F.replace(F.upper(c), F.lit("Σ"), F.lit("σ")))


def text_key(c: Column) -> Column:
    """Case-folded text with single spaces."""
    return casefold(collapse(c))


def contains_term(c: Column, term: str) -> Column:
    """Literal containment, A to Z in either case. c may be folded already."""
    return F.contains(ascii_fold(c), F.lit(term.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of an injective encoding of the parts; null differs from empty."""
    return F.sha2(F.to_json(F.array(*parts)), 256)


def canonical_url(c: Column) -> Column:
    """Scheme and host in lower case, no default port, empty query or fragment; null unless http(s) with a host and a valid port."""
    scheme = F.lower(F.regexp_extract(c, r"^([A-Za-z]+)://", 1))
    authority = F.regexp_extract(c, r"^[A-Za-z]+://([^/?#]*)", 1)
    rest = F.regexp_replace(F.regexp_extract(c, r"^[A-Za-z]+://[^/?#]*([^#]*)", 1), r"\?$", "")
    user = F.regexp_extract(authority, r"^(.*@)", 1)
    place = F.regexp_replace(authority, r"^.*@", "")
    host = F.lower(F.regexp_extract(place, r"^(\[[^\]]*\]|[^:\[\]]*)(?::[0-9]*)?$", 1))
    port = F.regexp_extract(place, r":([0-9]*)$", 1).try_cast("int")
    valid = ~place.rlike(r":[0-9]+$") | F.coalesce(port <= 65535, F.lit(False))
    shown = F.when(port.isNull() | (port == F.when(scheme == "http", 80).otherwise(443)), F.lit("")).otherwise(F.concat(F.lit(":"), port.cast("string")))
    return F.when(scheme.isin("http", "https") & (host != "") & valid, F.concat(scheme, F.lit("://"), user, host, shown, rest))


def safe_url(c: Column) -> Column:
    """The URL if it is http(s) with a host and has no user part, white space or control character."""
    return F.when(c.rlike(r"^(?i:https?)://[^/?#@\s\x00-\x1f\x7f]+([/?#][^\s\x00-\x1f\x7f]*)?$"), c)
