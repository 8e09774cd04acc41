"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Words are runs of characters other than space and U+0009 to U+000D. The base measures are counts
over the whole text; the rules bound ratios of them, of stop-words and of lines. A rule is
(measure, lowest, highest), either bound may be None; a text is kept if base rules and all rules
hold. Everything is one projection over the scan: no shuffle, no join, no Python.

Repeated windows: each three-word window of a text becomes one long, its hash in the upper bits (53
or 48 of them) and its place in the lower; sorted, windows with equal hashes are neighbours. Texts
of 65,536 words and more sort pairs of a 64-bit hash and a place instead. Only windows with such a
neighbour go further: they are sorted by their three words, and equal words decide.

Defined results: a null or empty text has no words and fails the base rules; every row gives one
row, repeated rows included; all input columns pass through but those named as a measure, base_failed,
failed_rules or kept in any case, which the results replace; an empty table gives an empty table.

The verdict is one expression, in which a text is measured once. `keep` filters by it: a filter on the
columns of `quality` would be pushed below the projection and measure again for each column it needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "a", "it", "for", "on", "was", "with", "be", "as", "by", "this", "have", "le", "la", "les", "de", "des", "et", "en", "un", "une", "que", "est", "du", "dans", "pour", "der", "die", "das", "und", "ist", "den", "zu", "von", "mit", "ein", "eine", "nicht", "el", "los", "las", "y", "es", "por", "con", "una", "se", "del", "para")

#: The default table, bounds inclusive.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("mean_word_chars", 2.0, 12.0),
    ("symbol_word_ratio", None, 0.2),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.5),
)

#: As they stand in texts: in lower case or with a capital.
STOP_FORMS = tuple(sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)}))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(places: Column) -> Column:
    """How many places the three-item windows that begin at these ascending places cover."""
    steps = F.transform(places, lambda p, k: F.coalesce(F.least(F.lit(3), F.get(places, k + 1) - p), F.lit(3)))
    return F.aggregate(steps, F.lit(0), lambda a, x: a + x)


def _repeat_words(words: Column) -> Column:
    """Places covered by three-word windows that occur twice or more."""
    size = F.size(words)

    def window(i: Column) -> Column:
        return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def exact(candidates: Column) -> Column:
        """What the windows at these places cover whose three words occur twice among them: equal words are neighbours."""

        def repeated(ranked: Column) -> Column:
            def same(s: Column, k: Column) -> Column:
                t = F.get(ranked, k)
                return F.coalesce((s["a"] == t["a"]) & (s["b"] == t["b"]) & (s["c"] == t["c"]), F.lit(False))

            found = F.filter(ranked, lambda s, k: same(s, k + 1) | same(s, k - 1))
            return let(F.sort_array(F.transform(found, lambda s: s["i"])), _covered)

        full = F.transform(candidates, lambda i: F.struct(F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("i")))
        return let(F.sort_array(full), repeated)

    def packed(bits: int) -> Column:
        """Sorts one long a window: the hash above, the place in the lowest bits."""
        low = (1 << bits) - 1

        def repeated(ranked: Column) -> Column:
            near = lambda x, k: F.shiftright(x.bitwiseXOR(F.get(ranked, k)), bits) == 0
            again = F.filter(ranked, lambda x, k: F.coalesce(near(x, k + 1), F.lit(False)) | F.coalesce(near(x, k - 1), F.lit(False)))
            return F.when(F.size(again) == 0, F.lit(0)).otherwise(exact(F.transform(again, lambda x: x.bitwiseAND(F.lit(low)).cast("int"))))

        longs = F.transform(F.sequence(F.lit(0), size - 3), lambda i: window(i).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
        return let(F.sort_array(longs), repeated)

    def wide(ranked: Column) -> Column:
        same = F.filter(ranked, lambda s, k: F.coalesce(s["h"] == F.get(ranked, k - 1)["h"], F.lit(False)) | F.coalesce(s["h"] == F.get(ranked, k + 1)["h"], F.lit(False)))
        return F.when(F.size(same) == 0, F.lit(0)).otherwise(exact(F.transform(same, lambda s: s["i"])))

    structs = F.sort_array(F.transform(F.sequence(F.lit(0), size - 3), lambda i: F.struct(window(i).alias("h"), i.alias("i"))))
    return F.when(size < 4, F.lit(0)).when(size < 1 << 11, packed(11)).when(size < 1 << 16, packed(16)).otherwise(let(structs, wide))


def measured(text: Column) -> Column:
    """A struct of the counts that the rules use."""

    def counts(words: Column) -> Column:
        full = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
        lines = let(full, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            lines.alias("lines"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: w.isin(*STOP_FORMS))).cast("long").alias("n_stop_words"),
        )

    return let(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), counts)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def ratios(m: Callable[[str], Column]) -> dict[str, Column]:
    words, lines = F.greatest(m("n_words"), F.lit(1)), F.greatest(m("n_lines"), F.lit(1))
    return {
        "mean_word_chars": m("word_chars") / words,
        "symbol_word_ratio": m("n_symbols") / words,
        "stop_word_ratio": m("n_stop_words") / words,
        "dup_line_ratio": m("n_dup_lines") / lines,
    }


def verdict(text: Column, *, rules=RULES, min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    """A struct of the measures, base_failed, failed_rules (names, in the table's order) and kept, from one measurement."""

    def judged(m: Column) -> Column:
        get = lambda k: m["lines"][k] if "_lines" in k else m[k]
        known = ratios(get)
        broken = [F.when(~F.coalesce((F.lit(True) if low is None else known[name] >= low) & (F.lit(True) if high is None else known[name] <= high), F.lit(False)), F.lit(name)) for name, low, high in rules]
        failed = F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")
        base = (get("n_words") < min_words) | (100 * get("n_repeat_words") > max_repeat_percent * get("n_words"))
        return F.struct(*(get(k).alias(k) for k in MEASURES), base.alias("base_failed"), failed.alias("failed_rules"), (~base & (F.size(failed) == 0)).alias("kept"))

    return let(measured(F.coalesce(text, F.lit(""))), judged)


def quality(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The input with the measures, base_failed, failed_rules and kept."""
    taken, name = {*MEASURES, "base_failed", "failed_rules", "kept"}, "_verdict"
    while name in map(str.lower, docs.columns):
        name += "_"
    passed = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken]
    return docs.select(*passed, verdict(F.col(f"`{text_col}`"), **options).alias(name)).select(*passed, f"{name}.*")


def keep(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The rows that hold the rules, with their own columns."""
    return docs.filter(verdict(F.col(f"`{text_col}`"), **options)["kept"])
