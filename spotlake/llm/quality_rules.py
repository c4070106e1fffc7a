r"""Operator 9: quality rules with adaptive thresholds, in DataFrame functions only.

Measures of each whole text are ratios (symbols, duplicate lines, repeated words, word length). Their distribution is
taken per language and source by mergeable quantile sketches: a first aggregation sketches each (language, source, salt),
so that a hot source is spread, and a second merges the sketches of a group. The fences are the group's own and no constants: three
quartile ranges above its upper quartile; where the quartiles are equal, as when most of a group's texts have no symbol at all, a
quarter of the way from its median to its 95th percentile. They are joined back to the documents, and a document beyond a fence of its
group is dropped, besides those that fail the base rules. A ratio of counts is beyond a fence only if the count is three standard
deviations of a Poisson count above it (at least three), so that one stray symbol in a short text drops nothing.

Ranks of a sketch are exact in groups of up to a few hundred documents and within about one per cent in larger ones; where the
sketches of a large group are merged in another order, a fence may move within that error.

Words are runs of characters other than \x20 and \x09-\x0D. Repeated words are found by comparing all eight-word windows
of a text: eight passes over its normalised words, each taking every eighth window, give all windows as strings; only a
text in which one occurs twice is gone through position by position.

Null text counts as empty: all counts 0, base_failed true. Null language or source is a group of its own. Rows are kept
one by one, repeated ones included; other columns are kept, those named as the outputs are replaced. An empty table gives
an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotlake.llm.common import cut, shielded, stored, unshielded

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 8
SALTS, SPREAD, TAIL_SHARE = 16, 3.0, 0.25
#: Ratio -> (count, exposure, words of one event); None: a mean, compared as it is.
RATIOS = {"symbol_ratio": ("n_symbols", "word_chars", 1), "dup_line_ratio": ("n_dup_lines", "n_words", 1), "repeat_ratio": ("n_repeat_words", "n_words", WINDOW), "word_length": None}
#: A count this many standard deviations above its fence is beyond it.
MARGIN = 3.0
#: Groups up to which the fences are broadcast; beyond, they are joined by a shuffle.
MOST_BROADCAST = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(normal: Column, n_words: Column) -> Column:
    """Words inside eight-word windows that occur twice or more; normal: words joined and ended by single blanks."""
    nth = "(?:[^ ]++ ){%d}"  # each match starts where the last one ended, so that no word is searched from within, however long
    shifted = [normal if not k else F.regexp_replace(normal, "^" + nth % k, "") for k in range(WINDOW)]
    every_eighth = [F.regexp_extract_all(s, F.lit(r"\G" + nth % WINDOW), F.lit(0)) for s in shifted]
    windows = F.concat(*every_eighth)
    any_twice = F.size(windows) > F.size(F.array_distinct(windows))
    # window number i of pass k starts at word 8 i + k
    starts = [_starts(one, k) for k, one in enumerate(every_eighth)]
    by_hash = F.sort_array(F.concat(*starts))
    covered = F.get(F.transform(F.array(by_hash), _covered), F.lit(0))  # a lambda's argument is worked out once
    return F.when((n_words > WINDOW) & any_twice, covered).otherwise(F.lit(0)).cast("long")


def _starts(windows: Column, k: int) -> Column:
    return F.transform(windows, lambda w, i: F.struct(F.xxhash64(w).alias("h"), (i * WINDOW + k).alias("at")))


def _covered(by_hash: Column) -> Column:
    """Words covered by the windows whose hash a neighbour in the sorted array shares."""
    twice = F.transform(by_hash, lambda w, i: F.when((F.get(by_hash, i - 1)["h"] == w["h"]) | (F.get(by_hash, i + 1)["h"] == w["h"]), w["at"]))
    places = F.sort_array(F.filter(twice, lambda p: p.isNotNull()))
    return F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the text, with the columns of COUNTS (long)."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, *COUNTS)]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    first = docs.select(*kept, text.alias("__text"), F.regexp_replace(F.concat(text, F.lit(" ")), SPACE, " ").alias("__spaced"))
    normal = F.regexp_replace("__spaced", "^ ", "")
    second = first.select(*kept, "__text", normal.alias("__normal"))
    n_words = (F.length("__normal") - F.length(F.replace(F.col("__normal"), F.lit(" "), F.lit("")))).cast("long")
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(WORD))
    return second.select(
        *kept,
        n_words.alias("n_words"),
        (F.length("__normal").cast("long") - n_words).alias("word_chars"),
        F.regexp_count("__text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__normal"), n_words).alias("n_repeat_words"),
    )


def _ratios() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbol_ratio": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_line_ratio": F.col("n_dup_lines") / words,
        "repeat_ratio": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
    }


def thresholds(counts: DataFrame, groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """A row per group: its columns, and for each ratio the fence of the group."""
    ratios = _ratios()
    salted = counts.select(*groups, F.pmod(F.xxhash64(*COUNTS), F.lit(SALTS)).alias("__salt"), *[r.cast("double").alias(n) for n, r in ratios.items()])
    partial = salted.groupBy(*groups, "__salt").agg(*[F.kll_sketch_agg_double(n).alias(n) for n in ratios])
    merged = partial.groupBy(*groups).agg(*[F.kll_merge_agg_double(n).alias(n) for n in ratios])

    def fence(name: str) -> Column:
        low, middle, high, tail = (F.kll_sketch_get_quantile_double(name, F.lit(q)) for q in (0.25, 0.5, 0.75, 0.95))
        return F.when(high > low, high + SPREAD * (high - low)).otherwise(middle + TAIL_SHARE * (tail - middle))

    return merged.select(*groups, *[fence(n).alias(f"max_{n}") for n in ratios])


def beyond(name: str) -> Column:
    """Whether a document with its group's fence max_<name> beside it is beyond that fence."""
    fence = F.col(f"max_{name}")
    if RATIOS[name] is None:
        return _ratios()[name] > fence
    count, exposure, size = RATIOS[name]
    events, expected = F.col(count) / float(size), fence * F.col(exposure) / float(size)
    return events > expected + MARGIN * F.sqrt(F.greatest(expected, F.lit(1.0)))


def _judged(counts: DataFrame, groups: tuple[str, ...], least_words: int, most_repeated: int) -> DataFrame:
    """counts with base_failed and reason, after the fences are joined back to it."""
    fences = cut(thresholds(counts, groups))
    fences = fences.select(*[F.col(g).alias(f"__{g}") for g in groups], *[f"max_{n}" for n in RATIOS])
    if fences.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        fences = F.broadcast(fences)
    on = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups]
    base_failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    reason = F.when(base_failed, F.lit("base"))
    for name in RATIOS:
        reason = reason.when(beyond(name), F.lit(name))
    return counts.join(fences, on, "left").select(*[F.col(f"`{c}`") for c in counts.columns], base_failed.alias("base_failed"), reason.alias("reason"))


def _grouped(groups: tuple[str, ...]) -> dict[str, str]:
    return {f"group_{i}": g for i, g in enumerate(groups)}


def apply_rules(docs: DataFrame, groups: tuple[str, ...] = ("lang", "source"), text_col: str = "text", least_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """docs without the text, with the columns of COUNTS, base_failed, kept (both boolean) and reason (string, null if kept).

    Base rules: fewer than least_words words, or more than most_repeated per cent of the words repeated.
    """
    outputs = [*COUNTS, "base_failed", "kept", "reason"]
    names = [c for c in docs.columns if c != text_col and c not in outputs]
    counts = cut(with_counts(shielded(docs, names, **_grouped(groups), text=text_col), "text"))
    judged = _judged(counts, tuple(_grouped(groups)), least_words, most_repeated).withColumn("kept", F.col("reason").isNull())
    return unshielded(judged, names, *outputs)


def keep_passing(docs: DataFrame, groups: tuple[str, ...] = ("lang", "source"), text_col: str = "text", least_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """The rows of docs that apply_rules() keeps, with the same columns."""
    counts = stored(with_counts(shielded(docs, docs.columns, **_grouped(groups), whole=text_col), "whole"), "quality-rules")
    return unshielded(_judged(counts, tuple(_grouped(groups)), least_words, most_repeated).where(F.col("reason").isNull()), docs.columns)
