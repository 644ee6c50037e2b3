"""Quality rules: a table of thresholds compiled into one Spark projection.

Each rule bounds one ratio of a text. All ratios and the verdict are built-in
expressions over the row, so a corpus is judged in a single pass without a
shuffle or a user function.

Defined cases: a null text has no words and fails; an empty text likewise; very
long texts are read whole (counts are linear or n log n in their words); repeated
rows are judged alike; an empty table gives an empty table; columns of the input
are kept, and helper columns take names that the input has not.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlane.llm.common import fresh, let, words_of


class Rule(NamedTuple):
    """Keep a text only if low <= metric <= high (None: no bound)."""

    metric: str
    low: float | None
    high: float | None


#: Frequent words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that it for was on are as with be this by from or an at not "
    "le la les de des du et un une que qui est dans pour par sur en au avec "
    "der die das und zu den mit von ist im ein eine nicht auf sich für "
    "el los las y del que se por con para una su como es lo"
).split()

#: The production thresholds.
RULES = (
    Rule("mean_word_length", 2.0, 15.0),
    Rule("symbol_ratio", None, 0.10),
    Rule("bang_ratio", None, 0.20),
    Rule("stop_word_ratio", 0.01, None),
    Rule("dup_line_ratio", None, 0.50),
    Rule("ellipsis_line_ratio", None, 0.30),
    Rule("bullet_line_ratio", None, 0.90),
)

#: Fixed base rule: fewer words, or a larger percentage of words in repeated windows, fails.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3

SYMBOLS = "[#*$%&|<>]"
BLANK = " \t\n\x0b\f\r"


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Number of words that lie in a window of width words found twice or more.

    Windows are compared by their 64-bit hash: they are sorted with their places,
    equal neighbours are the repeated ones, and the gaps between their places give
    how many words they cover together."""
    n = F.size(words)
    windows = F.sort_array(
        F.transform(
            F.sequence(F.lit(0), n - width),
            lambda i: F.struct(F.xxhash64(*(F.get(words, i + k) for k in range(width))).alias("h"), i.alias("at")),
        )
    )
    places = let(
        windows,
        lambda s: F.sort_array(
            F.transform(
                F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])),
                lambda x: x["at"],
            )
        ),
    )
    covered = let(
        places,
        lambda p: F.aggregate(
            F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.least(F.lit(width), F.coalesce(b - a, F.lit(width)))),
            F.lit(0).cast("long"),
            lambda total, x: total + x,
        ),
    )
    return F.when(n > width, covered).otherwise(F.lit(0).cast("long"))


def with_quality(df: DataFrame, text: str = "text", out: str = "quality", rules=RULES, stop_words=STOP_WORDS) -> DataFrame:
    """df with a struct column out: counts, ratios, base_failed, kept and the
    names of the failed rules. A column named out is replaced."""
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(raw, "\n"), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    # words, lines and counts are each bound once per row, wherever the optimizer moves the expression
    quality = let(words_of(raw), lambda w: let(lines, lambda ln: let(_counts(raw, w, ln, stop_words), lambda c: _judged(c, rules))))
    return df.withColumn(out, quality)


def _counts(raw: Column, w: Column, ln: Column, stop_words) -> Column:
    """Counts of a text, its words and its lines with a word."""
    cased = [f(s) for s in stop_words for f in (str.lower, str.title, str.upper)]
    n_lines = F.size(ln).cast("long")
    return F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(raw, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (n_lines - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
        repeated_words(w).alias("n_repeat_words"),
        n_lines.alias("n_lines"),
        F.regexp_count(raw, F.lit("[!?]{2}")).cast("long").alias("n_bangs"),
        F.size(F.filter(w, lambda x: x.isin(cased))).cast("long").alias("n_stop_words"),
        F.size(F.filter(ln, lambda x: F.btrim(x, F.lit(BLANK)).endswith("..."))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter(ln, lambda x: F.substring(F.btrim(x, F.lit(BLANK)), 1, 1).isin("-", "*", "•"))).cast("long").alias("n_bullet_lines"),
    )


#: The fields of _counts().
COUNTS = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_bangs n_stop_words n_ellipsis_lines n_bullet_lines".split()


def _judged(c: Column, rules) -> Column:
    """The counts with their ratios and the verdict."""

    def ratio(a: str, b: str) -> Column:
        return F.when(c[b] > 0, c[a] / c[b]).otherwise(F.lit(0.0))

    metrics = {
        "mean_word_length": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "n_words"),
        "bang_ratio": ratio("n_bangs", "n_words"),
        "stop_word_ratio": ratio("n_stop_words", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "ellipsis_line_ratio": ratio("n_ellipsis_lines", "n_lines"),
        "bullet_line_ratio": ratio("n_bullet_lines", "n_lines"),
    }
    base_failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
    passes = {
        r.metric: (F.lit(True) if r.low is None else metrics[r.metric] >= r.low) & (F.lit(True) if r.high is None else metrics[r.metric] <= r.high)
        for r in rules
    }
    kept = ~base_failed
    for ok in passes.values():
        kept = kept & ok
    failed = F.array_compact(F.array(*(F.when(~ok, F.lit(name)) for name, ok in passes.items()))) if passes else F.array().cast("array<string>")
    fields = [c[k].alias(k) for k in COUNTS] + [v.alias(k) for k, v in metrics.items()]
    return F.struct(*fields, base_failed.alias("base_failed"), failed.alias("failed_rules"), kept.alias("kept"))


def keep_quality(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of df that pass the base rule and every threshold, columns unchanged."""
    (out,) = fresh(df, "quality")
    return with_quality(df, text, out, **options).filter(F.col(out)["kept"]).select(*(F.col(f"`{c}`") for c in df.columns))
