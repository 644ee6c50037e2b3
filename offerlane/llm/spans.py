"""Regular-expression matches with their places, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlane.llm.common import let

#: A match: code points start .. end (exclusive), its text, and some text on either side up to the next match.
MATCH = "struct<start:int,end:int,match:string,left:string,right:string>"

#: Matches whose places are summed in one run.
BLOCK = 256


def matches(text: Column, pattern: str, left: int = 0, right: int = 0, through: bool = False) -> Column:
    """The leftmost non-overlapping matches of a pattern in order.

    The texts between matches, from split(), and the matches give the places: those
    within a block of BLOCK matches by a running sum, as arrays grow by copying, and
    the blocks' starts by another.
    through: text on the left reaches through the match before."""

    none = F.array().cast(f"array<{MATCH}>")

    def placed(p: Column, m: Column) -> Column:
        def step(acc: Column, k: Column) -> Column:
            before, own = F.get(p, k), F.get(m, k)
            start = acc["at"] + F.char_length(before)
            end = start + F.char_length(own)
            near = F.concat(F.coalesce(F.get(m, k - 1), F.lit("")), before) if through else before
            row = F.struct(start.alias("start"), end.alias("end"), own.alias("match"), F.right(near, F.lit(left)).alias("left"), F.left(F.get(p, k + 1), F.lit(right)).alias("right"))
            return F.struct(end.alias("at"), F.array_append(acc["out"], row).alias("out"))

        def block(first: Column) -> Column:
            places = F.sequence(first, F.least(first + BLOCK, F.size(m)) - 1)
            return F.aggregate(places, F.struct(F.lit(0).alias("at"), none.alias("out")), step)

        def onward(acc: Column, own: Column) -> Column:
            moved = F.transform(own["out"], lambda x: x.withField("start", x["start"] + acc["at"]).withField("end", x["end"] + acc["at"]))
            return F.struct((acc["at"] + own["at"]).alias("at"), F.array_append(acc["out"], moved).alias("out"))

        blocks = F.transform(F.sequence(F.lit(0), F.size(m) - 1, F.lit(BLOCK)), block)
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{MATCH}>>").alias("out"))
        return F.aggregate(blocks, start, onward, lambda acc: F.flatten(acc["out"]))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, let(F.split(text, pattern, -1), lambda p: placed(p, m))))
    return F.coalesce(found, none)


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def per_char(x: Column, pattern: str) -> Column:
    """Matches of a pattern per character of x."""
    return F.regexp_count(x, F.lit(pattern)) / F.greatest(F.char_length(x), F.lit(1))


def entropy(x: Column) -> Column:
    """Bits per character of the distribution of characters in x."""
    chars = F.filter(F.split(x, ""), lambda c: c != "")
    n = F.greatest(F.size(chars), F.lit(1)).cast("double")

    def bits(c: Column) -> Column:
        share = F.size(F.filter(chars, lambda y: y == c)) / n
        return -share * F.log2(share)

    return F.aggregate(F.transform(F.array_distinct(chars), bits), F.lit(0.0), lambda a, b: a + b)
