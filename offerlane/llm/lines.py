"""Line dedup by site-relative frequency.

For each site the share of its pages that contain a line is the number of those
pages over all pages of the site; lines above a ratio are boilerplate of that
site and are dropped from every page of it.

Work is two passes over the pages. The first counts (site, line) by a 128-bit
hash of the line, pre-aggregated before the shuffle, so a site with a third of
all pages is spread over its lines. A site can have at most (mean distinct lines
per page) / ratio boilerplate lines, hence the second pass needs one short list
per site. That table is written first: Spark then knows its size and broadcasts
it below its threshold, and joins by site otherwise.

Defined cases: a null or empty text stays as it is; a null site is a site of its
own; blank lines are kept and never counted; a line counts once per page however
often it occurs there, and all its occurrences go; repeated rows are pages of
their own; an empty table gives an empty table; other columns pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlane.llm.common import fresh, let, written

#: Share of a site's pages above which a line is boilerplate. A line of one page doesn't recur, so it takes two
#: pages at least; without that, a site of one page would lose all its text.
MAX_RATIO, MIN_PAGES = 0.05, 2

BLANK = " \t\n\x0b\f\r"


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, to use as the site of web pages."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def line_key(line: Column) -> Column:
    """128 bits of the line without blanks at its ends, as two longs."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit("line"), bare).alias("b"))


def _keys(text: Column) -> Column:
    """Keys of the distinct lines of a text that have a word. Lines are told apart
    as strings, in a hash set: structs would be compared pair by pair."""
    bare = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANK)))
    return F.transform(F.array_remove(F.array_distinct(bare), ""), line_key)


def _has(keys: Column, key: Column) -> Column:
    """Whether a sorted array has a key: the place of the key by halves."""

    def half(at: Column, _: Column) -> Column:
        mid = F.shiftright(at["lo"] + at["hi"], 1)
        below = F.get(keys, mid) < key
        return F.struct(F.when(below, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(below, at["hi"]).otherwise(mid).alias("hi"))

    n = F.size(keys)
    steps = F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(n + F.lit(1))).cast("int"), F.lit(1)))
    start = F.struct(F.lit(0).alias("lo"), F.greatest(n, F.lit(0)).alias("hi"))
    return F.coalesce(F.aggregate(steps, start, half, lambda at: F.get(keys, at["lo"])) == key, F.lit(False))


def boilerplate(df: DataFrame, text: str = "text", site: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per site that has boilerplate: site, n_pages, and keys, its boilerplate lines in order."""
    pages = df.select(F.col(f"`{site}`").alias("site"), F.col(f"`{text}`").alias("text"))
    totals = pages.groupBy("site").agg(F.count("*").alias("n_pages"))
    counts = pages.select("site", F.explode(_keys(F.col("text"))).alias("key")).groupBy("site", "key").agg(F.count("*").alias("n"))
    frequent = counts.filter(F.col("n") >= min_pages)
    t, c = totals.alias("t"), frequent.alias("c")
    over = c.join(t, F.col("t.site").eqNullSafe(F.col("c.site"))).filter(F.col("n") > max_ratio * F.col("n_pages"))
    return over.groupBy("t.site").agg(F.max("n_pages").alias("n_pages"), F.sort_array(F.collect_list("key")).alias("keys"))


def drop_boilerplate(df: DataFrame, text: str = "text", site: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, dropped: str | None = None) -> DataFrame:
    """df with the boilerplate lines of each site cut from text. dropped: name of
    an extra column with the number of lines that went."""
    found = written(boilerplate(df, text, site, max_ratio, min_pages), "boilerplate")
    at, keys, kept = fresh(df, "site_of_lines", "boilerplate_keys", "kept_text")
    found = found.select(F.col("site").alias(at), F.col("keys").alias(keys))
    joined = df.join(found, F.col(at).eqNullSafe(F.col(f"`{site}`")), "left")
    lines = F.split(F.col(f"`{text}`"), "\n")
    rest = F.array_join(F.filter(lines, lambda x: (F.btrim(x, F.lit(BLANK)) == "") | ~let(line_key(x), lambda key: _has(F.col(keys), key))), "\n")
    joined = joined.withColumn(kept, F.when(F.col(keys).isNull() | F.col(f"`{text}`").isNull(), F.col(f"`{text}`")).otherwise(rest))
    columns = [F.col(kept).alias(c) if c == text else F.col(f"`{c}`") for c in df.columns]
    if dropped:
        n = F.when(F.col(f"`{text}`").isNull(), 0).otherwise(_n_lines(F.col(f"`{text}`")) - _n_lines(F.col(kept)))
        columns.append(n.cast("long").alias(dropped))
    return joined.select(*columns)


def _n_lines(text: Column) -> Column:
    """Lines of a text that have a word."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANK)) != ""))
