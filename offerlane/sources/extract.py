"""Prices, stock, names and candidates out of page text and reader Markdown."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from offerlane.functions.measures import cents
from offerlane.functions.text import clean, norm, query_tokens, url_name

_AMOUNT = r"([0-9]{1,4}[.,][0-9]{2})"
_UNIT = r"(?:ml|cl|dl|l|oz|fl\s*oz|g|kg)"
_PER_100 = r"(?!\s*/\s*100\s*(?:ml|g))"
# Ways in which a page gives the price of the product, the surest first; the last match of a way counts.
PRICE_WAYS = (
    rf"(?iu)prix\s+actuel\s+(?:de\s+)?{_AMOUNT}\s*€{_PER_100}",
    rf"(?iu)\b[0-9]{{1,4}}(?:[.,][0-9]{{1,2}})?\s*{_UNIT}\s+(?:de\s+)?{_AMOUNT}\s*€",
    rf"(?iu){_AMOUNT}\s*€?\s+[0-9]{{1,4}}(?:[.,][0-9]{{1,2}})?\s*{_UNIT}\b",
    rf"(?iu)(?:€\s*)?{_AMOUNT}(?:\s*€){_PER_100}",
)
# Words on a search card that tell the stock, of all languages together; the first list wins.
OUT_OF_STOCK = ("indisponible", "épuisé", "epuise", "out of stock", "sold out", "unavailable", "rupture de stock", "esaurito", "non disponibile")
IN_STOCK = ("disponible", "available", "in stock", "en stock", "disponibile")
#: Likeness from which a misspelled word counts as one of the name; lengths may differ by so many.
RATIO, LENGTH = 0.8, 2


def page_price(text: Column) -> Column:
    """Price in cents of the product on a page, never a price per 100 ml; null without one."""
    t = clean(text)
    found = [F.element_at(F.regexp_extract_all(t, F.lit(way), F.lit(1)), -1) for way in PRICE_WAYS]
    last = F.coalesce(*(F.when(F.size(F.regexp_extract_all(t, F.lit(way), F.lit(1))) > 0, x) for way, x in zip(PRICE_WAYS, found)))
    amount = F.replace(last, F.lit(","), F.lit(".")).try_cast("double")
    return F.when(amount > 0, cents(amount))


def candidate_price(prices: Column, most: float = 10_000.0) -> Column:
    """The first of an array of amounts, in order of trust, that can be a price."""
    return F.get(F.filter(prices, lambda p: (p > 0) & (p < most)), F.lit(0))


def card_stock(text: Column) -> Column:
    """in_stock, out_of_stock or unknown by the words on a card."""
    t = F.lower(clean(text))

    def has(words):
        return F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(t, w))

    return F.when(has(OUT_OF_STOCK), "out_of_stock").when(has(IN_STOCK), "in_stock").otherwise("unknown")


def card_name(text: Column) -> Column:
    """A product's name on a card: no ratings, prices and promotions, not said twice."""
    t = F.regexp_replace(clean(text), r"(?iu)\b[0-9](?:[.,][0-9])?\s*/\s*5\b|\([0-9]+\)", " ")
    t = F.regexp_replace(t, r"(?iu)(?:€\s*)?[0-9]{1,4}[.,][0-9]{2}\s*€?", " ")
    t = F.regexp_replace(clean(t), r"(?iu)^(?:promo|nouveau|discount|cadeaux? offerts|livraison offerte)\s+", "")
    words = F.split(clean(t), " ")
    half = (F.size(words) / 2).cast("int")
    first, second = F.slice(words, F.lit(1), half), F.slice(words, half + 1, half)
    return F.when((F.size(words) >= 4) & (F.size(words) % 2 == 0) & (first == second), F.array_join(first, " ")).otherwise(clean(t))


def _letters_in_common(a: Column, b: Column) -> Column:
    """How many letters two words share, repeats counted: no fewer than their matching blocks have."""
    counts = lambda x, c: F.char_length(x) - F.char_length(F.replace(x, c))
    both = F.array_intersect(F.split(a, ""), F.split(b, ""))
    return F.aggregate(both, F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(counts(a, c), counts(b, c))))


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of words by longest matching blocks."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype=float)


def alike_words(words: DataFrame, query: str) -> DataFrame:
    """Pairs (wanted, word) of a word of the query and another of words (column word) that are alike. What is left by the
    lengths and by the letters in common is compared, each pair once."""
    wanted = F.array(*(F.lit(w) for w in dict.fromkeys(query_tokens(query)))).cast("array<string>")
    pairs = words.select("word").distinct().withColumn("wanted", F.explode(wanted)).filter("word <> wanted AND word <> ''")
    a, b = F.char_length("wanted"), F.char_length("word")
    # a ratio r needs r / 2 * (a + b) letters in blocks, which the shorter word and the letters in common must have
    least = (a + b) * (RATIO / 2) - 1e-9
    possible = pairs.filter((F.least(a, b) >= least) & (_letters_in_common(F.col("wanted"), F.col("word")) >= least))
    return possible.filter(_ratio("wanted", "word") >= RATIO).select("wanted", "word")


def with_fuzzy_hits(df: DataFrame, name: str, query: str) -> DataFrame:
    """df with hits (word of the query -> whether the name has it or, if its length is within LENGTH of that of the
    name's longest word, one like it) and fuzzy, how many were only alike. Names and words are looked at once each."""
    names = df.select(norm(name).alias("_name")).distinct()
    words = names.select("_name", F.explode(F.array_distinct(F.split("_name", " "))).alias("word"))
    alike = words.join(alike_words(words, query), "word").groupBy("_name").agg(F.collect_set("wanted").alias("_alike"))  # of the words of the query
    wanted = list(dict.fromkeys(query_tokens(query)))
    own = F.split(norm(name), " ")
    longest = F.array_max(F.transform(own, F.length))
    exact = [F.array_contains(own, w) for w in wanted]
    near = [~e & F.coalesce(F.array_contains("_alike", w), F.lit(False)) & (F.abs(longest - len(w)) <= LENGTH) for e, w in zip(exact, wanted)]
    entries = [F.struct(F.lit(w).alias("key"), (e | n).alias("value")) for e, n, w in zip(exact, near, wanted)]
    hits = F.map_from_entries(F.array(*entries)) if entries else F.create_map().cast("map<string,boolean>")
    fuzzy = sum((n.cast("int") for n in near), F.lit(0))
    return df.join(alike, F.col("_name") == norm(name), "left").withColumns({"hits": hits, "fuzzy": fuzzy}).drop("_name", "_alike")


def markdown_candidates(documents: DataFrame, column: str = "markdown", back: int = 80) -> DataFrame:
    """Links of reader Markdown: doc_id, line, label, url, brand (the last ## heading)
    and product (the last ### heading), both from at most so many lines before."""
    lines = documents.select("doc_id", F.posexplode(F.split(column, "\n")).alias("line", "text"))
    above = Window.partitionBy("doc_id").orderBy("line").rowsBetween(-back, 0)

    def heading(marks: str) -> Column:
        own = F.regexp_extract("text", rf"^{marks}\s+(.*?)\s*$", 1)
        return F.last(F.when(own != "", own), ignorenulls=True).over(above)

    marked = lines.withColumns({"brand": heading("##"), "product": heading("###")})
    pair = F.regexp_extract_all("text", F.lit(r"\[[^\]]*\]\([^)\s]+\)"), F.lit(0))
    rows = marked.select("doc_id", "line", "brand", "product", F.explode(pair).alias("link"))
    return rows.select("doc_id", "line", F.regexp_extract("link", r"^\[([^\]]*)\]", 1).alias("label"), F.regexp_extract("link", r"\(([^)]*)\)$", 1).alias("url"), "brand", "product")


def ranked_candidates(candidates: DataFrame, query: str, limit: int = 24) -> DataFrame:
    """Candidates (url, label) scored by 10 per query word in label or URL, the best
    per URL; if any has all words, only those; at most limit, best first."""
    words = query_tokens(query)
    text = F.concat_ws(" ", norm("label"), url_name(F.col("url")))
    tokens = F.split(text, " ")
    n = F.size(F.filter(F.array(*(F.lit(w) for w in words)).cast("array<string>"), lambda w: F.array_contains(tokens, w)))
    best = candidates.withColumn("score", 10 * n).groupBy("url").agg(F.max("score").alias("score"), F.max_by("label", F.struct("score", "label")).alias("label"))
    exact = F.col("score") == 10 * len(words)
    some = best.filter(F.col("score") > 0)
    only = some.agg(F.max(exact.cast("int")).alias("any_exact"))
    return some.crossJoin(F.broadcast(only)).filter((F.col("any_exact") == 0) | exact).drop("any_exact").orderBy(F.col("score").desc(), "url").limit(limit)  # only: one row
