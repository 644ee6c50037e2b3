"""Orders of offers and products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlane.functions.classify import availability_rank
from offerlane.functions.text import norm_text, query_tokens
from offerlane.operators.dedup import keep_first
from offerlane.vocabulary import NON_PERFUME


def price_order() -> list[Column]:
    """By price, nulls last, then availability, store, name and URL."""
    return [F.col("price_cents").asc_nulls_last(), availability_rank(F.col("availability")), F.col("store_rank"), F.col("name_n"), F.lower(F.trim("url"))]


def overlap(query: str, name: Column, text: Column, brand: Column) -> dict[str, Column]:
    """Query words among the words of the name, within the text, and among the words of the brand."""
    words = F.array(*(F.lit(w) for w in query_tokens(query))).cast("array<string>")
    return {
        "matched_name": F.size(F.filter(words, lambda w: F.array_contains(F.split(name, " "), w))),
        "matched_text": F.size(F.filter(words, lambda w: F.contains(text, w))),
        "matched_brand": F.size(F.filter(words, lambda w: F.array_contains(F.split(brand, " "), w))),
    }


def relevance_order(query: str) -> list[Column]:
    """Most matching words first, then by price order."""
    found = overlap(query, F.col("name_n"), F.col("name_n"), F.col("brand_n"))
    return [c.desc() for c in found.values()] + price_order()


def suggest(products: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """Products to propose for what was typed: product_id, name, brand, priority,
    position, at most limit of them, best first. One row per brand and name; less
    than two characters propose nothing."""
    q = norm_text(query)
    words = [w for w in q.split() if len(w) >= 2]
    name, brand = F.col("name_n"), F.col("brand_n")
    text = F.concat_ws(" ", F.nullif(brand, F.lit("")), F.nullif(name, F.lit("")))
    good = (name != "") & F.lit(len(q) >= 2)
    for w in words:
        good = good & text.contains(w)
    for p in sorted({norm_text(p) for p in NON_PERFUME}):
        good = good & ~name.contains(p)
    priority = F.when(name.startswith(q), 0).when(brand.startswith(q), 1).when(name.contains(q), 2).when(brand.contains(q), 3).otherwise(4)
    at = F.locate(q, text) - 1
    found = keep_first(products.filter(good), ["brand_n", "name_n"], ["product_id"])
    found = found.select("product_id", "name", "brand", "name_n", priority.alias("priority"), F.when(at < 0, 999).otherwise(at).alias("position"))
    return found.orderBy("priority", "position", F.length("name_n"), "name_n", "product_id").limit(max(1, limit)).drop("name_n")
