"""Searches over offers, composed of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlane.functions.classify import reject_reason
from offerlane.functions.text import query_tokens
from offerlane.operators.dedup import keep_first
from offerlane.operators.rank import price_order, relevance_order

#: What tells offers of a store apart here, and the order of arrival.
IDENTITY = ["store_n", "product_id", "name_n"]


def candidates(offers: DataFrame, query: str) -> DataFrame:
    """What a store returns for a query: offers whose name has all its words."""
    found = F.lit(True)
    for w in query_tokens(query):
        found = found & F.array_contains(F.split("name_n", " "), w)
    return offers.filter(found)


def reason(query: str) -> Column:
    return reject_reason(query, F.col("name_n"), F.lit(None).cast("double"), F.col("name_n"))


def unvalidated(offers: DataFrame, query: str, order: list) -> DataFrame:
    """Offers that stores return, each once, by price."""
    return keep_first(candidates(offers, query), IDENTITY, order).orderBy(*price_order())


def validated(offers: DataFrame, query: str, order: list) -> DataFrame:
    """Offers each once, then those that answer the query, by price.

    Duplicates go before validation, as only the first of a key is looked at; the
    order of relevance decides which of the validated comes first for a key, and
    keys are already unique by then."""
    unique = keep_first(offers, IDENTITY, order)
    return unique.filter(reason(query).isNull()).orderBy(*price_order())


def validation_order(offers: DataFrame, query: str, order: list) -> DataFrame:
    """Unique offers in the order in which they are validated."""
    return keep_first(offers, IDENTITY, order).orderBy(*relevance_order(query))


def funnel(offers: DataFrame, query: str, order: list) -> DataFrame:
    """Per store, and in total (store null): offers, unique ones, duplicates, matches and rejects."""
    n = offers.groupBy("store").agg(F.count("*").alias("raw"))
    unique = keep_first(offers, IDENTITY, order).withColumn("reason", reason(query))
    u = unique.groupBy("store").agg(F.count("*").alias("unique_offers"), F.count_if(F.col("reason").isNull()).alias("matched"))
    per = n.join(u, "store")
    return per.rollup("store").agg(
        F.sum("raw").alias("raw"), F.sum("unique_offers").alias("unique_offers"), (F.sum("raw") - F.sum("unique_offers")).alias("duplicates"),
        F.sum("matched").alias("matched"), (F.sum("unique_offers") - F.sum("matched")).alias("rejected"),
    )
