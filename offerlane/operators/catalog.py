"""The product and offer tables: upserts, products made for unknown offers, lookups, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlane.functions.text import filled, number_text, stable_id
from offerlane.operators.dedup import keep_first, keep_last


def offer_id(store: Column, product_id: Column, variant_id: Column, size: Column, url: Column) -> Column:
    """The key of an offer; sizes count by value, however written."""
    return stable_id("OFFER", store, product_id, variant_id, number_text(size), url, size=16)


def product_key(catalog_id: Column, brand: Column, name: Column) -> Column:
    """The catalog id of an offer, or one made from brand and name."""
    return F.coalesce(filled(catalog_id), stable_id("SH-AUTO", brand, name))


def upsert(old: DataFrame | None, new: DataFrame, key: str | list[str], order: list[Column]) -> DataFrame:
    """old with the rows of new put in by key, in order; later rows win over earlier
    ones and over old. Write the result to a new place and switch."""
    keys = [key] if isinstance(key, str) else key
    last = keep_last(new, keys, order)
    if old is None:
        return last
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last, allowMissingColumns=True)


def missing_products(offers: DataFrame, products: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first offer of each product that the product table lacks."""
    return keep_first(offers.join(products.select(key).distinct(), key, "left_anti"), [key], order)


def with_offers(products: DataFrame, offers: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """products with an array of their offers, priced ones first, then by price and store."""
    row = F.struct(F.col("price_cents").isNull().alias("unpriced"), "price_cents", "store", *(f for f in fields if f not in ("price_cents", "store")))
    listed = offers.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("offers"))
    return products.join(listed, key, "left").withColumn("offers", F.coalesce("offers", F.array()))


def counts(products: DataFrame, offers: DataFrame) -> DataFrame:
    """products, offers, stores: one row."""
    n = products.agg(F.count("*").alias("products"))
    return offers.agg(F.count("*").alias("offers"), F.countDistinct("store").alias("stores")).crossJoin(F.broadcast(n)).select("products", "offers", "stores")
