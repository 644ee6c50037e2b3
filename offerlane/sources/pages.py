"""Fetched pages and JSON documents as rows."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page_text(html: Column) -> Column:
    """The text of a page in lower case: no scripts, styles and tags, single blanks."""
    t = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    return F.lower(F.trim(F.regexp_replace(t, r"[ \t\n\x0B\f\r]+", " ")))


def tag_text(html: Column, tag: str) -> Column:
    """The text of the first element of a kind, null without one."""
    found = F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(found, "(?s)<[^>]*>", " "), r"[ \t\n\x0B\f\r]+", " ")), F.lit(""))


def links(pages: DataFrame) -> DataFrame:
    """page_id, position, link: the targets of a page's anchors in order, made
    absolute, without query and fragment, each once per page at its first place."""
    host = F.regexp_extract("url", r"^([A-Za-z]+://[^/?#]+)", 1)
    rows = pages.select("page_id", host.alias("host"), F.posexplode(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))).alias("position", "href"))
    bare = F.substring_index(F.substring_index("href", "#", 1), "?", 1)
    link = F.when(bare.rlike("^[A-Za-z]+://"), bare).when(bare.startswith("/"), F.concat("host", bare)).otherwise(F.concat(F.col("host"), F.lit("/"), bare))
    return rows.withColumn("link", link).groupBy("page_id", "link").agg(F.min("position").alias("position"))


class _Page(HTMLParser):
    """Title, headings, links with their text, and JSON-LD blocks of a page."""

    def __init__(self):
        super().__init__()
        self.title, self.h1, self.links, self.json, self.at, self.held = "", "", [], [], None, []

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in ("title", "h1") or tag == "script" and attrs.get("type") == "application/ld+json":
            self.at, self.held = tag, []
        elif tag == "a" and attrs.get("href"):
            self.at, self.held = "a", []
            self.links.append([attrs["href"], ""])

    def handle_endtag(self, tag):
        if tag != self.at:
            return
        text = " ".join("".join(self.held).split())
        if tag == "a":
            self.links[-1][1] = text
        elif tag == "script":
            self.json.append("".join(self.held))
        elif not getattr(self, tag):
            setattr(self, tag, text)
        self.at = None

    def handle_data(self, data):
        if self.at:
            self.held.append(data)


def _products(node):
    """Product nodes of a JSON-LD document, depth first."""
    todo = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo.extend(reversed(x))
        elif isinstance(x, dict):
            kinds = x.get("@type")
            if "Product" in (kinds if isinstance(kinds, list) else [kinds]):
                yield x
            todo.extend(v for v in reversed(list(x.values())) if isinstance(v, (list, dict)))


def page_offer(html: str | None) -> dict:
    """What a page says of one product: its JSON-LD if there is one, else its headings."""
    page = _Page()
    page.feed(html or "")
    page.close()
    out = {"title": page.title or None, "name": page.h1 or None, "brand": None, "price": None, "currency": None, "availability": None, "n_links": len(page.links)}
    for block in page.json:
        try:
            product = next(_products(json.loads(block)), None)
        except ValueError:
            continue
        if product:
            brand, offers = product.get("brand"), product.get("offers")
            offer = offers[0] if isinstance(offers, list) and offers else offers
            offer = offer if isinstance(offer, dict) else {}
            price = offer.get("price", offer.get("lowPrice"))
            out |= {
                "name": product.get("name") or out["name"],
                "brand": brand.get("name") if isinstance(brand, dict) else brand,
                "price": None if price is None else str(price),
                "currency": offer.get("priceCurrency"),
                "availability": (offer.get("availability") or "").rpartition("/")[2] or None,
            }
            break
    return out


def page_offers(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url and what page_offer() finds, in Arrow batches."""

    def parse(batches):
        for pdf in batches:
            found = pd.DataFrame([page_offer(h) for h in pdf["html"]], columns=["title", "name", "brand", "price", "currency", "availability", "n_links"])
            yield pd.concat([pdf[["page_id", "url"]].reset_index(drop=True), found], axis=1)

    schema = "page_id long, url string, title string, name string, brand string, price string, currency string, availability string, n_links long"
    return pages.select("page_id", "url", "html").mapInPandas(parse, schema)


def platform_products(documents: DataFrame, column: str = "json") -> DataFrame:
    """Variants of shop-platform product documents: one row per variant with a price.
    Amounts are in cents; bad JSON gives nothing."""
    schema = "struct<id:bigint,title:string,vendor:string,featured_image:string,variants:array<struct<id:bigint,title:string,sku:string,barcode:string,price:double,available:boolean>>>"
    parsed = documents.withColumn("_doc", F.from_json(column, schema)).select("*", F.explode("_doc.variants").alias("_variant"))
    return parsed.filter(F.col("_variant.price").isNotNull()).select(
        F.col("_doc.id").alias("store_product_id"), F.col("_variant.id").alias("store_variant_id"), F.col("_doc.vendor").alias("brand"), F.col("_doc.title").alias("name"),
        F.col("_variant.title").alias("variant"), F.col("_variant.sku").alias("sku"), F.col("_variant.barcode").alias("gtin"), F.col("_variant.price").cast("bigint").alias("price_cents"),
        F.col("_variant.available").alias("available"), F.col("_doc.featured_image").alias("image"),
    )


def sitemap_urls(xml: Column) -> Column:
    """All locations of a sitemap or sitemap index, in order, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&"))))
