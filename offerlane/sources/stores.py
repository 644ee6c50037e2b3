"""Searches at stores over documents that were fetched for them.

What stores differ in is a row of rules each; one plan takes all queries at all stores: search pages, suggestions
and sitemaps give product URLs in the store's order of trust, product pages or documents of these give raw
offers, and offers that don't answer their query go.

Documents: store, kind, query, url, body. Kinds: search (a search page for a query), suggest (JSON for
a query), sitemap (XML), page (a product page), json (a product document). Stores are told apart in lower case.

Defined cases: documents of unknown stores or kinds are not read; a query without words that tell products apart finds nothing;
a URL counts once per store and query, at its first place; without a page or document for its URL a candidate is
lost, but where the rules take what its card shows; bad HTML, XML and JSON give what they have."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offerlane.functions.text import norm, product_line, tokens, url_key, url_name
from offerlane.operators.dedup import keep_first
from offerlane.sources import connectors
from offerlane.sources.discovery import has_marker, platform_offers, platform_variants, query_sizes, sitemap_locations, suggested_products
from offerlane.sources.evidence import card_offers, page_rows
from offerlane.sources.listing import link_rows, listing, with_cards
from offerlane.sources.offers import as_raw
from offerlane.sources.page import absolute
from offerlane.sources.storage import kept, shared_folder, until_exit
from offerlane.vocabulary import IGNORED_WORDS


class Store(NamedTuple):
    """Rules of a store.

    links: which links of search pages are candidates: label or card (that has all words), url (label or
    URL has), any, scored (those with most words, whole matches alone if there are some), or none.
    climb, priced: elements around a link that can be its card, and whether that needs a price.
    embedded: URLs anywhere in the source count as links. suggest: suggestions are candidates.
    sitemap: first, fallback (where nothing else is found) or none. most: candidates per query.
    detail: page, json or variants. card: the card stands in for a missing page. lines: one offer per product line and size."""

    store: str
    host: str
    product: str
    links: str = "none"
    climb: int = 0
    priced: bool = False
    embedded: str | None = None
    suggest: bool = False
    sitemap: str = "none"
    most: int | None = None
    detail: str = "page"
    card: bool = False
    lines: bool = False


# Hosts, URLs of products, and limits of the stores.
STORES = (
    Store("Bplatz", "bplatz.de", r"/products/[^/]+", links="card", climb=5, suggest=True, detail="json"),
    Store("Orioudh", "orioudh.com", r"/products/[^/]+", links="label", suggest=True, detail="variants", lines=True),
    Store("ParfumCity", "parfumcity.nl", r"/products/[^/]+", links="card", climb=7, priced=True, most=15),
    Store("PerfumeMarket", "perfumemarket.nl", r"/products/[^/]+", links="url", sitemap="fallback", most=50),
    Store("ParfumZentrum", "parfum-zentrum.de", r"_z\d+$", sitemap="first", most=24),
    Store("Deloox", "deloox.nl", r"/product/\d+/", links="any"),
    Store("Sabina", "sabina.com", r"^/(?:es|it|fr|en|de|nl|pt)/[^/]+", links="any", embedded=r"""(?:https?://(?:www\.)?sabina\.com)?/(?:es|it|fr|en|de|nl|pt)/[^"'<>\s\\]+""", most=20),
    Store("Notino", "notino.fr", r"^/[^/]+/[^/]+", links="scored", climb=10, priced=True, sitemap="fallback", most=8, card=True),
)
_RULES = "store string, host string, product string, links string, climb int, priced boolean, embedded string, suggest boolean, sitemap string, most int, detail string, card_too boolean, lines boolean"


def rules(spark: SparkSession, stores=STORES) -> DataFrame:
    """The rules as rows, with the store's name to show and, as store, in lower case: a row per store."""
    return spark.createDataFrame([tuple(s) for s in stores], _RULES).withColumnRenamed("store", "shown").withColumn("store", F.lower("shown"))


def _words(query: Column) -> Column:
    """Words of a query that tell products apart."""
    return F.filter(tokens(query, 1, tuple(IGNORED_WORDS)), lambda t: (t != "") & ~t.rlike("^[0-9]+$"))


def _has_all(text: Column, words: Column) -> Column:
    return (F.size(words) > 0) & (F.size(F.array_except(words, F.split(norm(text), " "))) == 0)


def _once(df: DataFrame, name: str) -> DataFrame:
    """df written, as it is read more than once."""
    spark = df.sparkSession
    return kept(df, f"{until_exit(spark, f'{shared_folder(spark)}/stores-{uuid.uuid4().hex}')}/{name}")


def _path(url: Column) -> Column:
    return F.regexp_replace(F.substring_index(F.substring_index(url, "#", 1), "?", 1), "^[A-Za-z]+://[^/]*|/+$", "")


def _own_product(url: Column) -> Column:
    """Whether a URL is of a product of the store whose rules stand beside it."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, "^[A-Za-z]+://([^/?#:]+)", 1)), r"^www\.", "")
    return ((host == F.col("host")) | host.endswith(F.concat(F.lit("."), F.col("host")))) & F.regexp_like(_path(url), F.concat(F.lit("(?i)"), F.col("product")))


def candidates(jobs: DataFrame, documents: DataFrame, stores=STORES) -> DataFrame:
    """store, query, url, rank (from 1), label, card: product URLs for each query (jobs: query) at each store."""
    spark = jobs.sparkSession
    r = F.broadcast(rules(spark, stores))  # a row per store
    asked = jobs.select("query").distinct().withColumn("words", _words(F.col("query"))).filter(F.size("words") > 0)
    docs = documents.select(F.lower("store").alias("store"), "kind", "query", "url", "body").join(r, "store")
    keys = ("store", "query")

    # links of search pages
    found = docs.filter("kind = 'search' AND links <> 'none'").join(asked, "query")
    pages = found.select(*keys, "url", F.col("body").alias("html"), F.when(F.col("links") != "any", F.col("words")).alias("words"), "climb", "priced", "embedded")
    listed = _once(listing(pages.repartition(*keys, "url"), *keys), "links")  # even tasks, whatever files the pages came in
    links = link_rows(listed, *keys).join(r, "store").join(asked, "query").filter(_own_product(F.col("url")))
    name = url_name(F.col("url"))
    n = F.size(F.array_intersect("words", F.split(norm(F.concat_ws(" ", "label", name)), " ")))
    whole = F.col("matched").isNotNull() | (n == F.size("words"))
    by_url = F.col("matched").eqNullSafe(F.lit("label")) | _has_all(name, F.col("words")) | _has_all(F.col("label"), F.col("words"))
    links = links.withColumns({"hits": n, "whole": whole}).filter(
        (F.col("links") == "any") | (F.col("links") == "label") & (F.col("matched").eqNullSafe(F.lit("label")) | _has_all(F.col("label"), F.col("words"))) | (F.col("links") == "card") & whole
        | (F.col("links") == "url") & by_url | (F.col("links") == "scored") & (F.col("whole") | (F.col("hits") > 0))
    )
    scored = F.col("links") == "scored"
    exact = F.max(F.col("whole") & scored).over(Window.partitionBy(*keys))
    links = links.withColumn("exact", exact).filter(~scored | F.col("whole") | ~F.col("exact"))
    place = F.when(scored, F.struct((-F.col("hits")).alias("a"), F.col("url").alias("b"))).otherwise(F.struct(F.col("position").alias("a"), F.lit("").alias("b")))
    own = [*keys, "url", "label", "page", "card"]
    links = links.filter(~has_marker(F.col("label"))).select(*own, F.lit(1).alias("stage"), place.alias("place"))

    # suggestions
    s = suggested_products(docs.filter("kind = 'suggest' AND suggest").select(*keys, "host", "product", F.col("body").alias("json")))
    s = s.join(asked, "query").withColumn("url", F.substring_index(absolute(F.col("url"), F.concat(F.lit("https://"), F.col("host"))), "?", 1))
    s = s.filter(_own_product(F.col("url")) & _has_all(F.col("title"), F.col("words")) & ~has_marker(F.col("title")))
    nothing = F.lit(None).cast("string")
    s = s.select(*keys, "url", F.col("title").alias("label"), nothing.alias("page"), F.lit(None).cast("int").alias("card"), F.lit(0).alias("stage"), F.struct(F.col("position").alias("a"), F.lit("").alias("b")).alias("place"))

    # sitemaps: URLs whose last part has all words, the best first
    maps = docs.filter("kind = 'sitemap' AND sitemap <> 'none'").select(F.concat_ws(" ", "store", "url").alias("url"), F.col("body").alias("xml"))
    links, s = _once(links, "candidates"), _once(s, "suggested")
    at = sitemap_locations(maps).select(F.substring_index("url", " ", 1).alias("store"), F.regexp_replace("location", "/+$", "").alias("url")).distinct().join(r, "store").filter(_own_product(F.col("url")))
    # URLs and queries meet by one word of the query, which all its URLs have, and are then compared
    named = at.select("store", "sitemap", "url", F.array_distinct(F.split(norm(url_name(F.col("url"))), " ")).alias("named"))  # once per URL
    terms = named.select("*", F.explode("named").alias("term"))
    keyed = asked.withColumn("term", F.array_max("words"))
    m = terms.join(keyed, "term").filter(F.size(F.array_except("words", "named")) == 0)
    before = links.select(*keys).unionByName(s.select(*keys)).distinct()
    m = m.filter("sitemap = 'first'").unionByName(m.filter("sitemap = 'fallback'").join(before, list(keys), "left_anti").select(*m.columns))
    m = m.select(*keys, "url", nothing.alias("label"), nothing.alias("page"), F.lit(None).cast("int").alias("card"), F.lit(2).alias("stage"), F.struct((-F.size("words")).alias("a"), F.col("url").alias("b")).alias("place"))

    every = s.unionByName(links).unionByName(m).withColumn("key", F.lower(_path(F.col("url"))))
    first = keep_first(every, [*keys, "key"], ["stage", "place", "url"])
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("stage", "place", "url"))
    first = first.withColumn("rank", rank).join(r.select("store", "most"), "store").filter(F.col("most").isNull() | (F.col("rank") <= F.col("most")))
    return with_cards(first.select(*own, "rank"), listed, *keys).select(*keys, "url", "rank", "label", "card")


def store_offers(jobs: DataFrame, documents: DataFrame, stores=STORES) -> DataFrame:
    """Raw offers of all stores for all queries (jobs: query): RAW rows with query, store and ingest_ord."""
    spark = jobs.sparkSession
    r = F.broadcast(rules(spark, stores))
    c = _once(candidates(jobs, documents, stores), "candidates").withColumn("key", url_key(F.col("url")))
    docs = documents.select(F.lower("store").alias("store"), "kind", "url", "body").join(r.select("store", "detail"), "store")
    key = F.regexp_replace(url_key(F.col("url")), "/+$", "")
    known = c.withColumn("doc_key", F.regexp_replace("key", "/+$", "")).join(r.select("store", "shown", "detail", "card_too", "lines"), "store")
    docs = docs.filter("kind IN ('page', 'json')").withColumn("doc_key", key).join(known.select("store", "doc_key"), ["store", "doc_key"], "left_semi")  # others are not parsed
    docs = keep_first(docs, ["store", "kind", "doc_key"], [F.length("body").desc(), "body"])

    pages = page_rows(docs.filter("kind = 'page' AND detail = 'page'").select("store", "doc_key", "url", F.col("body").alias("html"))).withColumnRenamed("url", "page_url")
    pages = _once(pages, "offers").filter("_told").drop("_told")
    from_pages = known.filter("detail = 'page'").select("store", "query", "rank", "shown", "lines", "doc_key", "url").join(pages, ["store", "doc_key"])

    json = docs.filter("kind = 'json'").select("store", "doc_key", "url", "body", "detail")
    least = platform_offers(json.filter("detail = 'json'").select("store", "doc_key", F.col("body").alias("json"))).withColumn("price", _euros(F.col("price_cents"))).drop("price_cents")
    variants = platform_variants(json.filter("detail = 'variants'").select("store", "doc_key", "url", F.col("body").alias("json"))).withColumn("price", _euros(F.col("price_cents"))).drop("price_cents", "url", "variant_no")
    of = lambda kind, rows: known.filter(F.col("detail") == kind).select("store", "query", "rank", "shown", "lines", "doc_key", "url").join(rows, ["store", "doc_key"])

    shown = known.filter("card_too").join(pages.select("store", "doc_key"), ["store", "doc_key"], "left_anti").select("store", "query", "rank", "shown", "lines", "doc_key", "url", "label", "card")
    from_cards = card_offers(shown).drop("label", "card")

    rows = from_pages.drop("page_url")
    for more in (of("json", least), of("variants", variants), from_cards):
        rows = rows.unionByName(more, allowMissingColumns=True)
    words = _words(F.col("query"))
    answers = _has_all(F.concat_ws(" ", "name", "brand"), words) & ~has_marker(F.col("name"))
    asked_sizes, own = query_sizes(F.col("query")), F.coalesce(F.col("size_ml").try_cast("double"), F.get(query_sizes(F.concat_ws(" ", "variant", "name")), F.lit(0)))
    rows = rows.filter(answers & ((F.size(asked_sizes) == 0) | own.isNull() | F.array_contains(asked_sizes, F.coalesce(own, F.lit(0.0)))))
    rows = rows.withColumns({"size_ml": F.coalesce("size_ml", own.cast("string")), "gone": F.coalesce(~F.col("available"), F.col("availability") == "out_of_stock", F.lit(False)), "amount": F.col("price").try_cast("double")})

    # one offer per product line and size where the rules say so, shown by its line: one in stock, the cheapest
    line = F.when(F.col("lines"), F.coalesce(product_line(F.col("name"), F.coalesce("brand", F.lit(""))), F.lit("")))
    group = F.when(F.col("lines"), F.concat_ws("|", line, "size_ml")).otherwise(F.concat_ws("|", "doc_key", norm("name"), F.coalesce("store_variant_id", F.lit(""))))
    rows = rows.withColumns({"line": line, "group": group})
    rows = keep_first(rows, ["store", "query", "group"], ["gone", F.col("amount").asc_nulls_last(), "rank", "url", F.col("store_variant_id").asc_nulls_last()])
    rows = rows.withColumns({"product_line": F.when(F.col("lines"), F.col("line")), "name": F.when(F.col("lines") & (F.col("line") != ""), F.col("line")).otherwise(F.col("name"))})
    order = Window.partitionBy("store", "query").orderBy("rank", "group")
    rows = rows.withColumn("ingest_ord", F.row_number().over(order).cast("long")).withColumn("store", F.col("shown"))
    return as_raw(rows.select(*(x for x in rows.columns if x not in ("rank", "shown", "lines", "doc_key", "gone", "amount", "line", "group"))), "query")


def _euros(cents: Column) -> Column:
    return F.when(cents.isNotNull(), F.format_string("%d.%02d", F.floor(cents / 100).cast("bigint"), cents % 100))


def connect(documents: DataFrame, stores=STORES) -> list[str]:
    """Registers a bulk connector for each store that searches these documents; gives their names."""
    names = []
    for s in stores:
        def ask(spark: SparkSession, attempts: DataFrame, s: Store = s) -> DataFrame:
            own = documents.filter(F.lower("store") == s.store.lower())
            found = store_offers(attempts.select(F.col("attempt").alias("query")), own, (s,))
            return found.withColumnRenamed("query", "attempt")

        connectors.bulk_connector(s.store)(ask)
        names.append(s.store.lower())
    return names
