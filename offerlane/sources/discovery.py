"""Discovery: from fetched search results, suggestions, platform documents and sitemaps
to product URLs and raw offers. Every source is a table of fetched documents, keyed by
its URL or by the query that it answers; sources are joined and united in one plan."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlane.functions.text import clean, filled, norm, norm_text, query_tokens, url_name, url_parts
from offerlane.operators.dedup import keep_first
from offerlane.sources.extract import markdown_candidates
from offerlane.sources.page import absolute
from offerlane.sources.storage import kept, shared_folder, until_exit
from offerlane.vocabulary import NON_PERFUME

#: DDL of a shop platform's product document, as far as it is read. Prices can be numbers or text.
PLATFORM = (
    "struct<id:string,title:string,vendor:string,url:string,featured_image:variant,images:array<variant>,"
    "variants:array<struct<id:string,title:string,sku:string,barcode:string,price:variant,available:boolean>>>"
)


def has_marker(text: Column, markers=NON_PERFUME) -> Column:
    """Whether all words of one of the markers are among the words of a text."""
    words = F.split(norm(text), " ")
    split = [norm_text(m).split() for m in markers]
    sets = F.array(*(F.array(*(F.lit(w) for w in m)) for m in split))
    some = F.arrays_overlap(words, F.array(*(F.lit(w) for w in sorted({m[0] for m in split if m}))))  # most texts have no first word of a marker
    return F.when(some, F.exists(sets, lambda m: F.size(F.array_except(m, words)) == 0)).otherwise(F.lit(False))


def product_has_marker(name: Column, url: Column, title: Column) -> Column:
    """has_marker() of a product's name, title or the path of its URL."""
    path = F.try_url_decode(F.regexp_replace(F.coalesce(url, F.lit("")), "^[A-Za-z]+://[^/]*|[?#].*$", ""))
    return has_marker(name) | has_marker(title) | has_marker(F.coalesce(path, F.lit("")))


def has_words(text: Column, query: str, whole: bool = True) -> Column:
    """Whether a text has all words of a query that tell products apart, as words or anywhere."""
    words = query_tokens(query)
    if not words:
        return F.lit(False)
    n = norm(text)
    return F.forall(F.array(*(F.lit(w) for w in words)), lambda w: F.array_contains(F.split(n, " "), w) if whole else F.contains(n, w))


def query_sizes(query: Column) -> Column:
    """The sizes in ml that a query asks for."""
    found = F.regexp_extract_all(F.lower(query), F.lit(r"(?<![0-9])([0-9]+(?:[.,][0-9]+)?)\s*(?:ml|cl)\b"), F.lit(0))
    number = lambda x: F.replace(F.regexp_extract(x, r"([0-9]+(?:[.,][0-9]+)?)", 1), F.lit(","), F.lit(".")).try_cast("double")
    return F.transform(found, lambda x: number(x) * F.when(x.endswith("cl"), 10.0).otherwise(1.0))


def size_fits(text: Column, query: Column) -> Column:
    """Whether a text names one of the sizes that a query asks for; any text does if it asks for none."""
    asked = query_sizes(query)
    return (F.size(asked) == 0) | F.arrays_overlap(asked, query_sizes(text))


def answers(name: Column, brand: Column, size_ml: Column, url: Column, query: str, product_path: str) -> Column:
    """Whether a product page answers a query: its URL is of a product, its name and
    brand have all words, its size is the one asked for if both are known, and it is no other kind of product."""
    q = norm_text(query)
    n = norm(name)
    barred = sorted({norm_text(p) for p in NON_PERFUME} - {p for p in map(norm_text, NON_PERFUME) if p in q})
    asked = query_sizes(F.lit(q))
    fits = (F.size(asked) == 0) | size_ml.isNull() | F.array_contains(asked, F.coalesce(size_ml, F.lit(0.0)))
    other = F.exists(F.array(*(F.lit(p) for p in barred)).cast("array<string>"), lambda p: F.contains(n, p))
    return (n != "") & url.rlike(product_path) & has_words(F.concat_ws(" ", name, brand), query, whole=False) & fits & ~other


def query_variants(query: str, least: int = 3) -> list[str]:
    """What to ask a suggestion service for: the query, its compact form, and its longer words."""
    import re

    full = norm_text(query)
    compact = re.sub(r"(?<=[0-9]) +(?=[a-z])|(?<=[a-z]) +(?=[0-9])", "", full)
    found = [query] + ([compact] if compact and compact != full else [])
    return list(dict.fromkeys(found + [w for w in full.split() if len(w) >= least]))


def suggested_products(documents: DataFrame, column: str = "json") -> DataFrame:
    """Products of a platform's suggestion documents: the other columns, position, title, url. Bad JSON gives none."""
    doc = F.try_variant_get(F.try_parse_json(column), "$.resources.results.products", "array<variant>")
    rows = documents.select(*(c for c in documents.columns if c != column), F.posexplode(doc).alias("position", "_p"))
    get = lambda *paths: filled(*(F.try_variant_get("_p", p, "string") for p in paths))
    return rows.select(*(c for c in rows.columns if c != "_p"), get("$.title", "$.name").alias("title"), get("$.url").alias("url"))


def candidate_urls(suggestions: DataFrame, query: str, base: str) -> DataFrame:
    """url, position: product URLs among suggestions (variant, title, url) for the
    variants of a query whose titles have its words, each once, in order."""
    order = F.array_position(F.array(*(F.lit(v) for v in query_variants(query))), F.col("variant"))
    url = F.substring_index(absolute(F.col("url"), F.lit(base)), "?", 1)
    good = suggestions.filter((order > 0) & has_words(F.col("title"), query) & ~has_marker(F.col("title"))).withColumns({"url": url, "_order": order})
    first = keep_first(good.filter(F.col("url").contains("/products/")), [F.rtrim(F.col("url"), F.lit("/"))], ["_order", "position"])
    return first.select("url", (F.col("_order") * 1000 + F.col("position")).alias("position"))


def amount(price: Column, cents_from: float | None = None) -> Column:
    """A platform price in whole cents. Numbers are cents, text is an amount; with
    cents_from, anything from that on is cents and anything below an amount."""
    n = F.try_variant_get(price, "$", "double")
    text = F.try_variant_get(price, "$", "string")
    if cents_from is not None:
        return F.floor(F.when(n >= cents_from, n).otherwise(n * 100) + 0.5).cast("bigint")
    kind = F.schema_of_variant(price)
    written = F.replace(F.regexp_extract(text, r"[0-9]+(?:[.,][0-9]{1,2})?", 0), F.lit(","), F.lit(".")).try_cast("double")
    found = F.when(kind == "STRING", F.floor(written * 100 + 0.5)).otherwise(F.floor(n + 0.5)).cast("bigint")
    return F.when(found > 0, found)


def platform_image(doc: Column, url: Column) -> Column:
    """The image of a document, text or block, else the first of its images, absolute."""
    own = lambda v: F.coalesce(F.try_variant_get(v, "$.src", "string"), F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    return absolute(filled(own(doc["featured_image"]), own(F.get(doc["images"], F.lit(0)))), url)


def platform_offers(documents: DataFrame, column: str = "json") -> DataFrame:
    """A row per product document (url, json): the least price of its variants that are
    available, by the rule that numbers from 100 on are cents. Products of another kind,
    and documents that aren't products, go; without an available variant there is no price."""
    d = documents.withColumn("_doc", F.from_json(column, PLATFORM)).filter("_doc.title is not null")
    there = F.filter("_doc.variants", lambda v: v["available"])
    price = F.array_min(F.filter(F.transform(there, lambda v: amount(v["price"], 100.0)), lambda x: x.isNotNull()))
    rows = d.filter(~has_marker(F.col("_doc.title")))
    return rows.select(*(c for c in documents.columns if c != column), F.col("_doc.title").alias("name"), price.alias("price_cents"), (F.coalesce(F.size(there), F.lit(0)) > 0).alias("available"))


def platform_variants(documents: DataFrame, column: str = "json") -> DataFrame:
    """A row per priced variant of product documents (url, json), with identifiers and image."""
    d = documents.withColumn("_doc", F.from_json(column, PLATFORM)).select("*", F.posexplode("_doc.variants").alias("variant_no", "_v"))
    d = d.withColumn("price_cents", amount(F.col("_v.price"))).filter("price_cents is not null")
    return d.select(
        *(c for c in documents.columns if c != column), "variant_no", F.col("_doc.id").alias("store_product_id"), F.col("_v.id").alias("store_variant_id"), F.col("_doc.vendor").alias("brand"), F.col("_doc.title").alias("name"),
        F.col("_v.title").alias("variant"), F.col("_v.sku").alias("sku"), F.nullif(F.regexp_replace("_v.barcode", "[^0-9]", ""), F.lit("")).alias("gtin"), "price_cents",
        F.col("_v.available").alias("available"), platform_image(F.col("_doc"), F.col("url")).alias("image"),
    )


def catalog_suggestions(payloads: DataFrame, column: str = "json", limit: int = 10) -> DataFrame:
    """Products of an outer catalog's answers (a list, or an object with the list under
    data, results or fragrances): position, name, brand, store, image, catalog_id."""
    v = F.try_parse_json(column)
    lists = F.coalesce(*(F.try_variant_get(v, p, "array<variant>") for p in ("$", "$.data", "$.results", "$.fragrances")))
    rows = payloads.select(*(c for c in payloads.columns if c != column), F.posexplode(lists).alias("position", "_p")).filter(F.col("position") < limit)
    get = lambda *paths: filled(*(F.try_variant_get("_p", p, "string") for p in paths))
    brand = get("$.Brand", "$.brand")
    found = {"name": get("$.Name", "$.name"), "brand": brand, "store": brand, "image": get("$['Image URL Transparent']", "$['Image URL']", "$.image"), "catalog_id": get("$._id", "$.id")}
    return rows.withColumns(found).drop("_p").filter("name is not null")


def sitemap_kind(xml: Column) -> Column:
    """urlset, sitemapindex, or null for what is neither."""
    root = F.regexp_extract(F.coalesce(xml, F.lit("")), r"(?is)<(?:[a-z]+:)?(urlset|sitemapindex)\b", 1)
    return F.nullif(F.lower(root), F.lit(""))


def sitemap_locations(documents: DataFrame, column: str = "xml") -> DataFrame:
    """url (of the document), kind, position, location: what sitemaps list, in order,
    each once. Locations are read wherever they stand, so broken XML gives what it has."""
    unescaped = lambda x: F.replace(F.regexp_replace(F.trim(x), r"^<!\[CDATA\[\s*|\s*\]\]>$", ""), F.lit("&amp;"), F.lit("&"))
    found = F.transform(F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), unescaped)
    return documents.select("url", sitemap_kind(F.col(column)).alias("kind"), F.posexplode(F.array_distinct(found)).alias("position", "location"))


def sitemap_products(documents: DataFrame, root: str, column: str = "xml") -> DataFrame:
    """location, position: pages that the sitemap at root lists, itself or by the maps
    that its index names (.xml or .xml.gz, fetched as documents too), each once."""
    rows = sitemap_locations(documents, column)
    top = rows.filter(F.col("url") == root)
    child = (F.col("kind") == "sitemapindex") | (F.lower("location").contains("sitemap") & F.lower("location").rlike(r"\.xml(\.gz)?$"))
    named = top.filter(child).select(F.col("location").alias("url"), F.col("position").alias("map_no"))
    below = rows.join(named, "url").select("location", "map_no", "position")
    own = top.filter(~F.coalesce(child, F.lit(False))).select("location", F.lit(-1).alias("map_no"), "position")
    first = keep_first(own.unionByName(below), ["location"], ["map_no", "position"])
    return first.select("location", "map_no", "position")


def sitemap_files(spark: SparkSession, path: str) -> DataFrame:
    """url (the file's place) and xml of sitemap files at a path, packed (gzip) or not; a broken archive gives null."""
    import gzip
    import zlib

    @F.pandas_udf("string")
    def unpacked(content: pd.Series) -> pd.Series:
        def one(raw):
            try:
                return (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode("utf-8", "replace")
            except (OSError, EOFError, zlib.error):
                return None

        return content.map(one)

    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("url"), unpacked("content").alias("xml"))


#: Levels of index maps that are followed.
LEVELS = 8


def sitemap_tree(documents: DataFrame, roots: DataFrame, column: str = "xml", levels: int = LEVELS) -> DataFrame:
    """root, location, place: the pages that the sitemaps at roots (column root) list, themselves or by index
    maps in any number of levels up to levels, each once per root at its first place (the positions on the way to it). Maps that name
    each other are followed once; maps that weren't fetched are left out."""
    rows = kept(sitemap_locations(documents, column), f"{until_exit(documents.sparkSession, f'{shared_folder(documents.sparkSession)}/sitemaps-{uuid.uuid4().hex}')}/rows")
    child = (F.col("kind") == "sitemapindex") | (F.lower("location").contains("sitemap") & F.lower("location").rlike(r"\.xml(\.gz)?$"))
    rows = rows.select("url", "location", "position", F.coalesce(child, F.lit(False)).alias("child"))
    spark = documents.sparkSession
    rows.createOrReplaceTempView("_sitemap_rows")
    roots.select("root").distinct().createOrReplaceTempView("_sitemap_roots")
    found = spark.sql(
        f"""WITH RECURSIVE walk (root, at, place, way) MAX RECURSION LEVEL {levels + 1} AS (
              SELECT root, root, cast(array() AS array<int>), array(root) FROM _sitemap_roots
              UNION ALL
              SELECT w.root, r.location, array_append(w.place, r.position), array_append(w.way, r.location)
              FROM walk w JOIN _sitemap_rows r ON r.url = w.at
              WHERE r.child AND NOT array_contains(w.way, r.location) AND size(w.way) <= {levels})
            SELECT w.root, r.location, array_append(w.place, r.position) AS place
            FROM walk w JOIN _sitemap_rows r ON r.url = w.at WHERE NOT r.child"""
    )
    return found.groupBy("root", "location").agg(F.min("place").alias("place"))


def sitemap_candidates(locations: DataFrame, query: str, limit: int = 24) -> DataFrame:
    """location, score: of pages that share words with a query the best, 10 per word in the URL's name."""
    words = query_tokens(query)
    own = F.split(url_name(F.col("location")), " ")
    hits = F.size(F.filter(F.array(*(F.lit(w) for w in words)).cast("array<string>"), lambda w: F.array_contains(own, w)))
    best = locations.groupBy("location").agg(F.max(10 * hits).alias("score"))
    return best.filter("score > 0").orderBy(F.col("score").desc(), "location").limit(limit)


def brand_queries(candidates: DataFrame, query: str) -> DataFrame:
    """brand, search: further searches, of each brand found with the words of a query that aren't its own."""
    words = F.array(*(F.lit(w) for w in query_tokens(query))).cast("array<string>")
    brand = norm("brand")
    rest = F.array_join(F.array_except(words, F.split(brand, " ")), " ")
    return candidates.filter(brand != "").select(brand.alias("brand"), F.trim(F.concat_ws(" ", brand, rest)).alias("search")).distinct()


def staged(*stages: DataFrame, key: str = "url") -> DataFrame:
    """The union of stages (all with the same columns), each row at its first stage: adds stage."""
    out = None
    for k, rows in enumerate(stages):
        rows = rows.withColumn("stage", F.lit(k))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return keep_first(out, [key], ["stage"])


def first_stage(*stages: DataFrame, least: int = 1) -> DataFrame:
    """The rows of stages up to the first with which there are at least so many: later stages are fallbacks."""
    out = staged(*stages)
    counts = out.groupBy("stage").agg(F.count("*").alias("n"))
    totals = counts.agg(F.sort_array(F.collect_list(F.struct("stage", "n"))).alias("s"))  # a row per stage, few by construction
    before = F.aggregate(F.filter("s", lambda x: x["stage"] < F.col("stage")), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return out.crossJoin(F.broadcast(totals)).filter(before < least).drop("s")


def reader_searches(query: str) -> list[str]:
    """What to ask a reader for: the query, its words in reverse order, and each of its words."""
    words = norm_text(query).split()
    return list(dict.fromkeys([query.strip(), " ".join(reversed(words)), *query_tokens(query)])) if words else []


def reader_discovery(documents: DataFrame, locations: DataFrame, query: str, limit: int = 24, least: int = 2) -> DataFrame:
    """url, label, score, stage: candidates for a query in a reader's Markdown (search, markdown), best first.

    Stage 0 are pages for the query and its variants, stage 1 those for the brands found there with the rest of the query,
    stage 2 the pages that sitemaps list (location). A later stage counts only if the ones before it have fewer than
    least candidates with all words."""
    words = query_tokens(query)
    if not words:
        return documents.sparkSession.createDataFrame([], "url string, label string, score bigint, stage int")
    docs = documents.select(F.col("search").alias("doc_id"), "markdown")
    links = kept(markdown_candidates(docs), f"{until_exit(documents.sparkSession, f'{shared_folder(documents.sparkSession)}/reader-{uuid.uuid4().hex}')}/links")
    direct = links.filter(F.col("doc_id").isin(reader_searches(query)))
    brands = brand_queries(direct.withColumn("brand", F.coalesce("brand", url_parts(F.col("url"))[0])), query)
    branded = links.join(brands.select(F.col("search").alias("doc_id")).distinct(), "doc_id")
    mapped = locations.select(F.col("location").alias("url"), url_name(F.col("location")).alias("label"))
    n = F.size(F.array_intersect(F.array(*(F.lit(w) for w in words)), F.split(F.concat_ws(" ", norm("label"), url_name(F.col("url"))), " ")))

    def scored(rows: DataFrame) -> DataFrame:
        best = rows.withColumn("score", (10 * n).cast("bigint")).filter("score > 0").groupBy("url")
        return best.agg(F.max("score").alias("score"), F.max_by("label", F.struct("score", "label")).alias("label"))

    every = staged(scored(direct), scored(branded), scored(mapped))
    exact = (F.col("score") == 10 * len(words)).cast("int")
    counts = every.groupBy("stage").agg(F.sum(exact).alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("stage", "n"))).alias("exact"))  # three stages
    before = [F.coalesce(F.element_at("exact", F.lit(k)), F.lit(0)) for k in range(2)]
    open_to = F.when(before[0] >= least, 0).when(before[0] + before[1] >= least, 1).otherwise(2)
    return every.crossJoin(F.broadcast(counts)).filter(F.col("stage") <= open_to).select("url", "label", "score", "stage").orderBy(F.desc("score"), "stage", "url").limit(limit)


def not_seen(candidates: DataFrame, seen: DataFrame, key: str = "url") -> DataFrame:
    """Candidates whose URL no earlier source gave."""
    return candidates.join(seen.select(key).distinct(), key, "left_anti")


def matching_links(links: DataFrame, query: str, host: str, limit: int | None = None) -> DataFrame:
    """Links (url, position, label, card) on a host whose label, card or URL has the words of a query, in order."""
    own = F.lower(F.regexp_replace(F.regexp_extract("url", "^[A-Za-z]+://([^/?#:]+)", 1), r"^www\.", ""))
    label = clean(F.coalesce("label", F.lit("")))
    text = F.when(has_words(label, query), label).when(has_words(F.coalesce("card", F.lit("")), query), F.col("card")).when(has_words(url_name(F.col("url")), query), url_name(F.col("url")))
    found = links.filter((own == host) | own.endswith(f".{host}")).withColumn("title", text).filter(F.col("title").isNotNull() & ~product_has_marker(F.col("title"), F.col("url"), label))
    return found.orderBy("position").limit(limit) if limit else found
