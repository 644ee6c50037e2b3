"""More registered queries: keys and ids, money and sizes as text, documents of shop
platforms, sitemaps, catalog search, product pages and the counters of a refresh."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlane.functions import measures, text
from offerlane.functions.classify import reject_reason
from offerlane.operators import dedup, search_index
from offerlane.operators.store import ProductIndex
from offerlane.plans import engine
from offerlane.plans.registry import _BARRED, _BM25_SQL, _ORDER_SQL, ORACLE_SQL, PREFIXES, _query
from offerlane.sources import discovery, stores, tables
from offerlane.sources.offers import normalized
from offerlane.sources.storage import kept, shared_folder, until_exit
from offerlane.sources.tables import LINE_ORDER, OFFERS_SQL, norm_sql
from offerlane.streaming.kept_history import PriceHistory
from offerlane.vocabulary import NON_PERFUME


@_query(
    f"""with {OFFERS_SQL}, o as (select *, case product_id % 5 when 0 then 'variant' when 1 then 'product' when 2 then 'gtin' when 3 then 'sku' else 'fallback' end as id_kind from offers),
k as (select *, case id_kind when 'variant' then 'v ' || product_id when 'product' then product_id || '|' || name_n when 'gtin' then gtin when 'sku' then 's ' || product_id else name_n || '|' || size_ml::varchar || '|' end as rest from o)
select store, id_kind as kind, rest, l_orderkey, l_linenumber from k qualify row_number() over (partition by store_n, id_kind, rest order by {_ORDER_SQL}) = 1"""
)
def offer_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first offer of each identity: variant, product, article number, stock number, or name with size."""
    k, number = F.col("product_id") % 5, F.col("product_id").cast("string")
    own = lambda n, c: F.when(k == n, text.norm(c))  # noqa: E731  # once per product
    ids = {"variant_n": own(0, F.concat(F.lit("v "), number)), "own_n": own(1, number), "gtin_n": own(2, F.col("gtin")), "sku_n": own(3, F.concat(F.lit("s "), number))}
    o = tables.offers(spark, sf_dir, ids)
    key = dedup.identity_key(F.col("store_n"), F.col("name_n"), F.col("variant_n"), F.col("own_n"), F.col("gtin_n"), F.col("sku_n"), F.col("size_ml"), F.lit(None).cast("string"), plain=True)
    first = dedup.keep_first(o.withColumn("identity", key), ["identity"], LINE_ORDER)
    kind = F.col("identity.kind")
    rest = F.when(kind == "product", F.concat_ws("|", "identity.a", "identity.b")).when(kind == "fallback", F.concat_ws("|", "identity.a", "identity.b", "identity.c")).otherwise(F.col("identity.a"))
    return first.select("store", kind.alias("kind"), rest.alias("rest"), "l_orderkey", "l_linenumber")


@_query(
    f"""with {OFFERS_SQL} select store, product_id, name, size_ml, price_cents, l_orderkey, l_linenumber from offers
where not {_BARRED} and contains(' ' || name_n || ' ', ' red ') and size_ml > 10
qualify row_number() over (partition by store_n, product_id, name_n order by {_ORDER_SQL}) = 1"""
)
def search_sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A validated search that knows sizes: samples go, as the query names no size."""
    unique = dedup.keep_first(tables.offers(spark, sf_dir), ["store_n", "product_id", "name_n"], LINE_ORDER)
    found = unique.filter(reject_reason("red", F.col("name_n"), F.col("size_ml"), text.norm(F.concat_ws(" ", "name", "brand"))).isNull())
    return found.select("store", "product_id", "name", "size_ml", "price_cents", "l_orderkey", "l_linenumber")


@_query(f"select b.doc as product_id, p_name as name, p_brand as brand from ({_BM25_SQL}) b join part on p_partkey = b.doc order by b.score_millionths, brand, name, product_id limit 20")
def search_index_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search_products through an index on disk, from the files of the prefixes: all products are put in, in two changes."""
    p = tables.products(spark, sf_dir)
    index = ProductIndex(spark, until_exit(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"), 8)
    nothing = F.lit(None).cast("string")
    catalog = p.select(F.col("product_id").cast("string").alias("product_id"), nothing.alias("brand_id"), F.lit("").alias("brand_name"), F.col("name").alias("family_name"), F.col("kind").alias("concentration"), nothing.alias("gender"), F.array().cast("array<string>").alias("aliases"))
    index.upsert_products(catalog.filter("product_id % 2 = 0"))
    index.upsert_products(catalog)
    found = search_index.ranked(index.matching_terms(PREFIXES), PREFIXES, index.term_totals())
    rows = found.join(p, F.col("doc") == F.col("product_id").cast("string")).withColumn("score_millionths", F.floor(F.col("score") * 1000000 + 0.5).cast("bigint"))
    return rows.orderBy("score_millionths", "brand", "name", "product_id").limit(20).select("product_id", "name", "brand")


@_query(f"select b.doc as product_id, p_name as name, p_brand as brand, b.score_millionths from ({_BM25_SQL}) b join part on p_partkey = b.doc order by score_millionths, brand, name, product_id limit 20")
def search_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best products of a catalog for the beginnings of words."""
    p = tables.products(spark, sf_dir)
    found = search_index.search(search_index.index_terms(p, "product_id", "name", "kind"), p, "product_id", PREFIXES)
    rows = found.join(p, F.col("doc") == F.col("product_id")).withColumn("score_millionths", F.floor(F.col("score") * 1000000 + 0.5).cast("bigint"))
    return rows.select("product_id", "name", "brand", "score_millionths").orderBy("score_millionths", "brand", "name", "product_id").limit(20)


@_query(
    """select p_partkey, (p_retailprice * 100)::bigint * 1000 + p_size as cents, ((p_retailprice * 100)::bigint * 1000 + p_size) // 100 as whole from part"""
)
def money_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts written with either separator, read back: the last separator is the decimal one."""
    p = tables.read(spark, sf_dir, "part").withColumn("c", F.round(F.col("p_retailprice") * 100).cast("bigint") * 1000 + F.col("p_size"))
    whole, rest = F.floor(F.col("c") / 100).cast("bigint"), F.lpad((F.col("c") % 100).cast("string"), 2, "0")
    grouped = F.regexp_replace(F.format_number(whole, 0), ",", ".")
    way = F.col("p_partkey") % 4
    written = (
        F.when(way == 0, F.concat(grouped, F.lit(","), rest, F.lit(" €"))).when(way == 1, F.concat(F.lit("EUR "), F.format_number(whole, 0), F.lit("."), rest))
        .when(way == 2, F.concat(whole.cast("string"), F.lit(","), rest)).otherwise(F.concat(F.lit("$"), whole.cast("string"), F.lit("."), rest))
    )
    cents = measures.cents(measures.money(written))
    return p.select("p_partkey", cents.alias("cents"), F.floor(cents / 100).cast("bigint").alias("whole"))


_HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1))"


@_query(
    rf"""with u as (select page_id, lower(string_split(string_split(url, '#')[1], '?')[1]) as url from pages)
select page_id, url as url_key, trim(regexp_replace(list_last(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '/+$', ''), '/')), '[^a-z0-9]+', ' ', 'g')) as words,
  regexp_replace({_HOST}, '^www\.', '') = 'example.com' or ends_with(regexp_replace({_HOST}, '^www\.', ''), '.example.com') as own_host from u"""
)
def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of pages as keys, the words of their last part, and whether they are on a host."""
    p = tables.read(spark, sf_dir, "pages")
    raw = F.concat(F.lit(" "), F.upper("url"), F.lit("?q="), F.col("page_id").cast("string"), F.lit("#top"))
    return p.select("page_id", text.url_key(raw).alias("url_key"), text.url_name(raw).alias("words"), text.same_host(F.col("url"), "example.com").alias("own_host"))


@_query(
    """select p_partkey, replace(replace(rtrim(to_base64(encode(p_brand || ' ' || p_name || ' ~' || p_partkey)), '='), '+', '-'), '/', '_') as code, p_brand || ' ' || p_name || ' ~' || p_partkey as query from part"""
)
def job_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries put into job ids and read back."""
    p = tables.read(spark, sf_dir, "part")
    code = text.encode_query(F.concat(F.col("p_brand"), F.lit(" "), F.col("p_name"), F.lit(" ~"), F.col("p_partkey").cast("string")))
    return p.select("p_partkey", code.alias("code"), text.decode_query(F.concat(F.lit("a.b."), code)).alias("query"))


@_query(
    f"""with {OFFERS_SQL} select distinct 'SH-AUTO-' || substr(sha1(brand_n || '::' || name_n), 1, 12) as auto_id, store_n as store, 'c' || product_id % 100 as identity,
case when size_ml = floor(size_ml) then floor(size_ml)::bigint::varchar else size_ml::varchar end as size, url from offers"""
)
def offer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tells matched offers apart, and the ids made of brands and names."""
    cid = F.concat(F.lit("c"), (F.col("product_id") % 100).cast("string"))
    o = tables.offers(spark, sf_dir, {"identity_n": text.norm(cid), "auto_id": text.auto_id(F.col("brand"), F.col("name"))})
    key = dedup.offer_key(F.col("store_n"), F.col("identity_n"), F.col("size_ml"), F.concat("url", F.lit("?ref=1")), plain=True)
    rows = o.select("auto_id", key.alias("k"))
    return rows.select("auto_id", "k.store", F.replace(F.col("k.identity"), F.lit(" ")).alias("identity"), "k.size", "k.url").distinct()


@_query(
    f"""with {OFFERS_SQL}, j as (select product_id, product_id - product_id % 7 as asked, brand_n || ' ' || name_n as query from products),
o as (select o.store, o.name_n, o.product_id - o.product_id % 7 as asked from offers o),
r as (select o.store, list_bool_and(list_transform(list_filter(string_split(j.query, ' '), lambda w: length(w) >= 2), lambda w: contains('brand ' || o.name_n, w))) as accepted
  from o join j on j.product_id = o.asked)
select store, count(*) as found, count_if(accepted)::bigint as accepted, (count(*) - count_if(accepted))::bigint as rejected from r group by rollup (store)"""
)
def refresh_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers fetched for the products of a catalog (here of every seventh product for it
    and the six after it), and how many of them have all its words, per store and in total."""
    p = tables.products(spark, sf_dir)
    jobs = p.select("product_id", F.concat_ws(" ", "brand_n", "name_n").alias("query"))
    jobs = jobs.withColumn("words", F.filter(F.split("query", " "), lambda w: F.length(w) >= 2))
    fetched = tables.offers(spark, sf_dir).select("store", F.concat(F.lit("brand "), F.col("name_n")).alias("search_text"), (F.col("product_id") - F.col("product_id") % 7).alias("asked"))
    rows = engine.refresh_rows(fetched.join(jobs.select(F.col("product_id").alias("asked"), "query").distinct(), "asked"), jobs)
    return engine.refresh_counts(rows.filter(F.col("product_id") == F.col("asked")))


@_query(
    f"""with {OFFERS_SQL} select product_id, count(*) as n_offers, min(price_cents) as lowest, arg_min(store, (price_cents, store_n, name_n, url, {_ORDER_SQL})) as best_store,
arg_min(case when l_suppkey % 3 = 0 then url || '.png' end, (price_cents, store_n, name_n, url, {_ORDER_SQL})) filter (where l_suppkey % 3 = 0) as image from offers group by product_id"""
)
def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each product the number of offers, the lowest price, its store, and the first image in price order."""
    known = tables.stores(spark, sf_dir)
    lines = tables.read(spark, sf_dir, "lineitem").join(known.select(F.col("store_rank").alias("l_suppkey")), "l_suppkey")
    # keys and prices are dealt by product once; only lines at a lowest price get names. One product's URL names its store, so
    # what is left of the order doesn't change the store or image
    lines = lines.select("l_partkey", "l_suppkey", tables.price_cents().alias("cents")).repartition("l_partkey")
    pictured = F.col("l_suppkey") % 3 == 0
    low = lines.groupBy("l_partkey").agg(F.count("*").alias("n"), F.min("cents").alias("lowest"), F.min(F.when(pictured, F.col("cents"))).alias("low_image"))
    tied = lines.join(low.hint("shuffle_hash"), "l_partkey")
    is_first, is_image = F.col("cents").eqNullSafe(F.col("lowest")), pictured & F.col("cents").eqNullSafe(F.col("low_image"))  # null where no line has a price
    tied = tied.withColumns({"is_first": is_first, "is_image": is_image}).filter("is_first OR is_image").join(known, F.col("l_suppkey") == F.col("store_rank"))
    url = F.concat(F.lit("https://s"), F.col("l_suppkey").cast("string"), F.lit(".example.com/p/"), F.col("l_partkey").cast("string"))
    order = F.struct("store_n", url.alias("url"))
    best = tied.groupBy("l_partkey").agg(
        F.first("n").alias("n"), F.first("lowest").alias("lowest"), F.min_by("store", F.when(F.col("is_first"), order)).alias("best_store"),
        F.min_by(F.concat(url, F.lit(".png")), F.when(F.col("is_image"), order)).alias("image"),
    )
    copies = tables.read(spark, sf_dir, "part").groupBy(F.col("p_partkey").alias("product_id")).agg(F.count("*").alias("copies"))
    return best.join(copies, F.col("l_partkey") == F.col("product_id")).select("product_id", (F.col("n") * F.col("copies")).alias("n_offers"), "lowest", "best_store", "image")


@_query(
    """with p as (select p_partkey, p_name, p_size, (p_retailprice * 100)::bigint as c from part),
v as (select p_partkey, p_name as name, unnest([0, 1, 2]) as variant_no, c, p_size from p)
select p_partkey, name, variant_no, (c + variant_no)::bigint as price_cents, variant_no < p_size % 4 as available, p_partkey || '00' || variant_no as gtin,
       case when p_size % 4 = 0 then 0 else c end::bigint as least_cents from v"""
)
def platform_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product documents of a shop platform: their variants, and the least price of those available."""
    p = tables.read(spark, sf_dir, "part").withColumn("c", F.round(F.col("p_retailprice") * 100).cast("bigint"))
    variant = lambda i: F.struct(F.lit(i).alias("id"), F.concat(F.col("p_partkey").cast("string"), F.lit("-00"), i.cast("string")).alias("barcode"), (F.col("c") + i).alias("price"), (i < F.col("p_size") % 4).alias("available"))
    doc = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.transform(F.sequence(F.lit(0), F.lit(2)), variant).alias("variants")))
    docs = p.select("p_partkey", F.lit("https://a.example/products/x").alias("url"), doc.alias("json"))
    least = discovery.platform_offers(docs).select("p_partkey", F.coalesce("price_cents", F.lit(0)).alias("least_cents"))
    rows = discovery.platform_variants(docs).select("p_partkey", "name", "variant_no", "price_cents", "available", "gtin")
    return rows.join(least, "p_partkey")


@_query(
    """with p as (select p_partkey, p_name, p_brand from part)
select p_partkey, 0 as position, p_name as name, p_brand as brand, 'id' || p_partkey as catalog_id from p
union all select p_partkey, 1, p_name || ' two', null, null from p where p_partkey % 2 = 0"""
)
def outer_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products in the answers of an outer catalog, in their several forms."""
    p = tables.read(spark, sf_dir, "part")
    one = F.to_json(F.struct(F.col("p_name").alias("Name"), F.col("p_brand").alias("Brand"), F.concat(F.lit("id"), F.col("p_partkey").cast("string")).alias("_id")))
    two = F.to_json(F.struct(F.concat("p_name", F.lit(" two")).alias("name")))
    even = F.concat(F.lit('{"results": ['), one, F.lit(", "), two, F.lit(', {"x": 1}]}'))
    docs = p.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, even).otherwise(F.concat(F.lit("["), one, F.lit("]"))).alias("json"))
    return discovery.catalog_suggestions(docs).select("p_partkey", "position", "name", "brand", "catalog_id")


#: Pages that one sitemap lists, and product numbers that one search page lists products of.
MAP, LISTED = 1000, 800


@_query(
    f"""with h as (select regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) as host, url, page_id from pages),
d as (select host, url, min(page_id) as page_id from h group by host, url)
select host, url as location, (row_number() over (partition by host order by page_id) - 1)::int as position from d"""
)
def sitemap_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages listed by the sitemaps of their hosts: maps of at most MAP pages, named by an index map per
    thousand maps, which an index of the host names. Three levels, read by sitemap_tree()."""
    p = tables.read(spark, sf_dir, "pages").withColumn("host", F.regexp_extract("url", "^([A-Za-z]+://[^/?#]+)", 1)).withColumn("map", F.floor(F.col("page_id") / MAP))
    escaped = lambda x: F.replace(x, F.lit("&"), F.lit("&amp;"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("page_id", "url"))), lambda x: F.concat(F.lit("<url><loc> "), escaped(x["url"]), F.lit(" </loc></url>")))
    at = F.format_string("%s/sitemap-%012d.xml", F.col("host"), F.col("map"))
    maps = p.groupBy("host", "map").agg(F.concat(F.lit("<urlset>"), F.array_join(listed, "\n"), F.lit("</urlset>")).alias("xml")).select("host", "map", at.alias("url"), "xml")

    def index(rows: DataFrame, group: Column, name: Column) -> DataFrame:
        named = F.array_join(F.transform(F.sort_array(F.collect_list("url")), lambda x: F.concat(F.lit("<sitemap><loc>"), x, F.lit("</loc></sitemap>"))), "")
        found = rows.withColumn("map", group).groupBy("host", "map").agg(F.concat(F.lit("<sitemapindex>"), named, F.lit("</sitemapindex>")).alias("xml"))
        return found.select("host", "map", name.alias("url"), "xml")

    second = index(maps, F.floor(F.col("map") / MAP), F.format_string("%s/sitemap-index-%012d.xml", F.col("host"), F.col("map")))
    top = index(second, F.lit(0), F.concat("host", F.lit("/sitemap.xml")))
    documents = maps.unionByName(second).unionByName(top).select("url", "xml")
    found = discovery.sitemap_tree(documents, top.select(F.col("url").alias("root")))
    found = found.select(F.regexp_replace("root", "/sitemap.xml$", "").alias("host"), "location", "place")
    placed = dedup.position_in(found, ["host"], F.slice("place", F.lit(1), F.size("place") - 1), ["place"], "position")
    return placed.select("host", "location", "position")


@_query(ORACLE_SQL["price_history_changes"])
def price_history_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """price_history_changes as a kept history gives it that takes the points in by years."""
    lines = tables.read(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", tables.price_cents().alias("c"), "l_suppkey")
    # most days of a product have one line, so nothing is gained by sorting them before they are dealt
    days = lines.repartition("l_partkey", "l_shipdate").groupBy("l_partkey", "l_shipdate").agg(F.min(F.struct("c", "l_suppkey")).alias("best"))
    folder = until_exit(spark, f"{shared_folder(spark)}/history-{uuid.uuid4().hex}")
    points = days.select(F.col("l_partkey").cast("string").alias("key"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("best.c").cast("double").alias("value"), F.col("best.l_suppkey").cast("string").alias("store"))
    points = kept(points.withColumn("year", F.year("ts")), f"{folder}/points")
    history = PriceHistory(spark, f"{folder}/kept")
    for batch, row in enumerate(points.select("year").distinct().orderBy("year").collect()):  # a few years
        history.update(points.filter(F.col("year") == row["year"]), batch)
    day = tables.read(spark, sf_dir, "lineitem").schema["l_shipdate"].dataType
    kept_points = history.load()
    return kept_points.select(F.col("key").cast("bigint").alias("l_partkey"), F.col("ts").cast(day).alias("l_shipdate"), F.col("value").cast("bigint").alias("price_cents"), F.col("store").cast("bigint").alias("store_rank"))


_FOUND = "list_has_all(string_split(p.name_n, ' '), string_split(q.name_n, ' '))"


@_query(
    f"""with {OFFERS_SQL}, q as (select distinct name_n, name from products where name_n = lower(name)),
f as (select q.name as query, p.product_id, p.name, (p_retailprice * 100)::bigint as price_cents from q join products p on {_FOUND} join part on p_partkey = p.product_id),
z as (select *, row_number() over (partition by query order by replace(name, ' ', '-') || '-' || lpad(product_id::varchar, 12, '0') || '_z' || product_id) as r from f)
select 'Deloox' as store, query, name, price_cents, 'in stock' as availability, product_id::varchar as code from f
union all select 'Bplatz', query, name, case when product_id % 3 = 0 then 0 else price_cents end, case when product_id % 3 = 0 then 'out of stock' else 'in stock' end, null from f
union all select 'ParfumZentrum', query, name, price_cents, 'in stock', product_id::varchar from z where r <= 24"""
)
def store_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches for the name of each product at three stores: by links of search pages and product pages, by
    cards and product documents, and by sitemaps. The documents are made of the catalog; a search page lists those of
    LISTED product numbers that have the name, or some that begin with its first word. Without a price it is 0."""
    p = tables.products(spark, sf_dir).join(tables.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.round(F.col("p_retailprice") * 100).cast("bigint").alias("cents")), "product_id")
    jobs = p.filter(F.col("name_n") == F.lower("name")).select(F.col("name").alias("query"), F.col("name_n").alias("q")).distinct()
    number, slug = F.col("product_id").cast("string"), F.replace(F.col("name"), F.lit(" "), F.lit("-"))
    text = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    amount = F.format_string("%d.%02d", F.floor(F.col("cents") / 100).cast("bigint"), F.col("cents") % 100)
    p = p.withColumns({
        "at_deloox": text("https://www.deloox.nl/product/", number, "/", slug, ".html"), "at_bplatz": text("https://bplatz.de/products/", slug, "-", number),
        "at_zentrum": text("https://www.parfum-zentrum.de/", slug, "-", F.lpad(number, 12, "0"), "_z", number), "first": F.split("name_n", " ")[0], "chunk": F.floor(F.col("product_id") / LISTED),
    })
    ld = F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("name").alias("name"), number.alias("sku"), F.struct(amount.alias("price"), F.lit("EUR").alias("priceCurrency"), F.lit("InStock").alias("availability")).alias("offers")))
    html = text("<html><head><script type='application/ld+json'>", ld, "</script></head><body><h1>", F.col("name"), "</h1></body></html>")
    doc = F.to_json(F.struct(number.alias("id"), F.col("name").alias("title"), F.array(F.struct(F.lit("1").alias("id"), F.col("cents").alias("price"), (F.col("product_id") % 3 != 0).alias("available"))).alias("variants")))
    none = F.lit(None).cast("string")
    row = lambda df, store, kind, query, url, body: df.select(F.lit(store).alias("store"), F.lit(kind).alias("kind"), query.alias("query"), url.alias("url"), body.alias("body"))
    documents = row(p, "Deloox", "page", none, F.col("at_deloox"), html).unionByName(row(p, "ParfumZentrum", "page", none, F.col("at_zentrum"), html)).unionByName(row(p, "Bplatz", "json", none, F.col("at_bplatz"), doc))
    listed = lambda url, label: F.array_join(F.sort_array(F.collect_list(text("<div><a href='", F.col(url), "'>", label, "</a> <i>", F.col("name"), "</i></div>"))), "")
    # a search page for a name lists its products, one for a word every eighth product that begins with it
    keyed = p.withColumn("key", F.explode(F.when(F.col("product_id") % 8 == 0, F.array("name_n", "first")).otherwise(F.array("name_n"))))
    chunks = keyed.groupBy("key", "chunk").agg(listed("at_deloox", F.lit("more")).alias("deloox"), listed("at_bplatz", F.lit("more")).alias("bplatz"))
    shown = jobs.withColumn("key", F.explode(F.array(F.col("q"), F.split("q", " ")[0]))).join(chunks, "key")
    for store, host in (("deloox", "https://www.deloox.nl"), ("bplatz", "https://bplatz.de")):
        documents = documents.unionByName(row(shown, store.title(), "search", F.col("query"), text(host, "/search?page=", F.col("chunk").cast("string"), "&q=", F.col("key")), text("<body>", F.col(store), "</body>")))
    maps = p.groupBy(F.floor(F.col("product_id") / MAP).alias("map")).agg(F.array_join(F.collect_list(text("<url><loc>", F.col("at_zentrum"), "</loc></url>")), "").alias("x"))
    documents = documents.unionByName(row(maps, "ParfumZentrum", "sitemap", none, text("https://www.parfum-zentrum.de/", F.col("map").cast("string"), ".xml"), text("<urlset>", F.col("x"), "</urlset>")))
    folder = until_exit(spark, f"{shared_folder(spark)}/fetched-{uuid.uuid4().hex}")
    found = normalized(stores.store_offers(kept(jobs, f"{folder}/jobs"), kept(documents, f"{folder}/documents")), ("query",))
    return found.select("store", "query", "name", F.coalesce("price_cents", F.lit(0)).alias("price_cents"), "availability", F.col("sku").alias("code"))


_MARKED = " or ".join("list_has_all(w, [" + ", ".join(f"'{w}'" for w in text.norm_text(m).split()) + "])" for m in NON_PERFUME)
_TAIL = "case p_partkey % 5 when 0 then ' Gift Big Set' when 1 then ' 50 ml' when 2 then ' After-Shave 5 cl' when 3 then ' Tester' else '' end"


@_query(
    rf"""with t as (select p_partkey, string_split({norm_sql("p_name || " + _TAIL)}, ' ') as w from part)
select p_partkey, {_MARKED} as marked, case p_partkey % 5 when 1 then true when 2 then true else false end as fits from t"""
)
def marked_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products that are sets, samples or other kinds by the words of their names, and those of a size asked for."""
    k = F.col("p_partkey") % 5
    tail = F.when(k == 0, " Gift Big Set").when(k == 1, " 50 ml").when(k == 2, " After-Shave 5 cl").when(k == 3, " Tester").otherwise("")
    p = tables.read(spark, sf_dir, "part").withColumn("label", F.concat("p_name", tail))
    return p.select("p_partkey", discovery.has_marker(F.col("label")).alias("marked"), discovery.size_fits(F.col("label"), F.lit("foo 50 ml")).alias("fits"))
