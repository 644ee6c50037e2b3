"""Raw offers: one nullable schema, and columns read out of it.

A value can stand at top level or in a block, bare or with its provenance. Missing
and blank are the same: every accessor gives the first filled value, or null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlane.functions import classify, measures
from offerlane.functions.text import filled, norm

_WRAPPED = "struct<value:string,source:string>"
# Names of the fields that offers come with.
_FLAT = (
    "store name title product_name canonical_name brand manufacturer maker source_brand canonical_brand price url image image_url thumbnail size format volume size_ml volume_ml format_ml "
    "product_line variant pack_size concentration currency availability catalog_id product_identity master_id item_group_id product_id store_product_id store_variant_id variant_id "
    "gtin ean ean13 barcode upc mpn sku"
).split()
#: DDL of the raw schema: flat fields, then blocks. ingest_ord is the order of arrival.
RAW_SCHEMA = ", ".join(
    [
        "ingest_ord bigint",
        *(f"{c} string" for c in _FLAT),
        "available boolean",
        "source struct<source_name:string,source_brand:string,name:string,brand:string,title:string,manufacturer:string,store:string,url:string,source_page:string,image:string>",
        f"identity struct<gtin:{_WRAPPED},mpn:{_WRAPPED},sku:{_WRAPPED},store_product_id:{_WRAPPED},store_variant_id:{_WRAPPED}>",
        f"attributes struct<size_ml:{_WRAPPED},concentration:{_WRAPPED},gender:{_WRAPPED},product_line:{_WRAPPED},packaging_type:{_WRAPPED}>",
        "offer struct<price:string,currency:string,availability:string>",
        "provenance map<string,string>",
        "raw_data string",
    ]
)


def field(*names: str) -> Column:
    """The first filled of some fields; a dot leads into a block."""
    return filled(*(F.col(n) for n in names))


def identifier(*names: str) -> Column:
    """The first filled identifier at top level, then in the identity block."""
    inner = [f"identity.{n}.value" for n in names if n in ("gtin", "mpn", "sku", "store_product_id", "store_variant_id")]
    return field(*names, *inner)


def name() -> Column:
    return field("canonical_name", "name", "title", "product_name", "source.source_name", "source.name", "source.title")


def brand() -> Column:
    return field("canonical_brand", "brand", "manufacturer", "maker", "source.source_brand", "source.brand", "source.manufacturer")


def search_text() -> Column:
    """All descriptive fields as one normalised text."""
    parts = ["name", "title", "product_name", "brand", "source_brand", "url", "product_line", "variant", "size", "size_ml", "volume", "volume_ml", "format", "format_ml", "pack_size"]
    parts += [f"attributes.{a}.value" for a in ("size_ml", "concentration", "gender", "product_line", "packaging_type")]
    parts += [f"source.{s}" for s in ("source_name", "source_brand", "name", "brand")]
    return norm(F.concat_ws(" ", *(F.col(p) for p in parts)))


def size_ml() -> Column:
    explicit = field("size_ml", "volume_ml", "format_ml", "attributes.size_ml.value")
    return measures.offer_size(explicit, F.concat_ws(" ", "name", "title", "product_name", "size", "format", "volume", "source.source_name"))


def concentration() -> Column:
    own = field("concentration", "attributes.concentration.value")
    return F.coalesce(F.nullif(norm(own), F.lit("")), F.lower(classify.concentration(F.concat_ws(" ", "name", "title", "product_name"))))


def as_raw(rows: DataFrame, *keep: str) -> DataFrame:
    """Rows with some of the raw columns as whole raw rows; of other columns those named stay."""
    spark = rows.sparkSession
    whole = spark.createDataFrame([], RAW_SCHEMA)
    known = [F.col(c).cast(whole.schema[c].dataType).alias(c) if c in whole.columns else F.col(c) for c in rows.columns if c in whole.columns or c in keep]
    return whole.unionByName(rows.select(*known), allowMissingColumns=True)


def normalized(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw rows as offers: fixed columns, normalised forms, price in cents with prices
    per 100 ml resolved, and the whole raw row as JSON. keep: columns to carry along."""
    size = size_ml()
    text = field("price", "offer.price")
    price = F.coalesce(measures.actual_price(text, size), measures.parse_price(text))
    url = field("url", "source.url", "source.source_page")
    return raw.select(
        "ingest_ord",
        F.coalesce(field("store", "source.store"), F.lit("")).alias("store"),
        name().alias("name"),
        brand().alias("brand"),
        norm(name()).alias("name_n"),
        norm(brand()).alias("brand_n"),
        norm(field("store", "source.store")).alias("store_n"),
        field("catalog_id", "product_identity", "master_id", "item_group_id").alias("catalog_id"),
        identifier("store_variant_id", "variant_id").alias("variant_id"),
        identifier("store_product_id", "product_id", "catalog_id").alias("store_product_id"),
        identifier("gtin", "ean", "ean13", "barcode", "upc").alias("gtin"),
        identifier("mpn").alias("mpn"),
        identifier("sku").alias("sku"),
        size.alias("size_ml"),
        concentration().alias("concentration"),
        classify.gender(F.concat_ws(" ", name(), field("attributes.gender.value"))).alias("gender"),
        measures.cents(price).alias("price_cents"),
        F.coalesce(field("currency", "offer.currency"), F.lit("EUR")).alias("currency"),
        classify.availability(field("offer.availability", "availability"), F.col("available")).alias("availability"),
        url.alias("url"),
        field("image", "image_url", "thumbnail", "source.image").alias("image"),
        search_text().alias("search_text"),
        F.to_json(F.struct(*(F.col(c) for c in raw.columns if c not in keep))).alias("raw_json"),
        *keep,
    )


def identity(offers: DataFrame) -> DataFrame:
    """offers with the key that tells them apart."""
    from offerlane.operators.dedup import identity_key

    c = F.col
    return offers.withColumn("identity", identity_key(c("store"), c("name"), c("variant_id"), c("store_product_id"), c("gtin"), c("sku"), c("size_ml"), c("concentration")))


_PRODUCT = (
    "product_id:string,brand_id:string,brand_name:string,family_name:string,concentration:string,gender:string,aliases:array<string>,"
    "formats_ml:array<string>,gtins:array<string>,ean:array<string>,mpns:array<string>,mpn:array<string>"
)


def load_catalog(spark, path: str, strict: bool = False) -> DataFrame:
    """Products of a catalog file {"products": [...]}: rows without id or family name
    go, text is cleaned, blank is null, aliases are distinct; formats_ml, gtins and mpns are arrays.
    strict: no products is an error, and rows have catalog_id, brand and name as well."""
    from offerlane.functions.text import clean

    file = spark.read.schema(f"products array<struct<{_PRODUCT}>>").json(path, multiLine=True)
    if strict and file.filter("products is not null").isEmpty():
        raise ValueError(f"{path} has no list of products")
    rows = file.selectExpr("inline(products)")
    texts = lambda *names: F.array_distinct(F.filter(F.transform(F.coalesce(*(F.col(n) for n in names), F.array().cast("array<string>")), clean), lambda x: x != ""))
    blank = {c: F.nullif(clean(F.col(c)), F.lit("")) for c in ("product_id", "brand_id", "brand_name", "family_name", "concentration", "gender")}
    sizes = F.filter(F.transform(texts("formats_ml"), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    lists = {"aliases": texts("aliases"), "formats_ml": sizes, "gtins": texts("gtins", "ean"), "mpns": texts("mpns", "mpn")}
    found = rows.withColumns(blank).withColumns(lists).drop("ean", "mpn").filter("product_id is not null and family_name is not null")
    if strict:
        found = found.withColumns({"catalog_id": F.col("product_id"), "brand": F.col("brand_name"), "name": F.col("family_name")})
    return found
