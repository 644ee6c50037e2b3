"""Offers, products and stores from the relational tables.

Text of a product or store is normalised once per product or store, before the join
with the offers, not once per offer."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlane.functions.measures import euro_text
from offerlane.functions.text import norm
from offerlane.sources.storage import kept, shared_folder, until_exit

#: A total order of the lines: rows can share order and line number.
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog: product_id, brand, name, size_ml, kind, and normalised forms."""
    p = read(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_brand").alias("brand"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("kind"),
        F.col("p_size").cast("double").alias("size_ml"),
        F.lpad(F.col("p_partkey").cast("string"), 13, "0").alias("gtin"),
        norm("p_name").alias("name_n"),
        norm("p_brand").alias("brand_n"),
    )


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("store_rank"), F.col("s_name").alias("store"), norm("s_name").alias("store_n"))


def price_cents():
    return F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity") + 0.5).cast("bigint")


def offers(spark: SparkSession, sf_dir: str, of_product: dict | None = None, lines: DataFrame | None = None) -> DataFrame:
    """One offer per line: store, product, price in cents and as text, availability,
    time, URL, and the columns of its order. of_product: further columns, by name, that are made of the
    product alone, and so once per product. lines: some of the lines instead of all."""
    lines = read(spark, sf_dir, "lineitem") if lines is None else lines
    known = products(spark, sf_dir).withColumns(of_product or {})
    joined = lines.join(known, F.col("l_partkey") == F.col("product_id")).join(stores(spark, sf_dir), F.col("l_suppkey") == F.col("store_rank"))
    stock = F.when(F.col("l_returnflag") == "N", "in stock").when(F.col("l_returnflag") == "R", "out of stock").otherwise("unknown")
    return joined.withColumns(
        {
            "price_cents": price_cents(),
            "availability": stock,
            "url": F.concat(F.lit("https://s"), F.col("l_suppkey").cast("string"), F.lit(".example.com/p/"), F.col("l_partkey").cast("string")),
        }
    ).withColumn("price", euro_text(F.col("price_cents")))


#: Parts of a store's lines that each give their lowest price to a bound of its first prices.
PARTS = 64


def low_lines(spark: SparkSession, sf_dir: str, per: int) -> DataFrame:
    """Lines that can be among the first per offers of their store by price, nulls last. The lines of a store are dealt
    into PARTS parts; the per-th of their lowest prices bounds its first ones, as so many offers are no dearer. Stores
    with prices in fewer parts keep all lines. The bounds are written. Only key and price of a line are moved for it, and nothing is sorted."""
    lines = read(spark, sf_dir, "lineitem")
    named = stores(spark, sf_dir).select("store_rank", "store")
    part = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(PARTS))
    narrow = lines.select("l_partkey", "l_suppkey", part.alias("part"), price_cents().alias("cents"))
    known = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey")).distinct()
    lowest = narrow.join(known, "l_partkey", "left_semi").join(named, F.col("l_suppkey") == F.col("store_rank")).groupBy("store", "part").agg(F.min("cents").alias("cents"))
    bound = lowest.groupBy("store").agg(F.get(F.sort_array(F.collect_list("cents")), F.lit(per - 1)).alias("bound"))  # PARTS prices at most
    of = named.join(bound, "store", "left").groupBy(F.col("store_rank").alias("l_suppkey")).agg(F.max("bound").alias("bound"), F.bool_or(F.col("bound").isNull()).alias("all"))
    of = kept(of, f"{until_exit(spark, f'{shared_folder(spark)}/bounds-{uuid.uuid4().hex}')}/of")  # its size is known then
    return lines.join(of, "l_suppkey").filter(F.col("all") | (price_cents() <= F.col("bound"))).select(*lines.columns)


# the same, for SQL
OFFERS_SQL = r"""
products as (
  select p_partkey as product_id, p_brand as brand, p_name as name, p_type as kind, p_size::double as size_ml,
         lpad(p_partkey::varchar, 13, '0') as gtin, {norm_name} as name_n, {norm_brand} as brand_n from part),
stores as (select s_suppkey as store_rank, s_name as store, {norm_store} as store_n from supplier),
offers as (
  select l.*, p.*, s.*, floor(l_extendedprice * 100 / l_quantity + 0.5)::bigint as price_cents,
         case l_returnflag when 'N' then 'in stock' when 'R' then 'out of stock' else 'unknown' end as availability,
         'https://s' || l_suppkey || '.example.com/p/' || l_partkey as url
  from lineitem l join products p on l_partkey = product_id join stores s on l_suppkey = store_rank)
"""


def norm_sql(x: str) -> str:
    """norm() in SQL."""
    folded = f"strip_accents(lower(coalesce({x}, '')))"
    parted = f"regexp_replace(regexp_replace({folded}, '([0-9])([a-z])', '\\1 \\2', 'g'), '([a-z])([0-9])', '\\1 \\2', 'g')"
    return f"trim(regexp_replace({parted}, '[^a-z0-9]+', ' ', 'g'))"


OFFERS_SQL = OFFERS_SQL.format(norm_name=norm_sql("p_name"), norm_brand=norm_sql("p_brand"), norm_store=norm_sql("s_name"))
