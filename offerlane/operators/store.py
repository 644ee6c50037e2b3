"""The product index: products, offers and search terms as parquet tables.

Products and offers are changed bucket by bucket (versions.py). Search terms lie in folders by
their first letters, sorted, with the totals that the ranking needs beside them, so a search reads the
files of its prefixes only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlane.functions.text import filled, norm, norm_text
from offerlane.operators import catalog, search_index
from offerlane.operators.dedup import keep_first
from offerlane.operators.versions import BUCKETS, VersionedTable
from offerlane.sources.storage import kept, remove

PRODUCTS = "product_id string, brand_id string, brand_name string, family_name string, concentration string, gender string, aliases array<string>, searchable_text string, updated_at timestamp"
OFFERS = (
    "offer_id string, product_id string, store string, store_product_id string, variant_id string, gtin string, mpn string, sku string, name string, size_ml double, concentration string, "
    "price_cents bigint, currency string, availability string, url string, image string, raw_json string, updated_at timestamp"
)
TERMS = "doc string, doc_len int, term string, tf bigint"


#: Letters of a term that name its folder.
INITIAL = 2


class ProductIndex:
    """buckets: of a table that is made new; as many as keep a bucket's rows to what one task rewrites."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.tables = {
            "products": VersionedTable(spark, f"{self.path}/products", PRODUCTS, "product_id", buckets),
            "offers": VersionedTable(spark, f"{self.path}/offers", OFFERS, "offer_id", buckets),
            "terms": VersionedTable(spark, f"{self.path}/terms", TERMS, "term"),
        }

    def vacuum(self, keep: int = 2) -> int:
        """Removes the data that only older versions have; returns how many folders went."""
        return sum(t.vacuum(keep) for t in self.tables.values())

    def ensure(self) -> None:
        """Renews the search terms if they are missing though there are products, or not of the current columns."""
        m = self.tables["terms"].manifest()
        if (m["notes"].get("schema") != TERMS or not m["notes"].get("docs")) and not self.products().isEmpty():
            self.rebuild_terms()

    def products(self) -> DataFrame:
        return self.tables["products"].read()

    def offers(self) -> DataFrame:
        return self.tables["offers"].read()

    def terms(self) -> DataFrame:
        return self.tables["terms"].read()

    def upsert_products(self, new: DataFrame, order: str | None = None) -> None:
        """Puts catalog rows in by product_id and renews the search terms. Of equal ids
        the last by the column order wins, or without one the last by the rows' own values."""
        text = norm(F.concat_ws(" ", "brand_name", "family_name", F.array_join("aliases", " "), "concentration"))
        rows = new.withColumns({"searchable_text": text, "updated_at": F.current_timestamp(), "_order": F.to_json(F.struct(*new.columns)) if order is None else F.lpad(F.col(order).cast("string"), 20, "0")})
        columns = [c.split()[0] for c in PRODUCTS.split(", ")]
        if self.tables["products"].upsert(rows.select(*columns, "_order"), ["_order"]):
            self.rebuild_terms()

    def upsert_offers(self, offers: DataFrame) -> int:
        """Puts normalised offers in; offers without store or name go. Products they need
        and the table lacks are made. Returns how many offers were accepted."""
        o = offers.filter((F.col("store") != "") & filled(F.col("name")).isNotNull())
        key = catalog.product_key(F.col("catalog_id"), F.col("brand"), F.col("name"))
        o = o.withColumn("product_id", key).withColumn("offer_id", catalog.offer_id(F.col("store"), key, F.col("variant_id"), F.col("size_ml"), F.col("url")))
        columns = [c.split()[0] for c in OFFERS.split(", ")]
        scratch = f"{self.path}/offers-{uuid.uuid4().hex}"
        o = kept(o.withColumn("updated_at", F.current_timestamp()).select(*columns, "ingest_ord", "brand", "gender"), scratch)
        try:
            made = keep_first(o.join(self.products().select("product_id"), "product_id", "left_anti"), ["product_id"], ["ingest_ord", "offer_id"])
            nothing = F.lit(None).cast("string")
            made = made.select("product_id", nothing.alias("brand_id"), F.col("brand").alias("brand_name"), F.col("name").alias("family_name"), "concentration", "gender", F.array("name").alias("aliases"))
            self.upsert_products(made)
            self.tables["offers"].upsert(o, ["ingest_ord"])
            return o.count()
        finally:
            remove(self.spark, scratch)

    def rebuild_terms(self) -> None:
        p = self.products().withColumn("_aliases", F.array_join("aliases", " "))
        terms = search_index.index_terms(p, "product_id", "brand_name", "family_name", "_aliases", "concentration")
        docs, length = p.count(), terms.agg(F.sum("tf")).first()[0] or 0
        self.tables["terms"].replace(terms, F.left("term", F.lit(INITIAL)), {"schema": TERMS, "docs": docs, "length": length})

    def matching_terms(self, query: str) -> DataFrame:
        """The terms that begin with a word of the query, read from the folders and row groups that can have them."""
        m = self.tables["terms"].manifest()
        words = list(dict.fromkeys(norm_text(query).split()))
        if not words or not m["folders"]:
            return self.spark.createDataFrame([], TERMS)
        rows = self.spark.read.schema(f"{TERMS}, _part string").parquet(m["folders"]["all"])
        some = F.lit(False)
        for w in words:
            some = some | (F.col("_part").startswith(w[:INITIAL]) & F.col("term").startswith(w))
        return rows.filter(some).drop("_part")

    def term_totals(self) -> DataFrame:
        """One row: how many products are indexed, and all their words."""
        notes = self.tables["terms"].manifest()["notes"]
        return self.spark.createDataFrame([(notes.get("docs", 0), notes.get("length", 0))], "n_all long, len_all long")

    def search(self, query: str, limit: int = 20) -> DataFrame:
        """Products for a query, best first."""
        found = search_index.ranked(self.matching_terms(query), query, self.term_totals())
        p = self.products()
        return found.join(p, F.col("doc") == F.col("product_id")).orderBy("score", "brand_name", "family_name", "product_id").limit(max(1, limit)).drop("doc", "score")

    def autocomplete(self, query: str, limit: int = 8) -> DataFrame:
        return self.search(query, limit)

    def get_offers(self, product_id: str, size_ml: float | None = None) -> DataFrame:
        """Offers of a product, of one size if given: priced ones first, by price and store."""
        found = self.offers().filter(F.col("product_id") == product_id)
        if size_ml is not None:
            found = found.filter(F.col("size_ml") == float(size_ml))
        return found.drop("raw_json").orderBy(F.col("price_cents").asc_nulls_last(), "store", "offer_id")

    def product_with_offers(self, product_id: str) -> DataFrame:
        p = self.products().filter(F.col("product_id") == product_id)
        return catalog.with_offers(p, self.get_offers(product_id), "product_id", ["price_cents", "store", "url", "size_ml", "availability"])

    def stats(self) -> DataFrame:
        return catalog.counts(self.products(), self.offers())


def build_index(spark: SparkSession, catalog_path: str, offers: DataFrame | None, path: str) -> DataFrame:
    """An index of a catalog file and normalised offers at path; gives its counts."""
    from offerlane.sources.offers import load_catalog

    index = ProductIndex(spark, path)
    index.upsert_products(load_catalog(spark, catalog_path, strict=True))
    if offers is not None:
        index.upsert_offers(offers)
    index.ensure()
    return index.stats()
