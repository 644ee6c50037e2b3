"""Diagnostics: what each store gives for a query, where it is lost, and which stores fail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlane.functions.classify import reject_reason
from offerlane.operators.dedup import keep_first
from offerlane.plans.engine import Engine
from offerlane.sources import connectors

SUMMARY = "store attempt_no raw_index name brand url price_cents availability size_ml concentration store_product_id variant_id gtin sku".split()


def candidates(spark: SparkSession, query: str, names: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Every raw candidate of every store and attempt, summarised: SUMMARY, its identity,
    whether it is the one of its identity that is kept, and why it is rejected (null: it matches)."""
    run = Engine(spark, names).run(query).start()
    run.wait()
    rows, errors = run.rows(), run.errors()
    rows = rows.withColumnRenamed("ingest_ord", "raw_index").withColumn("reason", reject_reason(query, F.col("name_n"), F.col("size_ml"), F.col("search_text")))
    order = ["attempt_no", "raw_index", "url"]
    first = keep_first(rows, ["identity"], ["store_rank", *order]).select("identity", *(F.col(c).alias(f"kept_{c}") for c in order))
    kept = F.lit(True)
    for c in order:
        kept = kept & F.col(c).eqNullSafe(F.col(f"kept_{c}"))
    return rows.join(first, "identity").select(*SUMMARY, "identity", kept.alias("kept"), F.col("kept_url"), "reason"), errors


def duplicates(found: DataFrame) -> DataFrame:
    """Candidates that go as duplicates, with the URL of the one that is kept for them."""
    return found.filter(~F.col("kept")).select("store", "name", "url", "kept_url")


def store_funnel(found: DataFrame, errors: dict[str, str], names: list[str]) -> DataFrame:
    """Per store: raw, unique, duplicates, matched, rejected, error. Stores without a candidate are in it too."""
    spark = found.sparkSession
    n = found.groupBy("store").agg(
        F.count("*").alias("raw"), F.count_if("kept").alias("unique"), F.count_if(~F.col("kept")).alias("duplicates"),
        F.count_if(F.col("kept") & F.col("reason").isNull()).alias("matched"), F.count_if(F.col("kept") & F.col("reason").isNotNull()).alias("rejected"),
    )
    stores = spark.createDataFrame([(s, errors.get(s)) for s in names], "store string, error string")
    return stores.join(n, "store", "left").fillna(0, ["raw", "unique", "duplicates", "matched", "rejected"])


def roll_up(funnel: DataFrame) -> DataFrame:
    """One row: totals, and the stores without candidates, without matches, and with errors."""
    sums = [F.sum(c).alias(c) for c in ("raw", "unique", "duplicates", "matched", "rejected")]
    listed = lambda some, name: F.sort_array(F.collect_list(F.when(some, F.col("store")))).alias(name)  # noqa: E731  # a row per store
    return funnel.agg(*sums, listed((F.col("raw") == 0) & F.col("error").isNull(), "empty"), listed((F.col("raw") > 0) & (F.col("matched") == 0), "unmatched"), listed(F.col("error").isNotNull(), "failed"))


def health(spark: SparkSession, query: str, names: list[str] | None = None) -> DataFrame:
    """Per connector whether it can be loaded, answers in one plan for many queries, and what it gives for a query."""
    rows = []
    for store in names or connectors.stores():
        try:
            n = connectors.load(store)(spark, query).count()
            rows.append((store, True, store in connectors._BULK, n, None))
        except Exception as e:
            rows.append((store, not isinstance(e, LookupError), store in connectors._BULK, 0, str(e)))
    return spark.createDataFrame(rows, "store string, known boolean, bulk boolean, raw long, error string")


def report(spark: SparkSession, query: str, path: str, names: list[str] | None = None) -> DataFrame:
    """Writes candidates and the funnel of a query as JSON lines below path; gives the roll-up."""
    chosen = [s.strip().lower() for s in (names or connectors.stores())]
    found, errors = candidates(spark, query, chosen)
    found.drop("identity").write.mode("overwrite").json(f"{path}/candidates")
    funnel = store_funnel(found, errors, chosen)
    funnel.write.mode("overwrite").json(f"{path}/funnel")
    return roll_up(funnel)
