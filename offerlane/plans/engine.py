"""The searches as functions of a session: what an API would serve."""

from __future__ import annotations

import threading
import uuid
from base64 import urlsafe_b64decode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlane.functions.classify import availability_rank, reject_reason
from offerlane.functions.text import filled, job_id, norm, norm_text
from offerlane.operators.dedup import changes, keep_first
from offerlane.operators.matcher import attach_matches, catalog_for_matching, offers_for_matching
from offerlane.operators.rank import suggest
from offerlane.operators.store import ProductIndex
from offerlane.plans.runs import SECONDS, StoreRun
from offerlane.sources import connectors
from offerlane.sources.offers import RAW_SCHEMA, identity, normalized
from offerlane.sources.storage import kept, shared_folder, until_exit

_ORDER = ["store_rank", "attempt_no", "ingest_ord", "url"]
#: Finished jobs that are kept to be asked for.
JOBS = 64


def offer_rows(raw: DataFrame | None, spark: SparkSession, extra: str = "") -> DataFrame:
    """Raw rows of connectors as offers with their identity. extra: further columns, as DDL, to carry along."""
    kept_columns = f"store_rank int, attempt_no int{extra}"
    whole = spark.createDataFrame([], f"{RAW_SCHEMA}, {kept_columns}")
    rows = whole if raw is None else whole.unionByName(raw, allowMissingColumns=True)
    return identity(normalized(rows, tuple(c.split()[0] for c in kept_columns.split(", "))))


class Engine:
    """Searches over registered stores. seconds: how long a search takes at most; folder:
    where runs write, below the shared folder if not named."""

    def __init__(self, spark: SparkSession, stores: list[str] | None = None, seconds: float = SECONDS, folder: str | None = None):
        self.spark, self.stores, self.seconds, self.folder = spark, stores, seconds, folder
        self.jobs: dict[str, tuple[str, StoreRun]] = {}
        self.lock = threading.Lock()

    def run(self, query: str, name: str | None = None) -> StoreRun:
        """All offers of all stores for a query, as a run that isn't started."""
        stores = connectors.chosen(self.stores)

        def reader(store: str, rank: int):
            return lambda: offer_rows(connectors.gather(self.spark, query, store, rank), self.spark)

        readers = {store: reader(store, k) for k, store in enumerate(stores)} if norm_text(query) else {}
        base = self.folder or shared_folder(self.spark)
        return StoreRun(self.spark, readers, offer_rows(None, self.spark).schema, self.seconds, f"{base}/{name or 'search-' + uuid.uuid4().hex}")

    def offers(self, query: str) -> tuple[DataFrame, dict[str, str]]:
        """All offers that stores give for a query, each once at its first place, and the
        errors of stores that failed or weren't done in time."""
        run = self.run(query).start()
        run.wait()
        return keep_first(run.rows(), ["identity"], _ORDER), run.errors()

    @staticmethod
    def _by_price(df: DataFrame) -> DataFrame:
        return df.orderBy(F.col("price_cents").asc_nulls_last(), availability_rank(F.col("availability")), "store_rank", "name_n", F.lower("url"))

    def search(self, query: str) -> DataFrame:
        """Offers of all stores by price, not validated."""
        return self._by_price(self.offers(query)[0])

    @staticmethod
    def _answering(found: DataFrame, query: str) -> DataFrame:
        return found.filter(reject_reason(query, F.col("name_n"), F.col("size_ml"), F.col("search_text")).isNull())

    def search_validated(self, query: str) -> DataFrame:
        return self._by_price(self._answering(self.offers(query)[0], query))

    def debug(self, query: str) -> DataFrame:
        """Unique offers with the reason for which each is rejected (null: it is a result)."""
        found, _ = self.offers(query)
        return found.withColumn("reject_reason", reject_reason(query, F.col("name_n"), F.col("size_ml"), F.col("search_text")))

    def test_store(self, store: str, query: str) -> DataFrame:
        return Engine(self.spark, [store]).search(query)

    def start(self, query: str) -> str:
        """Starts a validated search and returns the id of its job."""
        job = job_id(query, uuid.uuid4().hex)
        self._start(job, query)
        return job

    def _start(self, job: str, query: str) -> None:
        with self.lock:
            if job in self.jobs:
                return
            ended = [j for j, (_, run) in self.jobs.items() if run.completed]
            for old in ended[: max(0, len(ended) - JOBS + 1)]:
                self.jobs.pop(old)[1].remove()
            self.jobs[job] = (query, self.run(query, f"job-{uuid.uuid4().hex}").start())

    def status(self, job: str) -> dict:
        """A job as it is now: completed, results (a DataFrame: validated offers, by price, of the stores that
        are done), stores (a row per store with its state and error), errors. A job that is not
        known is started again from the query in its id."""
        if job not in self.jobs:
            code = job.rpartition(".")[2]
            self._start(job, urlsafe_b64decode(code + "=" * (-len(code) % 4)).decode())
        query, run = self.jobs[job]
        completed = run.completed  # first, so that a completed job has all its rows
        found = keep_first(run.rows(), ["identity"], _ORDER)
        return {"completed": completed, "results": self._by_price(self._answering(found, query)), "stores": run.states(), "errors": run.errors()}

    def forget(self, job: str) -> None:
        """Ends a job and removes what it wrote."""
        with self.lock:
            found = self.jobs.pop(job, None)
        if found:
            found[1].remove()

    def funnel(self, query: str) -> DataFrame:
        """Per store how many offers there are, how many answer the query, how many are rejected for
        which reason, and its error. Stores without an offer are in it too."""
        run = self.run(query).start()
        run.wait()
        found = keep_first(run.rows(), ["identity"], _ORDER)
        reason = reject_reason(query, F.col("name_n"), F.col("size_ml"), F.col("search_text"))
        rows = found.withColumn("reject_reason", reason).groupBy("store_rank", "reject_reason").agg(F.count("*").alias("n"))
        reasons = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("reject_reason").isNotNull(), F.struct("reject_reason", "n")))))  # a few reasons
        counts = rows.groupBy("store_rank").agg(F.sum("n").alias("unique_offers"), F.coalesce(F.sum(F.when(F.col("reject_reason").isNull(), F.col("n"))), F.lit(0)).alias("matched"), reasons.alias("rejected"))
        states = run.states().select("store", "store_rank", "state", "error")
        return states.join(counts, "store_rank", "left").fillna(0, ["unique_offers", "matched"]).drop("store_rank")

    def product(self, name: str, brand: str = "", history: DataFrame | None = None) -> dict:
        """Priced offers of a product by price, the best and lowest of them, the first
        image, the price history with the best offer put in, and a message if there is none."""
        found, errors = self.offers(name)
        offers = self._by_price(found.filter(F.col("price_cents").isNotNull()))
        by_price = F.struct("price_cents", norm("store"), "name_n", F.lower("url"))
        row = offers.select(
            F.min_by(F.struct("store", "name", "url", "price_cents", "image"), by_price).alias("best"),
            F.min_by("image", F.when(F.trim("image") != "", by_price)).alias("image"),
        ).first()
        best, key = row["best"], norm_text(f"{brand} {name}")
        points = history
        if best:
            now = self.spark.createDataFrame([(key, best["price_cents"], best["store"])], "key string, value bigint, store string").withColumn("ts", F.current_timestamp())
            points = price_history(now if history is None else history.unionByName(now.withColumn("ts", F.col("ts").cast(history.schema["ts"].dataType))))
        lowest = best["price_cents"] if best else None
        return {
            "name": name, "brand": brand, "key": key, "offers": offers, "best": best, "lowest_price_cents": lowest, "image": row["image"] or "",
            "history": points, "errors": errors, "message": "" if best else "no offer at the moment",
        }

    def routing(self, query: str) -> dict:
        """Which stores a query goes to, and what each is asked."""
        return {"query": query, "attempts": connectors.attempts(query), "stores": connectors.chosen(self.stores)}

    def suggest(self, products: DataFrame, query: str, limit: int = 8) -> DataFrame:
        return suggest(products, query, limit)

    def health(self) -> dict:
        return {"status": "ok", "stores": self.stores or connectors.stores()}


def price_history(points: DataFrame, most: int = 100) -> DataFrame:
    """Points (key, ts, value, store) at which value or store changed, the last ones of each key."""
    return changes(points, ["key"], ["ts"], ["value", "store"], most)


def refresh_rows(offers: DataFrame, jobs: DataFrame) -> DataFrame:
    """offers (query, search_text) with the product of their query and whether they are
    accepted for it: all words of brand and family, of two characters or more, are in
    their text. jobs: query, product_id, and the normalised words to find."""
    rows = offers.join(jobs, "query")
    return rows.withColumn("accepted", F.forall("words", lambda w: F.contains(F.col("search_text"), w)))


def refresh_counts(rows: DataFrame) -> DataFrame:
    """Per store, and in total (store null): offers found, accepted and rejected."""
    n = F.count_if("accepted")
    return rows.rollup("store").agg(F.count("*").alias("found"), n.alias("accepted"), (F.count("*") - n).alias("rejected"))


def refresh_jobs(catalog: DataFrame) -> DataFrame:
    """product_id, query and words of each product of a catalog."""
    query = F.concat_ws(" ", F.nullif(F.trim("brand_name"), F.lit("")), F.nullif(F.trim("family_name"), F.lit("")))
    return catalog.select("product_id", query.alias("query"), F.filter(F.split(norm(query), " "), lambda w: F.length(w) >= 2).alias("words"))


def with_canonical(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Accepted offers (with product_id) with the identity of their product: catalog_id,
    product_identity, canonical_brand, canonical_name and, unless they have one, canonical_concentration."""
    names = catalog.select(F.col("product_id").alias("_id"), F.col("brand_name").alias("canonical_brand"), F.col("family_name").alias("canonical_name"), F.col("concentration").alias("_concentration"))
    own = filled(F.col("canonical_concentration")) if "canonical_concentration" in rows.columns else F.lit(None).cast("string")
    found = rows.join(names, F.col("product_id") == F.col("_id"))
    made = {"catalog_id": F.col("_id"), "product_identity": F.col("_id"), "canonical_concentration": F.coalesce(own, filled(F.col("_concentration")))}
    return found.withColumns(made).drop("_id", "_concentration")


def refresh(engine: Engine, index: ProductIndex, catalog: DataFrame, offset: int = 0, limit: int | None = None, match: bool = False) -> dict:
    """Searches the stores for a slice of a catalog, keeps offers that have all words
    of their product, and puts them into the index. Each store answers for all products in a run of
    its own; the rows are judged once and written, and all counts come from there.
    match: offers that don't have the words of their product are matched to the whole catalog, by
    identifiers and names, before they go.

    Gives products, found, written, rejected, matched, errors (per store), per_store (a DataFrame of
    refresh_counts()), and without_offers: a DataFrame of the products no accepted offer was found for."""
    spark = engine.spark
    index.upsert_products(catalog)
    jobs = refresh_jobs(catalog)
    if offset or limit:
        part = jobs.orderBy("product_id").offset(max(0, offset))
        jobs = part.limit(max(1, limit)) if limit else part
    folder = until_exit(spark, f"{engine.folder or shared_folder(spark)}/refresh-{uuid.uuid4().hex}")
    jobs = kept(jobs, f"{folder}/jobs")

    def reader(store: str, rank: int):
        return lambda: offer_rows(connectors.gather_many(spark, jobs, store, rank), spark, ", query string")

    readers = {store: reader(store, k) for k, store in enumerate(connectors.chosen(engine.stores))}
    run = StoreRun(spark, readers, offer_rows(None, spark, ", query string").schema, engine.seconds, f"{folder}/stores").start()
    run.wait()
    rows = kept(refresh_rows(keep_first(run.rows(), ["query", "identity"], _ORDER), jobs), f"{folder}/rows")
    good = with_canonical(rows.filter("accepted"), catalog)
    n_matched = 0
    if match:
        rest = rows.filter(~F.col("accepted")).drop("accepted", "words", "product_id").withColumn("key", F.sha1(F.to_json(F.struct("query", "identity", "url"))))
        known = catalog_for_matching(catalog)
        more = kept(attach_matches(offers_for_matching(rest, "key"), known, "key").select("key", F.col("catalog_id").alias("product_id")), f"{folder}/matched")
        n_matched = more.count()
        good = good.unionByName(with_canonical(rest.join(more, "key").drop("key"), catalog), allowMissingColumns=True)
    written = index.upsert_offers(good.drop("product_id"))
    counts = rows.agg(F.count("*").alias("found"), F.count_if("accepted").alias("accepted")).first()
    missing = jobs.join(rows.filter("accepted").select("product_id").distinct(), "product_id", "left_anti").select("product_id", "query", F.lit("no offer found").alias("error"))
    return {
        "products": jobs.count(), "found": counts["found"], "written": written, "rejected": counts["found"] - counts["accepted"], "matched": n_matched, "errors": run.errors(),
        "per_store": refresh_counts(rows), "without_offers": missing,
    }
