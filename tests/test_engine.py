"""Connectors, raw offers, the index and the engine, end to end on literal rows."""

import json
import sys
import threading
import time
from pathlib import Path

from pyspark.sql import functions as F

from offerlane.operators.store import ProductIndex
from offerlane.plans.engine import Engine, price_history, refresh
from offerlane.plans.runs import written_run
from offerlane.sources import connectors
from offerlane.sources.offers import RAW_SCHEMA, identity, load_catalog, normalized

sys.path.insert(0, str(Path(__file__).parent))  # row_stores

ROWS = {
    "alpha": [("Foo 100 ml EDP", "Acme", "20,00 €", True), ("Foo Gift Set", "Acme", "5,00 €", True), ("Foo 100 ml EDP", "Acme", "20,00 €", True), ("Foo 5 ml", "Acme", "2,00 €", True)],
    "beta": [("Acme Foo", "Acme", "18,50 €", False), ("Bar", "Acme", "1,00 €", None), ("Foo", "Acme", None, True)],
}


def raw(spark, store):
    rows = [(i, n, b, p, a, f"https://{store}.example/{n.replace(' ', '-')}") for i, (n, b, p, a) in enumerate(ROWS[store])]
    return spark.createDataFrame(rows, "ingest_ord long, name string, brand string, price string, available boolean, url string")


@connectors.connector("alpha")
def alpha(spark, query):
    return raw(spark, "alpha")


@connectors.connector("Beta ")
def beta(spark, query):
    return raw(spark, "beta")


@connectors.connector("broken")
def broken(spark, query):
    raise RuntimeError("no page")


def test_attempts():
    assert connectors.attempts("Foo Eau de Parfum 100ml") == ["Foo Eau de Parfum 100ml", "foo 100"]
    assert connectors.attempts("foo") == ["foo"] and connectors.attempts(" ") == []


def test_raw_offers(spark):
    rows = [
        {"ingest_ord": 1, "title": " T ", "source": {"source_brand": "B"}, "identity": {"gtin": {"value": "12"}}, "attributes": {"size_ml": {"value": "50"}, "concentration": {"value": "EDP"}}, "offer": {"price": "9,90", "availability": "In Stock"}},
        {"ingest_ord": 2, "name": "X 10 cl eau de toilette", "price": "30 €/100 ml", "available": False, "sku": " ", "gtin": "7"},
    ]
    df = spark.read.schema(RAW_SCHEMA).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
    a, b = identity(normalized(df)).orderBy("ingest_ord").collect()
    assert (a["name"], a.brand, a.gtin, a.size_ml, a.concentration, a.price_cents, a.availability, a.identity.kind) == ("T", "B", "12", 50.0, "edp", 990, "in stock", "gtin")
    assert (b.size_ml, b.concentration, b.price_cents, b.availability, b.sku) == (100.0, "eau de toilette", 3000, "out of stock", None)


def test_engine(spark):
    engine = Engine(spark, ["alpha", "beta", "broken"])
    assert engine.offers("foo")[1] == {"broken": "no page"}
    assert [(r.store, r.price_cents) for r in engine.search_validated("foo").collect()] == [("beta", 1850), ("alpha", 2000), ("beta", None)]
    assert engine.search("foo").count() == 6
    why = {r["name"]: r.reject_reason for r in engine.debug("foo").collect()}
    assert why["Foo Gift Set"] == "non_perfume_phrase" and why["Foo 5 ml"] == "small_size_without_query_size" and why["Bar"] == "family_phrase_not_in_name_phrase"
    assert engine.test_store("beta", "foo").count() == 3 and engine.health()["stores"][0] == "alpha"
    best = engine.product("foo", "Acme")["best"]
    assert (best.store, best.price_cents) == ("beta", 100)
    job = engine.start("foo")
    for _ in range(120):
        state = engine.status(job)
        if state["completed"]:
            break
        time.sleep(0.5)
    assert state["errors"] == {"broken": "no page"} and state["results"].count() == 3
    assert [(r.store, r.state) for r in state["stores"].orderBy("store_rank").collect()] == [("alpha", "done"), ("beta", "done"), ("broken", "failed")]
    again = Engine(spark, ["alpha"])  # doesn't know the job
    again.status(job)
    assert again.jobs[job][1].wait(60) and again.status(job)["results"].first().store == "alpha"
    folder = again.jobs[job][1].folder
    assert written_run(spark, folder, again.jobs[job][1].schema)[0].count() == 4  # as they came, with a duplicate
    again.forget(job)
    assert not again.jobs and written_run(spark, folder, "x int") is None
    assert engine.search(" ").count() == 0 and engine.routing("Foo Parfum")["attempts"] == ["Foo Parfum", "foo"]


def test_failing_and_hanging_stores(spark):
    """A store that fails while its rows are read, one that hangs, one without an order of arrival and an
    unknown one leave the others whole, each with its error; a poll between two stores sees the first."""
    gate = threading.Event()

    @connectors.connector("fails late")
    def fails(spark, query):
        return raw(spark, "alpha").withColumn("name", F.raise_error(F.lit("row 7 is broken")))

    @connectors.connector("hangs")
    def hangs(spark, query):
        slow = F.udf(lambda x: time.sleep(600) or x, "string")
        return raw(spark, "alpha").coalesce(1).withColumn("name", slow("name"))

    @connectors.connector("slow")
    def slow(spark, query):
        assert gate.wait(60)
        return raw(spark, "beta")

    @connectors.connector("no order")
    def no_order(spark, query):
        return raw(spark, "beta").drop("ingest_ord")

    names = ["alpha", "fails late", "beta", "hangs", "slow", "no order", "nowhere"]
    engine = Engine(spark, names, seconds=45)
    began = time.time()
    job = engine.start("foo")
    run = engine.jobs[job][1]
    while not {"alpha", "beta"} <= set(run.done):
        time.sleep(0.1)
        assert time.time() - began < 44
    early = engine.status(job)
    assert not early["completed"] and {r.store for r in early["results"].collect()} == {"alpha", "beta"}
    assert {r.store: r.state for r in early["stores"].collect()}["slow"] == "running"
    gate.set()
    assert run.wait(60) and time.time() - began < 90
    late = engine.status(job)
    assert late["completed"] and late["results"].count() == 5
    errors = late["errors"]
    assert set(errors) == {"fails late", "hangs", "no order", "nowhere"} and "row 7 is broken" in errors["fails late"]
    assert errors["hangs"].startswith("not done in 45") and "ingest_ord" in errors["no order"] and "nowhere" in errors["nowhere"]
    alive = lambda: [j for j in spark.sparkContext.statusTracker().getActiveJobsIds() if spark.sparkContext.statusTracker().getJobInfo(j).status == "RUNNING"]
    for _ in range(400):
        if not alive():
            break
        time.sleep(0.1)
    assert not alive()  # the hanging job is cancelled
    table = {r.store: r for r in Engine(spark, ["alpha", "fails late", "void store"]).funnel("foo").collect()}
    assert (table["alpha"].unique_offers, table["alpha"].matched, table["alpha"].error) == (3, 1, None)
    assert (table["fails late"].unique_offers, table["fails late"].state) == (0, "failed") and "void store" in table["void store"].error


def test_offer_data_source(spark):
    """Row connectors as a data source: a partition per store and attempt, and a filter on the store asks no other."""
    spark.dataSource.register(connectors.OfferSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    read = spark.read.format("store_offers").option("connectors", "row_stores").option("query", "Foo Parfum")
    df = read.load()
    assert df.rdd.getNumPartitions() == 4
    got = {(r.store, r.attempt_no, r.attempt, r.ingest_ord, r["name"]) for r in df.collect()}
    assert got == {(s, k, a, i, f"{s} {a} {i}") for s in ("rows one", "rows two") for k, a in enumerate(("Foo Parfum", "foo")) for i in range(3)}
    one = df.filter("store = 'rows two'")
    assert one.count() == 6 and one.rdd.getNumPartitions() == 2
    assert df.filter("store in ('rows one')").rdd.getNumPartitions() == 2 and df.filter("store = 'x'").count() == 0
    assert read.option("stores", "rows two").load().select("store").distinct().count() == 1
    assert spark.read.format("store_offers").option("connectors", "row_stores").option("query", " ").load().count() == 0


def test_row_connectors_answer_a_table_of_queries(spark):
    """One plan, and no query goes through the driver."""
    import row_stores  # noqa: F401

    jobs = spark.range(50).select(F.concat(F.lit("Foo Parfum "), F.col("id").cast("string")).alias("query"))
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    rows = connectors.gather_many(spark, jobs, "rows one", 3)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup() == before  # nothing has run yet
    got = rows.groupBy("query").agg(F.count("*").alias("n"), F.max("attempt_no").alias("k"), F.first("store_rank").alias("r"), F.min("price").alias("p")).collect()
    assert len(got) == 50 and all((r.n, r.k, r.r, r.p) == (6, 1, 3, "9,50") for r in got)
    engine = Engine(spark, ["rows one", "alpha"])
    assert engine.search("Foo").count() == 6


def test_index_and_refresh(spark, tmp_path):
    file = tmp_path / "catalog.json"
    file.write_text(json.dumps({"products": [{"product_id": "P1", "brand_name": "Acme", "family_name": " Foo  X", "aliases": ["Foo", "Foo", ""]}, {"product_id": "P2", "brand_name": "Acme", "family_name": "Bar"}, {"product_id": "P3"}]}))
    catalog = load_catalog(spark, str(file))
    assert sorted((r.product_id, r.family_name, tuple(r.aliases)) for r in catalog.collect()) == [("P1", "Foo X", ("Foo",)), ("P2", "Bar", ())]
    index = ProductIndex(spark, str(tmp_path / "index"))
    assert index.search("foo").count() == 0
    counts = refresh(Engine(spark, ["alpha", "beta"]), index, catalog.withColumn("family_name", F.when(F.col("product_id") == "P1", "Foo").otherwise(F.col("family_name"))))
    assert (counts["products"], counts["found"], counts["written"], counts["rejected"], counts["errors"]) == (2, 12, 6, 6, {})
    assert [(r.store, r.found) for r in counts["per_store"].orderBy("store").collect()] == [(None, 12), ("alpha", 6), ("beta", 6)]
    assert counts["without_offers"].count() == 0
    assert [r.product_id for r in index.search("fo ac").collect()] == ["P1"]
    assert tuple(index.stats().first()) == (2, 6, 2)
    assert [r.price_cents for r in index.get_offers("P1").collect()] == [200, 500, 1850, 2000, None]
    assert index.get_offers("P1", 100).count() == 1
    assert len(index.product_with_offers("P2").first().offers) == 1
    made = normalized(spark.read.schema(RAW_SCHEMA).json(spark.sparkContext.parallelize(['{"ingest_ord":1,"store":"s","name":"New","brand":"N","price":"1"}'])))
    assert index.upsert_offers(made) == 1 and index.upsert_offers(made) == 1
    assert tuple(index.stats().first()) == (3, 7, 3) and index.autocomplete("new").count() == 1


def test_price_history(spark):
    points = spark.createDataFrame([("k", 1, 10, "A"), ("k", 2, 10, "A"), ("k", 3, 10, "B")], "key string, ts int, value int, store string")
    assert [r.ts for r in price_history(points).orderBy("ts").collect()] == [1, 3]
