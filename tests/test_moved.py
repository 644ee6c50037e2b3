"""Queries that move little: equal to their SQL on odd rows, by plans that keep to it."""

import duckdb
import pytest

from offerlane.plans import catalog_queries, registry
from offerlane.sources import evidence, stores, tables

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Tables with repeated keys, lines without product, store or price, stores of one name and equal prices."""
    at, con = str(tmp_path_factory.mktemp("odd")), duckdb.connect()
    save = lambda name, sql: con.execute(f"copy ({sql}) to '{at}/{name}.parquet'")
    part, supplier, line = (f"'{DATA}/{t}.parquet'" for t in ("part", "supplier", "lineitem"))
    save("part", f"select * from {part} where p_partkey % 7 <> 0 union all select * from {part} where p_partkey % 5 = 1 union all select * replace (p_size + 3 as p_size) from {part} where p_partkey % 11 = 3")
    save("supplier", f"select * replace (case when s_suppkey % 3 = 0 then 'Same store' else s_name end as s_name) from {supplier} where s_suppkey <> 4 union all select * replace ('Other' as s_name) from {supplier} where s_suppkey = 1")
    price = "case when l_orderkey % 50 = 3 and l_suppkey % 2 = 0 then null when l_suppkey = 2 then 5.0 * l_quantity else round(l_extendedprice, -2) end"
    save("lineitem", f"select * replace ({price} as l_extendedprice) from {line} where l_suppkey <> 5 or l_orderkey % 400 = 0")
    for t in ("part", "supplier", "lineitem"):
        con.execute(f"create view {t} as select * from '{at}/{t}.parquet'")
    return at, con


def equal(spark, odd, query, name):
    at, con = odd
    got = query(spark, at)
    want = con.execute(f"select {', '.join(got.columns)} from ({registry.ORACLE_SQL[name]})").fetchall()
    assert want and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_product_pages(spark, odd):
    """A missing price comes last; lines are moved as keys and prices, without a sort of them all."""
    equal(spark, odd, catalog_queries.product_pages, "product_pages")
    plan = catalog_queries.product_pages(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "rightHint=(strategy=shuffle_hash)" in plan


def test_topk_offers_per_store(spark, odd):
    """Few lines are joined with products; stores with few prices keep all their lines."""
    equal(spark, odd, registry.topk_offers_per_store, "topk_offers_per_store")
    assert tables.low_lines(spark, DATA, 8).count() < tables.read(spark, DATA, "lineitem").count() / 10
    assert tables.low_lines(spark, DATA, 100).count() == tables.read(spark, DATA, "lineitem").count()


def test_upsert_offers_last_wins(spark, odd, tmp_path):
    """Lines are dealt once; ids that hide the sign of a number still have one last line."""
    equal(spark, odd, registry.upsert_offers_last_wins, "upsert_offers_last_wins")
    plan = registry.upsert_offers_last_wins(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    at, con = str(tmp_path), duckdb.connect()
    for t, keys in (("part", ["p_partkey"]), ("supplier", ["s_suppkey"]), ("lineitem", ["l_partkey", "l_suppkey"])):
        table = f"'{DATA}/{t}.parquet'"
        rows = " union all ".join(f"select * replace ({', '.join(f'{sign} * {k} as {k}' for k, sign in zip(keys, signs))}) from {table}{where}" for signs, where in (((1, 1), ""), ((-1, 1) if t == "lineitem" else (-1,), f" where {keys[0]} % 2 = 1")))
        con.execute(f"copy ({rows}) to '{at}/{t}.parquet'")
    rows = lambda of: sorted(map(tuple, registry.upsert_offers_last_wins(spark, of).collect()))
    assert rows(at) == rows(DATA)  # the greater number of two that differ by their sign comes last


def test_only_pages_of_candidates_are_parsed(spark, monkeypatch):
    """Of forty pages that a sitemap lists the store's rules take 24, and these alone are parsed, each once."""
    parsed = []
    monkeypatch.setattr(stores, "page_rows", lambda pages: parsed.append(pages.count()) or evidence.page_rows(pages))
    at = [f"https://www.parfum-zentrum.de/red-plate-{k:02d}_z{k}" for k in range(40)]
    page = """<script type='application/ld+json'>{"@type": "Product", "name": "red plate", "offers": {"price": "9.00"}}</script>"""
    documents = [("ParfumZentrum", "sitemap", None, "https://www.parfum-zentrum.de/0.xml", "<urlset>" + "".join(f"<loc>{u}</loc>" for u in at) + "</urlset>")]
    documents += [("ParfumZentrum", "page", None, u, page) for u in [*at, *at[:5], "https://www.parfum-zentrum.de/blue-bolt_z77"]]
    found = stores.store_offers(spark.createDataFrame([("red plate",)], "query string"), spark.createDataFrame(documents, "store string, kind string, query string, url string, body string"))
    assert sorted(r.url for r in found.collect()) == at[:24] and parsed == [24]


def test_rules_of_pages_run_once(spark):
    """No filter below the rules repeats them, and an offer's own steps are computed once."""
    df = spark.createDataFrame([("u", "h")], "url string, html string")
    plan = evidence.page_rows(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter (" not in plan and plan.count("try_variant_get") < 400
