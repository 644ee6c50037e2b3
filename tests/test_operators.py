"""Operators on small tables, and against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from offerlane.operators import catalog, dedup, matcher, rank, search_index
from offerlane.sources import pages


def test_keep_first_and_last(spark):
    rows = [(k, o, random.Random(o).random()) for o, k in enumerate("abcabcaab")]
    df = spark.createDataFrame(rows, "k string, o int, v double")
    first, last = {}, {}
    for k, o, _ in rows:
        first.setdefault(k, o)
        last[k] = o
    assert {r.k: r.o for r in dedup.keep_first(df, ["k"], ["o"]).collect()} == first
    assert {r.k: r.o for r in dedup.keep_last(df, ["k"], ["o"]).collect()} == last
    once = dedup.keep_first(df, ["k"], ["o"])
    assert sorted(dedup.keep_first(once, ["k"], ["o"]).collect()) == sorted(once.collect())


def test_identity_key(spark):
    df = spark.createDataFrame([("S", "n", "v1", "p", "g", "s"), ("S", "n", "", "p", "g", "s"), ("S", "n", None, None, "g", "s"), ("S", "n", None, " ", None, "s"), ("S", "n", None, None, None, None)], "store string, n string, v string, p string, g string, s string")
    key = dedup.identity_key(F.col("store"), F.col("n"), F.col("v"), F.col("p"), F.col("g"), F.col("s"), F.lit(100.0), F.lit(None).cast("string"))
    assert [r[0] for r in df.select(key["kind"]).collect()] == ["variant", "product", "gtin", "sku", "fallback"]


def test_changes_is_the_sequential_fold(spark):
    rng = random.Random(3)
    rows = [("k%d" % rng.randrange(3), t, rng.choice([None, 9, 10]), rng.choice("AB")) for t in range(60)]
    last, want = {}, []
    for k, t, v, s in rows:
        if v is not None and last.get(k) != (v, s):
            last[k] = (v, s)
            want.append((k, t, v, s))
    got = dedup.changes(spark.createDataFrame(rows, "k string, t int, v int, s string"), ["k"], ["t"], ["v", "s"])
    assert sorted(map(tuple, got.collect())) == sorted(want)
    newest = dedup.changes(spark.createDataFrame(rows, "k string, t int, v int, s string"), ["k"], ["t"], ["v", "s"], most=2)
    assert newest.groupBy("k").count().agg(F.max("count")).first()[0] == 2


def test_upsert_replays_to_last_wins(spark):
    old = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "id int, o int, v string")
    new = spark.createDataFrame([(2, 1, "c"), (3, 2, "d"), (2, 3, "e")], "id int, o int, v string")
    got = {r.id: r.v for r in catalog.upsert(old, new, "id", ["o"]).collect()}
    assert got == {1: "a", 2: "e", 3: "d"}


@pytest.mark.parametrize(("name", "candidates", "score", "product"), [("hawas", ["hawas ice"], None, None), ("hawas ice", ["hawas"], 0.956, 0), ("hawas ice", ["hawas", "hawas ice"], 1.0, 1)])
def test_match_by_name(spark, name, candidates, score, product):
    o = spark.createDataFrame([(7, name, "b")], "id int, name string, brand string")
    c = spark.createDataFrame([(i, n, "b") for i, n in enumerate(candidates)], "product_id int, name string, brand string")
    got = matcher.by_name(o, c, "id").collect()
    if score is None:
        assert got == []
    else:
        assert (got[0].product_id, got[0].method) == (product, "exact_name") and got[0].score == pytest.approx(score)


def test_match_by_name_finds_what_all_pairs_find(spark):
    rng = random.Random(5)
    words = ["w%d" % i for i in range(12)]
    o = [(i, " ".join(rng.sample(words, rng.randint(1, 6))), rng.choice("ab")) for i in range(60)]
    c = [(i, " ".join(rng.sample(words, rng.randint(1, 6))), rng.choice("ab")) for i in range(60)]

    def score(n, b, m, d):
        x, y = set(n.split()), set(m.split())
        f = 2 * len(x & y) / (len(x) + len(y))
        best = 1.0 if n == m else max(f, 0.92) if f" {m} " in f" {n} " else f
        return 0.45 + 0.55 * best if b == d else 0.95 * best

    want = {}
    for i, n, b in o:
        best = max(((score(n, b, m, d), -j) for j, m, d in c))
        if best[0] >= matcher.MATCH:
            want[i] = -best[1]
    got = matcher.by_name(spark.createDataFrame(o, "id int, name string, brand string"), spark.createDataFrame(c, "product_id int, name string, brand string"), "id")
    assert {r.id: r.product_id for r in got.collect()} == want


def test_identifier_must_be_unique(spark):
    c = spark.createDataFrame([(1, "g1"), (2, "g2"), (3, "g2"), (4, None)], "product_id int, g string")
    o = spark.createDataFrame([(10, "g1"), (11, "g2"), (12, None)], "id int, og string")
    assert [tuple(r) for r in matcher.by_identifier(o, c, "id", "og", "g").collect()] == [(10, 1)]


def test_search(spark):
    d = spark.createDataFrame([(1, "red plate"), (2, "red rod"), (3, "green plate plate"), (4, None)], "id int, name string")
    terms = search_index.index_terms(d, "id", "name")
    assert [r.doc for r in search_index.search(terms, d, "id", "pl").collect()] == [3, 1]
    assert [r.doc for r in search_index.search(terms, d, "id", "re pl", 5).collect()] == [1]
    assert search_index.search(terms, d, "id", " ").count() == 0


def test_suggest_needs_two_characters(spark):
    p = spark.createDataFrame([(1, "Foo Bar", "B", "foo bar", "b"), (2, "foo bar", "B", "foo bar", "b"), (3, "Bar Foo", "B", "bar foo", "b"), (4, "Foo Tester", "B", "foo tester", "b")], "product_id int, name string, brand string, name_n string, brand_n string")
    assert rank.suggest(p, "f").count() == 0
    assert [r.product_id for r in rank.suggest(p, "foo").collect()] == [1, 3]


def test_pages(spark):
    html = '<html><title> A  b</title><script>x<b</script><h1 class="t">N &amp; <i>m</i></h1><a href="/p/1?q#z">One</a><a href="https://o.example/2">Two</a><a href="/p/1">again</a></html>'
    df = spark.createDataFrame([(1, "https://s.example/x", html), (2, "https://s.example/y", None)], "page_id long, url string, html string")
    assert [(r.link, r.position) for r in pages.links(df).orderBy("position").collect()] == [("https://s.example/p/1", 0), ("https://o.example/2", 1)]
    assert df.select(pages.tag_text(F.col("html"), "title")).first()[0] == "A b"
    got = {r.page_id: r for r in pages.page_offers(df).collect()}
    assert (got[1].name, got[1].n_links, got[2].name, got[2].n_links) == ("N & m", 3, None, 0)
    ld = '<script type="application/ld+json">{"@graph":[{"@type":"Product","name":"P","brand":{"name":"B"},"offers":[{"price":12.5,"priceCurrency":"EUR","availability":"https://schema.org/InStock"}]}]}</script>'
    assert pages.page_offer(ld) | {"title": 0} == {"title": 0, "name": "P", "brand": "B", "price": "12.5", "currency": "EUR", "availability": "InStock", "n_links": 0}
    bad = pages.page_offer('<script type="application/ld+json">{</script><h1>H</h1>')
    assert bad["name"] == "H" and bad["price"] is None


def test_platform_products_and_sitemaps(spark):
    doc = '{"id":1,"title":"T","vendor":"V","variants":[{"id":2,"title":"50","price":1999,"available":true},{"id":3,"price":null}]}'
    rows = pages.platform_products(spark.createDataFrame([(doc,), ("{",), (None,)], "json string")).collect()
    assert [(r.store_variant_id, r.price_cents, r.brand) for r in rows] == [(2, 1999, "V")]
    xml = "<urlset><url><loc> https://a.example/1 </loc></url><url><loc>https://a.example/2?a&amp;b</loc></url><url><loc>https://a.example/1</loc></url></urlset>"
    assert spark.range(1).select(pages.sitemap_urls(F.lit(xml))).first()[0] == ["https://a.example/1", "https://a.example/2?a&b"]


def test_price_stream(spark, tmp_path):
    from offerlane.streaming.history import price_changes

    rows = [("k", 1, 10.0, "A"), ("k", 2, 10.0, "A"), ("k", 3, 10.0, "B"), ("k", 4, 9.0, "B"), ("k", 5, None, "B"), ("k", 6, 9.0, "B"), ("j", 1, 1.0, "A")]
    df = spark.createDataFrame(rows, "key string, t int, value double, store string").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    df.filter("ts <= timestamp_seconds(3)").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = price_changes(stream).writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        df.filter("ts > timestamp_seconds(3)").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query.processAllAvailable()
        late = spark.createDataFrame([("k", 2, 7.0, "C"), ("k", 6, 9.0, "B")], "key string, t int, value double, store string").withColumn("ts", F.timestamp_seconds("t")).drop("t")
        late.select(df.columns).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # both older and equal to the last point seen
        query.processAllAvailable()
    finally:
        query.stop()
    got = sorted((r.key, r.ts.second, r.value, r.store) for r in spark.table("kept").collect())
    assert got == [("j", 1, 1.0, "A"), ("k", 1, 10.0, "A"), ("k", 3, 10.0, "B"), ("k", 4, 9.0, "B")]


def test_name_pairs_miss_none_and_are_few(spark):
    """All pairs that score MATCH by a loop over all pairs, from a small part of them; names of one to
    nine words, with few and with many brands, contained, repeated and without a brand."""
    from random import Random

    r = Random(3)
    words = [f"w{k}" for k in range(60)]

    def some(n, brands):
        names = [" ".join(r.choice(words) for _ in range(r.randint(1, 9))) for _ in range(n)]
        return [(x, r.choice(brands)) for x in names]

    brands = ["a", "b", "c", "d", ""]
    known = some(250, brands)
    asked = some(100, brands) + [(f"new {x} big", r.choice([b, "a"])) for x, b in known[:60]] + [(" ".join(x.split()[1:] + ["z"]), b) for x, b in known[60:160] if " " in x] + known[160:200]
    known, asked = sorted(set(known)), sorted(set(asked))

    def score(n, b, x, y):
        p, q = set(n.split()), set(x.split())
        f = 2 * len(p & q) / (len(p) + len(q))
        best = 1.0 if n == x else max(f, 0.92) if f" {x} " in f" {n} " else f
        return 0.45 + 0.55 * best if b == y and b else 0.95 * best

    want = {(n, b, x, y) for n, b in asked for x, y in known if score(n, b, x, y) >= 0.86}
    df = lambda rows: spark.createDataFrame(rows, "name string, brand string")
    got = {tuple(row) for row in matcher.name_pairs(*matcher.with_words(df(asked), df(known))).collect()}
    assert want <= got and len(want) > 150
    assert len(got) < 3 * len(want) and len(got) < len(asked) * len(known) / 20

    # 3000 equal names under one word are parted into salted blocks, and the best product is the smallest id
    many = spark.range(3000).select(F.col("id").alias("product_id"), F.concat(F.lit("red v"), F.col("id").cast("string")).alias("name"), F.lit("a").alias("brand"))
    one = spark.createDataFrame([(1, "red v7", "a"), (2, "red", "a"), (3, "blue", None), (4, None, "a")], "k int, name string, brand string")
    assert [tuple(x) for x in matcher.by_name(one, many, "k").orderBy("k").collect()] == [(1, 7, "exact_name", 1.0)]
    assert matcher.by_name(one.limit(0), many, "k").count() == 0 and matcher.by_name(one, many.limit(0), "k").count() == 0
