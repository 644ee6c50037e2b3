"""Pages as evidence and raw offers, discovery, diagnostics and the command line, on literal rows."""

import json

from pyspark.sql import functions as F

from offerlane.__main__ import arguments, run
from offerlane.functions.text import auto_id, search_words
from offerlane.operators import dedup, matcher
from offerlane.operators.store import ProductIndex, build_index
from offerlane.plans import diagnostics
from offerlane.plans.engine import Engine
from offerlane.sources import connectors, discovery, evidence
from offerlane.sources.offers import RAW_SCHEMA, as_raw, normalized

PAGES = [
    (1, "https://a.example/p/1.html", '<head><title>T</title><meta property="og:image" content="/i.png"><script type="application/ld+json">{"@graph":[{"@type":["Product"],"name":"Foo EDP","brand":{"name":"Bar"},"gtin13":"123-4","offers":[{"price":"","availability":"x"},{"price":10.5,"availability":"https://schema.org/OutOfStock"},{"lowPrice":"12,50","priceCurrency":"USD","availability":"InStock"}]}]}</script></head><main>Size: 50 ml <button disabled>Add to cart</button></main>'),
    (2, "https://a.example/q?x=1", '<h1>Baz 100 ml</h1><div><span class="old-price">old price 99,00 €</span><span class="price">45,90 €</span><form><button>Comprar</button></form></div><ul><li><a href="/p/2?a=1" title="Baz two"><img src="b.jpg"></a><span>12,00 €</span></li><li><a href="p/3">Three</a></li></ul>'),
    (3, "https://a.example/", "<p>nothing"),
    (4, None, None),
    (5, "https://b.example/x", '<h1>Q</h1><p>Precio: € 1.234,50 </p><link itemprop="availability" href="http://schema.org/SoldOut">'),
    (6, "https://b.example/y", '<h1>R</h1><meta itemprop="price" content="7.5"><script type="application/ld+json">{bad</script><button aria-disabled="true">Buy now</button><select><option selected>30 ml</option></select>'),
]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def test_raw_offers_of_pages(spark):
    rows = {r.page_id: r for r in evidence.raw_offers(pages(spark)).collect()}
    assert sorted(rows) == [1, 2, 5, 6]
    a = rows[1]
    assert (a["name"], a.brand, a.price, a.currency, a.availability, a.size_ml, a.gtin, a.image) == ("Foo EDP", "Bar", "12.5", "USD", "in_stock", "50.0", "1234", "https://a.example/i.png")
    assert a.provenance == {"price": "jsonld", "size_ml": "product_page", "availability": "html_availability"}
    assert (rows[2].price, rows[2].availability, rows[2].provenance["availability"]) == ("45.9", "in_stock", "purchase_control")
    assert (rows[5].price, rows[5].availability, rows[5].size_ml) == ("1234.5", "out_of_stock", None)
    assert (rows[6].price, rows[6].availability, rows[6].size_ml) == ("7.5", "out_of_stock", "30.0")
    offers = normalized(as_raw(evidence.raw_offers(pages(spark)).withColumn("store", F.lit("s"))))
    assert sorted((r["name"], r.price_cents) for r in offers.collect()) == [("Baz 100 ml", 4590), ("Foo EDP", 1250), ("Q", 123450), ("R", 750)]
    assert evidence.raw_offers(pages(spark).limit(0)).count() == 0


def test_search_page_cards(spark):
    found = evidence.link_candidates(pages(spark))
    got = sorted((r.page_id, r.url, r.label, r.card) for r in found.collect())
    assert got == [(2, "https://a.example/p/2", "Baz two", "12,00 €"), (2, "https://a.example/p/3", "Three", "12,00 € Three")]
    assert sorted((r["name"], r.price) for r in evidence.card_offers(found).collect()) == [("Baz two", "12.0"), ("Three", "12.0")]
    links = spark.createDataFrame([("https://www.a.example/p/red-plate", 0, "Red plate", "x"), ("https://b.example/p/red-plate", 1, "Red plate", "x"), ("https://a.example/q", 2, "", "the red big plate 3,00"), ("https://a.example/p/red-plate-tester", 3, "red plate", None)], "url string, position int, label string, card string")
    assert [(r.position, r.title) for r in discovery.matching_links(links, "red plate", "a.example").collect()] == [(0, "Red plate"), (2, "the red big plate 3,00")]
    assert discovery.matching_links(links, "red plate", "a.example", 1).count() == 1 and discovery.matching_links(links, "", "a.example").count() == 0


def test_platform_documents(spark):
    doc = {"id": 1, "title": "Foo", "vendor": "V", "featured_image": {"src": "//c.example/i.png"}, "variants": [{"id": 2, "price": 3185, "available": True, "barcode": "12-3"}, {"id": 3, "price": "20,5", "available": False}, {"id": 4, "price": None}]}
    other = {"title": "X", "images": ["/j.png"], "variants": [{"price": "45.5", "available": True}, {"price": 50, "available": True}]}
    rows = [("https://a.example/products/foo.js", json.dumps(doc)), ("u2", "bad"), ("u3", json.dumps({"title": "Foo gift set", "variants": []})), ("https://a.example/x", json.dumps(other)), ("u5", None), ("u6", json.dumps({"title": "N"}))]
    df = spark.createDataFrame(rows, "url string, json string")
    got = sorted((r["name"], r.variant_no, r.price_cents, r.gtin, r.image) for r in discovery.platform_variants(df).collect())
    assert got == [("Foo", 0, 3185, "123", "https://c.example/i.png"), ("Foo", 1, 2050, None, "https://c.example/i.png"), ("X", 0, 4550, None, "https://a.example/j.png"), ("X", 1, 50, None, "https://a.example/j.png")]
    assert sorted((r["name"], r.price_cents, r.available) for r in discovery.platform_offers(df).collect()) == [("Foo", 3185, True), ("N", None, False), ("X", 4550, True)]


def test_suggestions(spark):
    made = lambda *products: json.dumps({"resources": {"results": {"products": list(products)}}})
    rows = [("foo 100 ml", made({"title": "Foo 100ml", "url": "/products/foo?x=1"}, {"title": "Bar", "url": "/products/bar"})), ("foo", made({"name": "Foo", "url": "/products/foo"}, {"name": "foo set", "url": "/products/set"}, {"name": "Foo", "url": "/pages/foo"})), ("zz", "no"), ("foo", None)]
    found = discovery.suggested_products(spark.createDataFrame(rows, "variant string, json string"))
    assert [r.url for r in discovery.candidate_urls(found, "foo 100 ml", "https://a.example").collect()] == ["https://a.example/products/foo"]
    assert discovery.query_variants("Foo 100 ml") == ["Foo 100 ml", "foo100ml", "foo", "100"]
    p = spark.createDataFrame([(1, '[{"Name":"A","Brand":"B","_id":7}]'), (2, '{"results":[{"name":"C"},{"x":1}]}'), (3, "5"), (4, None)], "q int, json string")
    assert sorted((r.q, r["name"], r.brand, r.catalog_id) for r in discovery.catalog_suggestions(p).collect()) == [(1, "A", "B", "7"), (2, "C", None, None)]
    brands = spark.createDataFrame([("Dior",), ("",), (None,), ("dior",)], "brand string")
    assert [tuple(r) for r in discovery.brand_queries(brands, "dior sauvage").collect()] == [("dior", "dior sauvage")]


def test_sitemaps(spark):
    rows = [
        ("r", "<sitemapindex><sitemap><loc>https://a/sitemap1.xml</loc></sitemap><sitemap><loc><![CDATA[https://a/s2.xml.gz]]></loc></sitemap></sitemapindex>"),
        ("https://a/sitemap1.xml", "<urlset><url><loc> https://a/p/red-plate?x=1&amp;y=2 </loc></url><loc>https://a/p/z</loc>"),
        ("https://a/s2.xml.gz", "<urlset><loc>https://a/p/red-rod</loc><loc>https://a/p/z</loc>"), ("flat", "<urlset><loc>https://a/1</loc></urlset>"), ("none", None),
    ]
    df = spark.createDataFrame(rows, "url string, xml string")
    assert [r.location for r in discovery.sitemap_products(df, "r").orderBy("map_no", "position").collect()] == ["https://a/p/red-plate?x=1&y=2", "https://a/p/z", "https://a/p/red-rod"]
    assert [r.location for r in discovery.sitemap_products(df, "flat").collect()] == ["https://a/1"] and discovery.sitemap_products(df, "none").count() == 0
    assert [(r.location[-9:], r.score) for r in discovery.sitemap_candidates(discovery.sitemap_products(df, "r"), "red rod").collect()] == [("p/red-rod", 20), ("e?x=1&y=2", 10)]
    assert df.select(discovery.sitemap_kind(F.col("xml")).alias("k")).filter("k is null").count() == 1


def test_stages(spark):
    a, b, none = (spark.createDataFrame([(u,) for u in us], "url string") for us in (["u1", "u2"], ["u2", "u3"], []))
    assert sorted((r.url, r.stage) for r in discovery.staged(a, b).collect()) == [("u1", 0), ("u2", 0), ("u3", 1)]
    assert sorted(r.url for r in discovery.first_stage(a, b).collect()) == ["u1", "u2"]
    assert sorted(r.url for r in discovery.first_stage(a, b, least=3).collect()) == ["u1", "u2", "u3"]
    assert sorted(r.url for r in discovery.first_stage(none, b).collect()) == ["u2", "u3"]
    assert [r.url for r in discovery.not_seen(b, a).collect()] == ["u3"]


def test_predicates(spark):
    rows = [("Foo EDP 50ml", "Bar", 50.0, "https://x/p/1"), ("Foo", "Bar", 100.0, "https://x/p/1"), ("Foo tester", "Bar", None, "https://x/p/1"), ("Foo", "Bar", None, "https://x/c"), ("Foo", "Bar", None, "https://x/p/1"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "name string, brand string, size double, url string")
    got = [r[0] for r in df.select(discovery.answers(F.col("name"), F.col("brand"), F.col("size"), F.col("url"), "bar foo 50 ml", "/p/")).collect()]
    assert got[:5] == [True, False, False, False, True] and not got[5]
    one = spark.range(1)
    fits = one.select(discovery.size_fits(F.lit("a 50ml"), F.lit("foo 5 cl")), discovery.size_fits(F.lit("a"), F.lit("foo 5 cl")), discovery.size_fits(F.lit("a"), F.lit("foo")), discovery.product_has_marker(F.lit("foo"), F.lit("https://x/coffret%20a"), F.lit("")), discovery.has_marker(F.lit("a settee"))).first()
    assert tuple(fits) == (True, False, True, True, False)
    assert one.select(search_words(F.lit("Édp 100ml  ß"))).first()[0] == ["edp", "100ml"]
    assert len(one.select(auto_id(F.lit("A"), F.lit("b"))).first()[0]) == len("SH-AUTO-") + 12


def test_attach_matches(spark):
    c = spark.createDataFrame(
        [(1, "c1", ["11"], ["m-1"], "blue rod", "acme", ["azure rod"], "Acme", "Blue Rod"), (2, "c2", ["22"], [], "red plate", "acme", None, "Acme", "Red Plate"), (3, "c2", [], ["m-1"], "green box", "", [], "", "Green Box"), (4, None, ["22"], [], "", "x", [], "X", "No name")],
        "product_id int, catalog_id string, gtins array<string>, mpns array<string>, name string, brand string, aliases array<string>, canonical_brand string, canonical_name string",
    )
    o = spark.createDataFrame(
        [(10, "1 1", None, None, "zzz", "", 50.0, "r"), (11, "22", None, None, "azure rod", "acme", None, "r"), (12, None, "M1", "C 2", "zzz", "", 10.5, "r"), (13, None, None, None, "red plate", "acme", None, "r"), (14, None, None, None, "blue rod big new", "acme", None, "r"), (15, None, None, None, "rod", "acme", None, "r"), (16, None, None, None, "", "", None, "r")],
        "id int, gtin string, mpn string, catalog_id string, name string, brand string, size_ml double, raw string",
    )
    got = {r.id: (r.canonical_name, r.match_method, r.match_score, r.variant_id, r.raw) for r in matcher.attach_matches(o, c, "id", ["product_id"]).collect()}
    assert got == {
        10: ("Blue Rod", "gtin", 1.0, "c1:50", "r"), 11: ("Blue Rod", "exact_name", 1.0, "c1", "r"), 12: ("Green Box", "catalog_id", 0.98, "c2:10.5", "r"),
        13: ("Red Plate", "exact_name", 1.0, "c2", "r"), 14: ("Blue Rod", "exact_name", 0.956, "c1", "r"),
    }


def test_salted_blocks_find_the_same(spark, monkeypatch):
    c = spark.createDataFrame([(k, f"rod {k % 7} {k % 5}", "a") for k in range(60)], "product_id int, name string, brand string")
    o = spark.createDataFrame([(k, f"rod {k % 7} {k % 5} new", "a" if k % 2 else "b") for k in range(40)], "id int, name string, brand string")
    whole = sorted(map(tuple, matcher.by_name(o, c, "id").collect()))
    monkeypatch.setattr(matcher, "LISTED", 2)
    assert sorted(map(tuple, matcher.by_name(o, c, "id").collect())) == whole and whole


def test_position_in(spark):
    df = spark.createDataFrame([(k % 3 or None, (k * 7) % 50, k) for k in range(200)], "g int, v int, k int")
    got = dedup.position_in(df, ["g"], F.floor(F.col("v") / 8), ["v", "k"], "place").collect()
    for g in (None, 1, 2):
        own = sorted((r.v, r.k, r.place) for r in got if r.g == g)
        assert [p for _, _, p in own] == list(range(len(own)))
    assert len(got) == 200


def test_diagnostics_and_command_line(spark, tmp_path, capsys):
    rows = [(0, "Foo", "Acme", "20,00 €", "https://g.example/1"), (1, "Foo", "Acme", "20,00 €", "https://g.example/2"), (2, "Foo gift set", "Acme", "5,00 €", "https://g.example/3")]

    @connectors.bulk_connector("gamma")
    def gamma(spark, attempts):
        return attempts.crossJoin(F.broadcast(spark.createDataFrame(rows, "ingest_ord long, name string, brand string, price string, url string")))  # three rows

    @connectors.connector("void")
    def void(spark, query):
        return spark.createDataFrame([], "name string")

    names = ["gamma", "void", "nowhere"]
    found, errors = diagnostics.candidates(spark, "foo", names)
    assert found.count() == 3 and list(errors) == ["nowhere"]
    assert [(r.url, r.kept_url) for r in diagnostics.duplicates(found).collect()] == [("https://g.example/2", "https://g.example/1")]
    total = diagnostics.roll_up(diagnostics.store_funnel(found, errors, names)).first()
    assert (total.raw, total.unique, total.duplicates, total.matched, total.rejected) == (3, 2, 1, 1, 1)
    assert (total.empty, total.unmatched, total.failed) == (["void"], [], ["nowhere"])
    assert [(r.store, r.known, r.raw) for r in diagnostics.health(spark, "foo", names).orderBy("store").collect()] == [("gamma", True, 3), ("nowhere", False, 0), ("void", True, 0)]
    engine = Engine(spark, ["gamma"])
    assert [(r.matched, r.rejected) for r in engine.funnel("foo").collect()] == [(1, {"non_perfume_phrase": 1})]
    page = engine.product("foo", "Acme")
    assert page["lowest_price_cents"] == 500 and page["message"] == "" and page["history"].count() == 1 and page["image"] == ""
    assert engine.product("foo", "Acme", page["history"])["history"].count() == 1

    file = tmp_path / "catalog.json"
    file.write_text(json.dumps({"products": [{"product_id": "P1", "brand_name": "Acme", "family_name": "Foo"}]}))
    index = str(tmp_path / "index")
    offers = normalized(spark.read.schema(RAW_SCHEMA).json(spark.sparkContext.parallelize(['{"ingest_ord":1,"store":"s","name":"New","brand":"N","price":"1"}'])))
    assert tuple(build_index(spark, str(file), offers, index).first()) == (2, 1, 1)
    run(spark, arguments(["--stores", "gamma", "refresh", str(file), index]))
    assert "'found': 2, 'written': 2" in capsys.readouterr().out
    run(spark, arguments(["search", "acm", "--index", index]))
    assert "P1" in capsys.readouterr().out
    store = ProductIndex(spark, index)
    assert store.vacuum(1) > 0 and store.offers().count() == 3
    run(spark, arguments(["--stores", "gamma", "diagnose", "foo", str(tmp_path / "report")]))
    assert spark.read.json(str(tmp_path / "report" / "candidates")).count() == 3
