"""Searches at stores over literal documents, and pages with very many links."""

import json
import time

from pyspark.sql import functions as F

from offerlane.plans.engine import Engine
from offerlane.sources import stores
from offerlane.sources.listing import link_rows, listing, page_links, with_cards
from offerlane.sources.offers import normalized


def page(name, price, brand="Acme", stock="InStock", size=""):
    ld = json.dumps({"@type": "Product", "name": name, "brand": {"name": brand}, "offers": {"price": price, "priceCurrency": "EUR", "availability": f"https://schema.org/{stock}"}})
    return f'<html><head><title>{name}</title><script type="application/ld+json">{ld}</script></head><body><h1>{name}</h1><p>{size}</p></body></html>'


def links(*rows):
    return "<body><nav><a href='/'>home</a></nav>" + "".join(f"<div class=card><a href='{h}'>{t}</a><span>{more}</span></div>" for h, t, more in rows) + "</body>"


def product(title, *variants):
    return json.dumps({"id": 1, "title": title, "vendor": "Acme", "variants": [{"id": i, "title": t, "price": p, "available": a} for i, (t, p, a) in enumerate(variants)]})


Q = "Foo Bar Eau de Parfum"
DOCUMENTS = [
    # suggestions first, then links by their cards; product documents; the least price of what is there
    ("Bplatz", "suggest", Q, "s", json.dumps({"resources": {"results": {"products": [{"title": "Foo Bar", "url": "/products/one?x=1"}, {"title": "Foo Bar gift set", "url": "/products/set"}, {"title": "Foo", "url": "/products/foo"}]}}})),
    ("Bplatz", "search", Q, "https://bplatz.de/search", links(("/products/two", "more", "Acme Foo Bar 20,00 €"), ("/products/one", "Foo Bar", ""), ("/pages/foo-bar", "Foo Bar", ""))),
    ("Bplatz", "json", None, "https://bplatz.de/products/one", product("Foo Bar", ("50 ml", 2500, True), ("100 ml", 4000, False))),
    ("Bplatz", "json", None, "https://bplatz.de/products/two", product("Foo Bar Intense", ("50 ml", 3500, False))),
    # one offer per line and size: what is in stock, then the cheapest, shown by its line
    ("Orioudh", "suggest", Q, "s", json.dumps({"resources": {"results": {"products": [{"title": "Foo Bar", "url": "/products/a"}, {"title": "Acme Foo Bar Eau de Parfum", "url": "/products/b"}]}}})),
    ("Orioudh", "json", None, "https://orioudh.com/products/a", product("Foo Bar 100 ml", ("100 ml", 3000, False))),
    ("Orioudh", "json", None, "https://orioudh.com/products/b", product("Acme Foo Bar Eau de Parfum 100 ml", ("100 ml", 3500, True), ("50 ml", 2000, True))),
    # a card needs a price; pages
    ("ParfumCity", "search", Q, "https://www.parfumcity.nl/search", links(("/products/x?a=1", "x", "Foo Bar € 9,99"), ("/products/y", "y", "Foo Bar"), ("/products/z", "z", "Foo 3,00 €")).replace("<body>", "<div>").replace("</body>", "</div>")),
    ("ParfumCity", "page", None, "https://www.parfumcity.nl/products/x", page("Foo Bar X", "9.99")),
    ("ParfumCity", "page", None, "https://www.parfumcity.nl/products/z", page("Foo Zed", "3")),
    # nothing on the search page: the sitemap
    ("PerfumeMarket", "search", Q, "https://www.perfumemarket.nl/nl/search", links(("/products/nothing", "Nothing", ""))),
    ("PerfumeMarket", "sitemap", None, "https://www.perfumemarket.nl/sitemap.xml", "<urlset><url><loc>https://www.perfumemarket.nl/products/foo-bar</loc></url><url><loc>https://www.perfumemarket.nl/products/foo</loc></url></urlset>"),
    ("PerfumeMarket", "page", None, "https://www.perfumemarket.nl/products/foo-bar/", page("Foo Bar", "12,50", stock="OutOfStock")),
    # the sitemap alone
    ("ParfumZentrum", "sitemap", None, "https://www.parfum-zentrum.de/s.xml", "<urlset>" + "".join(f"<url><loc>https://www.parfum-zentrum.de/foo-bar-{k:02d}_z{k}</loc></url>" for k in range(30)) + "<url><loc>https://www.parfum-zentrum.de/foo-bar</loc></url></urlset>"),
    *(("ParfumZentrum", "page", None, f"https://www.parfum-zentrum.de/foo-bar-{k:02d}_z{k}", page(f"Foo Bar No {k}", "5")) for k in range(30)),
    # any product link of the search page, judged by its page
    ("Deloox", "search", Q, "https://www.deloox.nl/zoeken.html?q=x", "<a href='https://www.deloox.nl/product/12/a.html?c=1#r'><img alt='Foo Bar'></a><a href='/product/13/b.html'>b</a><a href='/merk/foo-bar'>Foo Bar</a><a href='https://else.example/product/14/'>x</a>"),
    ("Deloox", "page", None, "https://www.deloox.nl/product/12/a.html", page("Foo Bar", "11", size="50 ml")),
    ("Deloox", "page", None, "https://www.deloox.nl/product/13/b.html", page("Other", "11")),
    # URLs in scripts
    ("Sabina", "search", Q, "https://www.sabina.com/en/search", "<a href='/en/one'>one</a><script>var u='https:\\/\\/www.sabina.com\\/it\\/two';</script>"),
    ("Sabina", "page", None, "https://www.sabina.com/en/one", page("Foo Bar One", "21")),
    ("Sabina", "page", None, "https://www.sabina.com/it/two", page("Foo Bar Two", "22")),
    # the best links; the card where there is no page
    ("Notino", "search", Q, "https://www.notino.fr/search", links(("/acme/foo-bar/p-1/", "Foo Bar", "30,00 € disponible"), ("/acme/foo/p-2/", "Foo", "10,00 €"), ("/acme/foo-bar-two/p-3/", "Acme Foo Bar Two", "31,00 €"))),
    ("Notino", "page", None, "https://www.notino.fr/acme/foo-bar-two/p-3", page("Foo Bar Two", "31.5")),
    ("Nowhere", "search", Q, "https://nowhere.example", links(("/products/a", "Foo Bar", ""))),
]


def documents(spark):
    return spark.createDataFrame(DOCUMENTS, "store string, kind string, query string, url string, body string").repartition(3)


def test_each_store(spark):
    jobs = spark.createDataFrame([(Q,), (Q,), ("eau de parfum",), ("100",), (None,)], "query string")
    rows = stores.store_offers(jobs, documents(spark))
    got = {}
    for r in normalized(rows, ("query",)).orderBy("store", "ingest_ord").collect():
        assert r.query == Q
        got.setdefault(r.store, []).append((r["name"], r.price_cents, r.availability, r.size_ml))
    assert got.pop("ParfumZentrum") == [(f"Foo Bar No {k}", 500, "in stock", None) for k in range(24)]
    assert got == {
        "Bplatz": [("Foo Bar", 2500, "in stock", None), ("Foo Bar Intense", None, "out of stock", None)],
        "Orioudh": [("foo bar", 3500, "in stock", 100.0), ("foo bar", 2000, "in stock", 50.0)],
        "ParfumCity": [("Foo Bar X", 999, "in stock", None)],
        "PerfumeMarket": [("Foo Bar", 1250, "out of stock", None)],
        "Deloox": [("Foo Bar", 1100, "in stock", 50.0)],
        "Sabina": [("Foo Bar One", 2100, "in stock", None), ("Foo Bar Two", 2200, "in stock", None)],
        "Notino": [("Foo Bar Two", 3150, "in stock", None), ("Foo Bar", 3000, "in stock", None)],  # equal scores go by URL
    }
    assert stores.store_offers(jobs, documents(spark).limit(0)).count() == 0 and stores.store_offers(jobs.limit(0), documents(spark)).count() == 0


def test_stores_as_connectors(spark):
    names = stores.connect(documents(spark))
    assert len(names) == 8
    found = Engine(spark, ["deloox", "bplatz", "sabina"]).search_validated("Foo Bar Eau de Parfum")
    assert [(r.store, r.price_cents) for r in found.select("store", "price_cents").collect()] == [("Deloox", 1100), ("Sabina", 2100), ("Sabina", 2200), ("Bplatz", 2500), ("Bplatz", None)]


def test_cards_by_intervals(spark):
    html = "<div><p>foo 3,00 €</p><section><div><a href='/a'>A <b>x</b></a><i>Bar</i></div><div><a href='/b' title='Foo Bar'>B</a></div></section></div>"
    rows = page_links(html, ["foo", "bar"], 5, True, None)
    assert [r[:7] for r in rows if r[0] == "link"] == [("link", 0, "/a", "A x", None, "card", 0), ("link", 1, "/b", "Foo Bar", None, "label", 0)]
    assert [r[6:] for r in rows if r[0] == "card"] == [(0, "foo 3,00 € A x Bar B")]
    assert [r[5] for r in page_links(html, ["foo", "bar"], 2, True, None) if r[0] == "link"] == [None, "label"]  # too far
    assert [r[6] for r in page_links(html, [], 5, False, None) if r[0] == "link"] == [0, 0]
    assert page_links(None, ["x"], 5, False, None) == [] and page_links("<a href=", [], 5, False, None) == []
    assert [r[2] for r in page_links('<a href="/x">1</a> "https:\\/\\/s.example\\/y" https://s.example/y', [], 0, False, r"https?://s\.example/\w+")] == ["/x", "https://s.example/y"]


def test_a_page_of_20000_links_takes_linear_memory(spark):
    html = "<body>" + "".join(f"<div><a href='/p/{k}'>link {k}</a></div>" for k in range(20_000)) + "<p>total 9,99 €</p></body>"
    df = spark.createDataFrame([("https://a.example/s", html), ("https://a.example/t", None)], "url string, html string")
    start = time.time()
    rows = listing(df)
    assert rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c")).orderBy("kind").collect()[0].n == 1
    found = link_rows(rows)
    assert found.count() == 20_000
    best = with_cards(found.filter("position < 3"), rows)
    assert [(r.url, r.label) for r in best.orderBy("position").collect()][:1] == [("https://a.example/p/0", "link 0")] and best.filter("card like '%9,99 €'").count() == 3
    assert time.time() - start < 60


def test_sitemap_trees(spark, tmp_path):
    """Three levels with a cycle, a packed map, a broken archive and maps that are missing."""
    import gzip

    from offerlane.sources.discovery import sitemap_files, sitemap_tree

    index = lambda *x: "<sitemapindex>" + "".join(f"<sitemap><loc>{y}</loc></sitemap>" for y in x) + "</sitemapindex>"
    urls = lambda *x: "<urlset>" + "".join(f"<url><loc>{y}</loc></url>" for y in x) + "</urlset>"
    (tmp_path / "packed.xml.gz").write_bytes(gzip.compress(urls("https://a/3", "https://a/1").encode()))
    (tmp_path / "broken.xml.gz").write_bytes(gzip.compress(urls("https://a/9").encode())[:-12])
    (tmp_path / "plain.xml").write_text(urls("https://a/4"))
    files = sitemap_files(spark, str(tmp_path))
    at = {r.url.rpartition("/")[2]: r for r in files.collect()}
    assert set(at) == {"packed.xml.gz", "broken.xml.gz", "plain.xml"} and at["broken.xml.gz"].xml is None
    packed, plain = at["packed.xml.gz"].url, at["plain.xml"].url
    rows = [
        ("root", index("second", "https://a/gone.xml", "own")), ("second", index("third", "root", packed)), ("third", index(plain, "second") ), ("own", urls("https://a/1", "https://a/2", "https://a/sitemap-x.xml")),
        ("https://a/sitemap-x.xml", urls("https://a/5")), ("lonely", urls("https://a/7")), ("bad", "<urlset><url><loc>https://a/8</loc>"),
    ]
    documents = spark.createDataFrame(rows, "url string, xml string").unionByName(files)
    roots = spark.createDataFrame([("root",), ("bad",), ("third",), ("root",), ("absent",)], "root string")
    got = {}
    for r in sitemap_tree(documents, roots).orderBy("root", "place").collect():
        got.setdefault(r.root, []).append((r.location, tuple(r.place)))
    assert got["root"] == [("https://a/4", (0, 0, 0, 0)), ("https://a/3", (0, 2, 0)), ("https://a/1", (0, 2, 1)), ("https://a/2", (2, 1)), ("https://a/5", (2, 2, 0))]
    assert got["bad"] == [("https://a/8", (0,))] and set(got) == {"root", "bad", "third"}
    assert [x for x, _ in sorted(got["third"], key=lambda x: x[1])] [:1] == ["https://a/4"] and len(got["third"]) == 5
    assert sitemap_tree(documents, roots, levels=1).filter("root = 'root'").count() == 2


def test_nested_products_and_the_offer_of_the_page(spark):
    from offerlane.sources.evidence import product_nodes, raw_offers

    nodes = product_nodes('[{"@graph": [{"@type": "WebPage", "mainEntity": {"@type": ["Thing", "Product"], "name": "A", "isRelatedTo": [{"@type": "Product", "name": "B"}]}}]}, {"x": {"y": [[{"@type": "Product", "name": "C"}]]}}]')
    assert [json.loads(x)["name"] for x in nodes] == ["A", "B", "C"] and product_nodes("{bad") == [] and product_nodes("3") == []
    offers = [{"price": "10", "name": "30 ml", "url": "/p/x?v=1"}, {"price": "20", "name": "50 ml", "url": "/p/x"}, {"price": "30", "name": "100 ml", "url": "/p/x/"}, {"price": "5", "url": "/p/y"}]

    def html(name, some):
        return '<script type="application/ld+json">' + json.dumps({"a": {"b": [{"@type": "Product", "name": name, "offers": some}]}}) + f"</script><h1>{name}</h1>"

    rows = [(1, html("X 50 ml", offers)), (2, html("X 75 ml", offers)), (3, html("X", offers)), (4, html("X 50 ml", [{"price": "7"}])), (5, html("X", [{"price": "9", "availability": "OutOfStock"}, {"price": "8", "url": "/p/z"}]))]
    df = spark.createDataFrame([(i, "https://a.example/p/x", h) for i, h in rows], "i int, url string, html string")
    assert {r.i: r.price for r in raw_offers(df).collect()} == {1: "20.0", 3: "10.0", 4: "7.0", 5: "8.0"}


def test_reader_discovery(spark):
    from offerlane.functions.text import url_parts
    from offerlane.sources.discovery import reader_discovery, reader_searches

    assert reader_searches("Foo Bar Parfum") == ["Foo Bar Parfum", "parfum bar foo", "foo", "bar"] and reader_searches(" ") == []
    urls = spark.createDataFrame([("https://n.example/acme-co/foo-bar-12345/p-77/?x=1",), ("https://n.example/acme/foo_bar-99999",), ("https://n.example/only",), (None,)], "u string")
    assert [tuple(r) for r in urls.select(*url_parts(F.col("u"))).collect()] == [("acme co", "foo bar"), ("acme", "foo_bar".replace("_", " ")), ("", ""), ("", "")]
    docs = [("Foo Bar", "## Acme\n[Foo](https://n.example/acme/foo/p-1)"), ("bar foo", "[Foo Bar](https://n.example/acme/foo-bar/p-2)"), ("acme foo bar", "[Foo Bar Two](https://n.example/acme/two/p-3) [x](https://n.example/acme/x/p-4)"), ("other", "[Foo Bar](https://n.example/no/p-5)")]
    maps = spark.createDataFrame([("https://n.example/acme/foo-bar-nine",), ("https://n.example/zzz",)], "location string")
    find = lambda d, **o: [(r.url.rpartition("/")[2], r.score, r.stage) for r in reader_discovery(spark.createDataFrame(d, "search string, markdown string"), maps, "Foo Bar", **o).collect()]
    assert find(docs) == [("p-2", 20, 0), ("p-3", 20, 1), ("p-1", 10, 0)]  # two with all words: no sitemap
    assert find(docs, least=1) == [("p-2", 20, 0), ("p-1", 10, 0)]
    assert find(docs[:2]) == [("p-2", 20, 0), ("foo-bar-nine", 20, 2), ("p-1", 10, 0)]
    assert reader_discovery(spark.createDataFrame(docs, "search string, markdown string"), maps, "eau de parfum").count() == 0
