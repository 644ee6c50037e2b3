"""Extraction from page text and Markdown."""

from pyspark.sql import functions as F

from offerlane.sources import extract


def values(spark, f, rows):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_page_price(spark):
    rows = ["150 ml 40,00 € 26,67 € / 100 ml", "prix actuel de 35,50 € was 50,00 €", "26,67 € / 100 ml", "29,90 € 50 ml", "old 10,00 € now 12,00 €", "nothing", None]
    assert values(spark, extract.page_price, rows) == [4000, 3550, None, 2990, 1200, None, None]


def test_candidate_price(spark):
    df = spark.createDataFrame([([0.0, 20000.0, 12.5],), ([],)], "p array<double>")
    assert [r[0] for r in df.select(extract.candidate_price(F.col("p"))).collect()] == [12.5, None]


def test_cards(spark):
    assert values(spark, extract.card_stock, ["Indisponible", "Disponible", "x", None]) == ["out_of_stock", "in_stock", "unknown", "unknown"]
    assert values(spark, extract.card_name, ["Promo Foo Bar Foo Bar 12,50 €", "Foo 4,5/5 (12)", "A B A B C"]) == ["Foo Bar", "Foo", "A B A B C"]


def test_fuzzy(spark):
    df = spark.createDataFrame([(0, "red plate"), (1, None)], "i int, name string")
    a, b = extract.with_fuzzy_hits(df, "name", "redd plate").orderBy("i").collect()
    assert a.hits == {"redd": True, "plate": True} and a.fuzzy == 1
    assert b.hits == {"redd": False, "plate": False} and b.fuzzy == 0


def test_markdown(spark):
    text = "## Acme\n### Foo\n[Foo 100](https://s.example/foo-100) and [x](https://s.example/x)\n## Other\n[y](/y)"
    got = extract.markdown_candidates(spark.createDataFrame([(1, text), (2, None)], "doc_id int, markdown string"))
    assert [(r.label, r.url, r.brand, r["product"]) for r in got.orderBy("line", "url").collect()] == [("Foo 100", "https://s.example/foo-100", "Acme", "Foo"), ("x", "https://s.example/x", "Acme", "Foo"), ("y", "/y", "Other", "Foo")]
    best = extract.ranked_candidates(got.select("url", "label"), "acme foo")
    assert [(r.url, r.score) for r in best.collect()] == [("https://s.example/foo-100", 10)]


def test_fuzzy_hits_equal_the_matcher_name_by_name(spark):
    """All names as a loop with the standard library's matcher finds them; few pairs are compared."""
    from difflib import SequenceMatcher
    from random import Random

    from offerlane.functions.text import norm_text, query_tokens
    from offerlane.sources.extract import LENGTH, RATIO, alike_words, with_fuzzy_hits

    r = Random(4)
    base = ["redd", "plates", "plate", "red", "platter", "spate", "pleats", "aaaa", "abab", "baba", "redrum", "x"]
    words = base + ["".join(r.sample(w, len(w))) for w in base] + [w[:k] + r.choice("abexz") + w[k:] for w in base for k in (0, 2)] + ["".join(r.choice("aelprst") for _ in range(r.randint(1, 9))) for _ in range(300)]
    names = [" ".join(r.choice(words) for _ in range(r.randint(1, 5))) for _ in range(700)] + ["", None, "Rédd PLATES", "plates plates"]
    df = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    for query in ("redd plates abab", "eau", ""):
        wanted = query_tokens(query)
        for row in with_fuzzy_hits(df, "name", query).collect():
            own = set(norm_text(row.name if isinstance(row.name, str) else names[row.i]).split())
            longest, hits, fuzzy = max(map(len, own), default=0), {}, 0
            for w in wanted:
                hits[w] = w in own
                if not hits[w] and own and abs(len(w) - longest) <= LENGTH:
                    hits[w] = max(SequenceMatcher(None, w, x).ratio() for x in own) >= RATIO
                    fuzzy += hits[w]
            assert (row.hits, row.fuzzy) == (hits, fuzzy), names[row.i]
    known = spark.createDataFrame([(w,) for w in words], "word string")
    want = {(w, x) for w in ("redd", "plates", "abab") for x in set(words) if w != x and SequenceMatcher(None, w, x).ratio() >= RATIO}
    assert {tuple(x) for x in alike_words(known, "redd plates abab").collect()} == want and len(want) > 5
    assert with_fuzzy_hits(df.limit(0), "name", "redd").count() == 0
