"""Column functions on literal rows."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from offerlane.functions import classify, measures, text


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_norm(spark):
    rows = ["9PM Éau 100ML", "Straße", "L’Éclat Nº5", None, "", "  a--b c "]
    assert values(spark, text.norm, rows) == ["9 pm eau 100 ml", "stra e", "l eclat no 5", "", "", "a b c"]


def test_norm_equals_driver_rule(spark):
    rows = ["Ünïcödé 5x", "ÀÉÎõü", "1a2b3c", "ça va?", "№ 5 ™"]
    assert values(spark, text.norm_strict, rows) == [text.norm_text(x) for x in rows]
    assert values(spark, text.norm, rows[:4]) == [text.norm_text(x) for x in rows[:4]]


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=40))
def test_norm_text_is_idempotent(x):
    assert text.norm_text(text.norm_text(x)) == text.norm_text(x)


def test_norm_ascii_and_clean(spark):
    assert values(spark, text.norm_ascii, ["Éa-1"]) == ["a 1"]
    assert values(spark, text.clean, [" a  \n b ", None]) == ["a b", ""]


def test_stable_id(spark):
    df = spark.range(1)
    parts = ["StoreA", "SH-1", "", "100", "https://a.example/p/1"]
    assert df.select(text.stable_id("OFFER", *(F.lit(p) for p in parts))).first()[0] == "OFFER-30a884a862d6112a"
    parts[3] = None
    assert df.select(text.stable_id("OFFER", *(F.lit(p).cast("string") for p in parts))).first()[0] == "OFFER-785d06580019fc52"


def test_search_attempts(spark):
    rows = ["Foo Eau de Parfum 100ml", "foo", "", None, "ml"]
    assert values(spark, text.search_attempts, rows) == [["Foo Eau de Parfum 100ml", "foo 100"], ["foo"], [], [], ["ml"]]


def test_query_codec(spark):
    rows = ["Éclat 5", "a", "ab", "abc?>"]
    codes = values(spark, text.encode_query, rows)
    assert values(spark, text.decode_query, [f"id.{c}" for c in codes]) == rows
    assert text.job_id("Éclat 5", "u") == f"u.{codes[0]}"


def test_product_line(spark):
    df = spark.createDataFrame([("Titan", "Vendor"), ("Vendor - Titan Uomo", "Vendor"), ("Liquid Brun Limited Edition 100 ml EDP", "F"), ("Uomo", "V")], "n string, v string")
    assert [r[0] for r in df.select(text.product_line(F.col("n"), F.col("v"))).collect()] == ["titan", "titan", "liquid brun limited edition", "uomo"]


def test_prices(spark):
    assert values(spark, measures.price_num, ["12,34 €", "1.299,00", "", None, "x"]) == [12.34, 1.29, None, None, None]
    assert values(spark, measures.money, ["1.299,00", "1,299.00", "12,5", "", None, "-"]) == [1299.0, 1299.0, 12.5, None, None, None]
    df = spark.createDataFrame([("26,67 €/100 ml", 150.0), ("26,67 €", 150.0), ("10 per 100ml", None)], "p string, s double")
    got = [r[0] for r in df.select(measures.actual_price(F.col("p"), F.col("s"))).collect()]
    assert got[0] == pytest.approx(40.01, abs=0.011) and got[1:] == [None, None]
    assert values(spark, measures.euro_text, [1205, 7], "bigint") == ["12,05 €", "0,07 €"]


def test_sizes(spark):
    rows = ["10 cl", "Foo 100ml", "no size", "1 l", "2,5 cl", None]
    assert values(spark, measures.size_ml, rows) == [100.0, 100.0, None, None, 25.0, None]
    assert values(spark, measures.index_size_ml, rows) == [100.0, 100.0, None, 1000.0, 25.0, None]
    assert values(spark, measures.gtin, ["ab 12-3", "", None]) == ["123", None, None]


def test_classes(spark):
    rows = ["X EDP", "X extrait", "eau de toilette", "nothing", None]
    assert values(spark, classify.concentration, rows) == ["Eau de Parfum", "Extrait de Parfum", "Eau de Toilette", None, None]
    assert values(spark, classify.gender, ["pour homme", "for women", "unisex", "x"]) == ["men", "women", "unisex", "unknown"]
    assert values(spark, lambda x: classify.availability_rank(classify.availability(x)), ["In_Stock", "available", "Out of stock", "", "https://schema.org/InStock"]) == [0, 0, 1, 2, 3]


@pytest.mark.parametrize(
    ("name", "query", "reason"),
    [
        ("Brand Foo 100 ml", "foo", None),
        ("Foo Gift Set", "foo", "non_perfume_phrase"),
        ("Foo Gift Set", "foo gift set", None),
        ("Sunset Foo", "foo", "non_perfume_phrase"),
        ("Foo 5 ml", "foo", "small_size_without_query_size"),
        ("Foo 5 ml", "foo 5 ml", None),
        ("Foo Bar", "bar foo", "family_phrase_not_in_name_phrase"),
        ("", "foo", "empty_product_name"),
        ("Foo", "", "empty_query"),
        ("Foo", "100 ml", "empty_family_tokens"),
        ("Eau de Parfum", "foo", "empty_matching_phrase"),
    ],
)
def test_reject_reason(spark, name, query, reason):
    df = spark.createDataFrame([(name,)], "name string").select(text.norm("name").alias("n"), measures.size_ml(F.col("name")).alias("s"))
    assert df.select(classify.reject_reason(query, F.col("n"), F.col("s"), F.col("n"))).first()[0] == reason
