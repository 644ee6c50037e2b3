"""Tables changed bucket by bucket, racing writers, and searches that read the files of their prefixes."""

import threading

import pytest
from pyspark.sql import functions as F

from offerlane.functions.text import norm_text
from offerlane.operators import search_index
from offerlane.operators.store import ProductIndex
from offerlane.operators.versions import VersionedTable


def table(spark, tmp_path, buckets=8):
    return VersionedTable(spark, str(tmp_path / "t"), "id string, v long", "id", buckets)


def rows(spark, ids, v):
    return spark.createDataFrame([(None if i is None else f"k{i}", v) for i in ids], "id string, v long")


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.read().count() == 0 and t.upsert(rows(spark, [], 1), ["v"]) == [] and t.versions() == []
    assert len(t.upsert(rows(spark, range(200), 1), ["v"])) == 8
    before = t.manifest()
    one = t.upsert(rows(spark, [5], 2).unionByName(rows(spark, [5], 3)).unionByName(rows(spark, [5], 1)), ["v"])
    after = t.manifest()
    assert len(one) == 1 and after["version"] == 2
    changed = {b for b in after["folders"] if after["folders"][b] != before["folders"][b]}
    assert changed == set(one)
    files = {r[0] for r in t.read().select(F.input_file_name()).distinct().collect()}
    old = {r[0] for r in t.read(manifest=before).select(F.input_file_name()).distinct().collect()}
    assert len(files - old) == 1 and len(files & old) == 7
    assert {r.id: r.v for r in t.read().collect()} == {f"k{i}": 3 if i == 5 else 1 for i in range(200)}
    assert t.read(manifest=before).filter("v = 3").count() == 0  # readers keep the version they have
    t.upsert(rows(spark, [None, None, 7], 9), ["v"])
    assert t.read().count() == 201 and t.duplicates().count() == 0
    assert t.vacuum(1) > 0 and t.read().count() == 201 and len(t.versions()) == 1


@pytest.mark.parametrize("apart", [True, False])
def test_racing_writers_lose_nothing(spark, tmp_path, apart):
    """Two writers at once, of other rows each or of the same rows: all changes are in, and the log has a version each."""
    t = table(spark, tmp_path, 4)
    t.upsert(rows(spark, range(40), 0), ["v"])
    start, errors = threading.Barrier(3), []

    def write(k):
        try:
            mine = VersionedTable(spark, t.path, t.schema, t.key, 4)
            start.wait()
            mine.upsert(rows(spark, range(100 + 10 * k, 110 + 10 * k) if apart else range(20), k + 1), ["v"])
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    [x.start() for x in threads], [x.join() for x in threads]
    assert not errors and len(t.versions()) == 4 and t.duplicates().count() == 0
    got = {r.id: r.v for r in t.read().collect()}
    if apart:
        assert got == {f"k{i}": 0 for i in range(40)} | {f"k{100 + i}": i // 10 + 1 for i in range(30)}
    else:
        assert {got[f"k{i}"] for i in range(20)} < {1, 2, 3} and len({got[f"k{i}"] for i in range(20)}) == 1 and len(got) == 40
    # the number of a version can be taken once
    m = t.manifest()
    assert not t._commit(m) and t.manifest() == m


def test_search_reads_the_files_of_its_prefixes(spark, tmp_path):
    index = ProductIndex(spark, str(tmp_path / "index"), 4)
    names = [f"{a}{b}{c} w{k}" for k, (a, b, c) in enumerate((a, b, c) for a in "abcdef" for b in "aeiou" for c in "lmn")]
    catalog = spark.createDataFrame([(f"P{k:03d}", "Acme" if k % 2 else "Bolt", n, ["é Ünder"] if k == 3 else []) for k, n in enumerate(names)], "product_id string, brand_name string, family_name string, aliases array<string>")
    nothing = F.lit(None).cast("string")
    index.upsert_products(catalog.withColumns({"brand_id": nothing, "concentration": nothing, "gender": nothing}))
    every = index.tables["terms"].read()
    for query in ("be", "be ac", "b", "acme dil w1", "under", "zz", ""):
        found = index.matching_terms(query)
        words = norm_text(query).split()
        assert sorted(map(tuple, found.collect())) == sorted(tuple(r) for r in every.collect() if any(r.term.startswith(w) for w in words))
        want = search_index.search(every, index.products(), "product_id", query)
        got = search_index.ranked(found, query, spark.createDataFrame([(len(names), every.agg(F.sum("tf")).first()[0])], "n_all long, len_all long"))
        assert [(r.doc, round(r.score, 9)) for r in got.collect()] == [(r.doc, round(r.score, 9)) for r in want.collect()]
    assert index.search("be ac").count() > 0 and index.search("under").first().product_id == "P003"
    files = lambda df: {r[0] for r in df.select(F.input_file_name()).distinct().collect()}
    assert 0 < len(files(index.matching_terms("bel"))) < len(files(every)) / 5
    plan = index.matching_terms("bel")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_part" in plan and "StringStartsWith(term,bel)" in plan
    index.upsert_products(index.products().limit(0))
    assert index.tables["terms"].versions() == [1]  # nothing changed, nothing is rebuilt
    index.ensure()
    assert index.tables["terms"].versions() == [1]
