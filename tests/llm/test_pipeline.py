"""The pipeline, stage by stage, and the queries with SQL."""

import os
import re

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark):
    import corpus_pipeline
    from offerlane.llm.common import written

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DATA), "stage")
        seen.append(docs.toPandas())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    start, quality, lines, near, mix, bpe = seen
    assert 0 < len(quality) < len(start) and len(lines) == len(quality) and 0 < len(near) < len(lines)
    assert near.doc_id.is_unique and set(mix.doc_id) <= set(near.doc_id) and sorted(bpe.doc_id) == sorted(mix.doc_id)
    total = sum(len(WORD.findall(t)) for t in near.text)
    assert abs(sum(len(WORD.findall(t)) for t in mix.text) - total) < 0.05 * total
    assert (mix.n_chars == mix.text.str.len()).all() and (lines.n_chars == lines.text.str.len()).all()
    assert corpus_pipeline.run(spark, DATA).count() == len(bpe)


AWKWARD = [
    (1, "The cat of the house sat on the mat and it was in the sun. " + " ".join(f"of the word{k}" for k in range(40)) + "\nfooter line", "en", "s", 0), (1, None, "en", "s", None),
    (2, "", "en", None, 0), (3, " ".join(f"to the term{k}" for k in range(60)) + "\nfooter line", "en", "s", 9), (3, " ".join(f"to the term{k}" for k in range(60)) + "\nfooter line", "en", "s", 9),
    (4, " ".join(f"to the term{k}" for k in range(60)) + " end\nfooter line", None, "s", 9), (None, " ".join(f"in the house{k}" for k in range(60)), "en", "t", 1), (None, " ".join(f"on the tree{k}" for k in range(60)), "en", "t", 1),
    (5, " ".join(f"of w{k % 977} v{k}" for k in range(20_000)), "en", None, 5), (6, "BUY!! NOW!! " * 40, "en", "s", 1), (7, " ".join(f"from the river{k}" for k in range(70)), "en", "s", 1),
]


def test_stages_by_brute_force(spark):
    """Each stage on what the one before kept of awkward rows: nulls, repeated and very long ones, clashing columns."""
    import hashlib
    from collections import Counter

    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from offerlane.llm.common import written
    from offerlane.llm.quality import RULES, STOP_WORDS
    from test_ops import simhash

    schema = "doc_id long, text string, lang string, source string, n_chars long, quality string, row int, fp int, sid int"
    docs = spark.createDataFrame([(*r, "q", 1, 2, 3) for r in AWKWARD], schema).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    kept = [r for r in AWKWARD if r[1] and len(WORD.findall(r[1])) >= 50 and "BUY" not in r[1]]
    assert RULES and STOP_WORDS
    now = written(stages["quality rules"](spark, docs, DATA), "t")
    as_rows = lambda df: sorted(((r.doc_id, r.text, r.lang, r.source) for r in df.collect()), key=str)
    assert now.columns == docs.columns and as_rows(now) == sorted((r[:4] for r in kept), key=str)

    pages = Counter(r[3] for r in kept)
    on = Counter((r[3], x.strip()) for r in kept for x in set(r[1].split("\n")) if x.strip())
    gone = {k for k, n in on.items() if n >= 2 and n > 0.05 * pages[k[0]]}
    lines = [(r[0], "\n".join(x for x in r[1].split("\n") if (r[3], x.strip()) not in gone), *r[2:]) for r in kept]
    now = written(stages["line dedup"](spark, now, DATA), "t")
    assert now.columns == docs.columns and as_rows(now) == sorted((r[:4] for r in lines), key=str)
    assert all(r.n_chars == len(r.text) for r in now.collect())

    prints = [simhash(r[1]) for r in lines]
    group = list(range(len(lines)))
    for _ in lines:
        group = [min(group[j] for j in range(len(lines)) if bin(prints[i] ^ prints[j]).count("1") <= 3) for i in range(len(lines))]
    best = {}
    for r, g in zip(lines, group):
        best.setdefault(g, []).append((r[0] is None, r[0] or 0))
    now = written(stages["SimHash near-dedup"](spark, now, DATA), "t")
    assert now.columns == docs.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in now.collect()) == sorted(min(x) for x in best.values())

    before = {(r.doc_id, r.text): r for r in now.collect()}
    total = sum(len(WORD.findall(t)) for _, t in before)
    now = written(stages["mixing sources to target weights"](spark, now, DATA), "t")
    mixed = now.collect()
    assert now.columns == docs.columns and abs(sum(len(WORD.findall(r.text)) for r in mixed) - total) <= 64 * 3 + 0.005 * total  # a block and half a percent per source
    for r in mixed:
        source = [t for (i, t) in before if i == r.doc_id and set(WORD.findall(r.text)) <= set(WORD.findall(t))]
        assert source and max(Counter(WORD.findall(r.text)).values()) <= 3 * max(Counter(WORD.findall(source[0])).values()) and r.n_chars == len(r.text)

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = []
    for r in mixed:
        ids = t.encode(r.text, add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, stages["BPE encoding and decoding"](spark, now, DATA).collect()), key=str) == sorted(want, key=str)

    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0, name
    bare = docs.select("doc_id", "text", "source")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, bare, DATA).columns == bare.columns, name


@pytest.mark.parametrize("name", ["op2_quality_rules", "op10_line_dedup", "page_line_dedup", "op8_embedding_dedup"])
def test_sql(spark, name):
    from offerlane.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA).toPandas(), con.sql(ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(str, got[cols].itertuples(index=False, name=None))) == sorted(map(str, want[cols].itertuples(index=False, name=None)))


def test_every_operator_has_a_query():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
