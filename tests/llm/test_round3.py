"""Filter audit, collocations and decontamination against brute force, on small tables with awkward rows."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations
from random import Random

import pytest
from pyspark.sql import functions as F

RNG = Random(5)
VOCABULARY = ["of", "the", "house", "tree", "New", "York", "city", "a", "b", "x&y", "É", "été", "hot", "dog"]


def prose(n, seed):
    r = Random(seed)
    return " ".join(r.choice(VOCABULARY) + r.choice(["", "", "", ",", ".", "\n", " \t", "!?"]) for _ in range(n))


TEXTS = [(k, prose(RNG.randint(0, 400), k), RNG.choice(["en", "fr", None, "und"]), RNG.choice(["s1", "s1", "s2", None, ""])) for k in range(60)]
TEXTS += [
    (100, None, "en", "s1"), (101, "", "en", "s1"), (102, "", None, "s3"), (103, TEXTS[5][1], "en", "s1"), (5, TEXTS[5][1], "en", "s1"), (None, TEXTS[5][1], "en", "s2"),
    (104, "same " * 300, "fr", "s2"), (105, "same " * 300, "fr", "s2"), (106, "CAPS WORD " * 150, "fr", "s2"), (107, "$5 | 3", "fr", "s2"), (108, prose(60000, 1), "en", "s1"),
    (109, "one", "en", "s1"), (112, " ".join(f"clean{i}" for i in range(250)), "en", "s1"), (110, " ".join(f"w{i}" for i in range(30)), "en", "s1"), (111, "\x00new\x00york\x1fcity", "xx", "s1"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n int, part string, word string, row long, fails string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    """Columns n, part, word, row and fails clash with names that operators use."""
    return spark.createDataFrame([(*r, 3, "p", "w", 4, "f") for r in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_audit(spark, docs, empty):
    from offerlane.llm.audit import audit

    labels = [(k, int(k % 3 == 0), int(k % 4 == 0)) for k in range(0, 60, 2)] + [(104, 1, 1), (104, 0, 0), (105, None, 1), (None, 1, 1), (999, 1, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    marks = defaultdict(lambda: (False, False))
    for r in labels.collect():
        marks[r.doc_id] = (marks[r.doc_id][0] or r.quality == 1, marks[r.doc_id][1] or r.toxic == 1)
    marks[None] = (False, False)
    first = {}
    for i, t, _, _ in TEXTS:
        first[t or ""] = min((x for x in (first.get(t or ""), i) if x is not None), default=None)
    rows = []
    for i, t, _, s in TEXTS:
        t = t or ""
        w = WORD.findall(t)
        fails = {f for f, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search("[#$%&*|]", t), i is not None and i > first[t])) if bad}
        rows.append((s or "", fails, *marks[i]))
    want, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = [r for r in rows if r[0] == part and f in r[1]]
                want[part, "".join(order), k + 1] = (len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in failing), sum(r[2] for r in gone), sum(r[3] for r in gone))
                shapley[part, f] += len(gone)
    got = {(r.part, r.filter_order, r.step): (tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), r.shapley) for r in audit(docs, labels).collect()}
    assert got == {k: (v, shapley[k[0], k[1][k[2] - 1]]) for k, v in want.items()}
    assert {"", "s3"} <= {k[0] for k in got} and len(got) == 600 * 4
    assert audit(empty, labels).count() == 0
    assert audit(docs, labels.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0


def test_audit_walks_each_state_once(spark, docs, tmp_path):
    """31 states with an edge, 80 edges, none of the survivors stays in memory."""
    from offerlane.llm.audit import removals, with_failures

    rows = with_failures(docs).withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    held = set(spark.sparkContext._jsc.getPersistentRDDs())  # of other tests
    found = removals(rows, "ABCDE")
    assert found.select("state").distinct().count() == 31 and found.select("state", "filter").distinct().count() == 80
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= held


def brute_collocations(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for t, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", folded(t)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = set()
    for lang, c in f.items():
        long = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in long.items():
            if len(p) == 2 and any(100 * x >= 50 * a for q, x in long.items() if len(q) == 3 and p in (q[:2], q[1:])):
                continue
            s, _, left, right = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-s, -a, " ".join(p).encode(), left, right))
        out |= {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])}
    return out


@pytest.mark.parametrize("part_bytes", [1 << 24, 2000])
def test_collocations(docs, empty, part_bytes, monkeypatch):
    from offerlane.llm import collocations as m

    monkeypatch.setattr(m, "PART_BYTES", part_bytes)
    original = m.phrases
    monkeypatch.setattr(m, "phrases", lambda *a: original(*a, part_bytes=part_bytes))
    want = brute_collocations([(t, lang or "und") for _, t, lang, _ in TEXTS], 10, 40)
    got = m.collocations(docs, top=40)
    assert {tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()} == want and len(want) > 80
    assert m.collocations(empty).count() == 0


def test_collocation_scores_are_exact(spark):
    """Products over 64 bits, as Python has them."""
    from offerlane.llm.collocations import _score

    rows = [(10**12 + k, 10**13 + 7 * k, 10**14 + k * k) for k in range(50)] + [(7, 7, 7)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", _score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(r.s == 1000000 * r.a * r.a // (r.l * r.r) for r in got)


def test_longer_phrases(spark):
    """Cuts and cover of phrases of four words, from the same parents."""
    from offerlane.llm.collocations import collocations

    df = spark.createDataFrame([("a b c d. " * 12 + "a b. " * 40,)], "text string").withColumn("lang", F.lit(None).cast("string"))
    got = {r.phrase: r for r in collocations(df, max_words=4).collect()}
    assert set(got) == {"a b", "a b c d"}
    assert (got["a b c d"].a, got["a b c d"].l, got["a b c d"].r, got["a b c d"].score) == (12, 52, 12, 1000000 * 144 // (52 * 12))


def brute_hits(texts, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall(folded(t))
        m = min(10, len(w))
        for k in range(len(w) - m + 1) if m else ():
            windows[tuple(w[k : k + m])].add(i)
    out = []
    for i, t in texts:
        w = word.findall(folded(t))
        hit, found = set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if own := windows.get(tuple(w[k : k + m])):
                    hit |= set(range(k, k + m))
                    found |= own
        ids = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [1 << 26, 1 << 15])
def test_decontamination(spark, docs, empty, bits):
    """Long, short, equal, empty and null items; a bitmap so small that it passes nearly all."""
    from offerlane.llm.decontaminate import benchmark_hits, digest

    long = prose(300, 9)
    items = [(1, "new york"), (2, "House"), (10, long[:200]), (11, " ".join(f"w{i}" for i in range(5, 25))), (12, " ".join(f"w{i}" for i in range(5, 15))), (13, None), (14, "..."), (None, "été"), (15, "of the house tree"), (15, "of the house tree"), (16, TEXTS[7][1])]
    items = [x for x in items] + [(20 + k, TEXTS[k][1]) for k in range(20, 25)]
    more = [(500, "Intro: " + long[:200] + " end"), (500, long), (501, "w4 " + " ".join(f"W{i}" for i in range(5, 14))), (502, " ".join(f"w{i}" for i in range(5, 15)) * 2)]
    all_docs = docs.select("doc_id", "text", "lang", "row").unionByName(spark.createDataFrame([(i, t, "en", 1) for i, t in more], "doc_id long, text string, lang string, row long"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, digest(benchmark_hits(all_docs, bench, bits=bits)).collect()), key=str)
    assert got == brute_hits([(i, t) for i, t, *_ in TEXTS] + more, items)
    assert sum(r[5] for r in got) > 20 and not all(r[5] for r in got)
    assert benchmark_hits(empty, bench).count() == 0
    clean = digest(benchmark_hits(all_docs, bench.limit(0))).collect()
    assert len(clean) == len(got) and not any(r.contaminated for r in clean)
