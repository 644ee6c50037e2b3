"""Filter interaction audit by permutation-trie execution.

The orders of some filters make a trie: a node is a prefix of an order, an edge applies one
filter more. The state at a node is the DataFrame of the documents that survive its
prefix; it depends on the set of filters only, so the nodes with one set share one
state (5 filters: 31 states with an edge, 80 edges, instead of 325 nodes).

The trie is walked depth first. A state is persisted, the removals at all its edges are
counted in one job and written, its children are filtered from it, and it is
unpersisted when the walk leaves it, so as many states are held as there are
filters. Survivors are narrow rows: each text is judged once, by built-in
expressions, and the verdicts are written.

Defined cases: null texts are empty, fail only what an empty text fails, and are copies
of empty texts; a null id is smaller than none and larger than none; documents with equal
ids count each, and are no copies of one another by that; labels repeated for an id count if
any row says so, documents without labels are neither good nor toxic; a null part is
the empty string, together with rows that say so; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import uuid
from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlane.llm.common import let, shared_dir, words_of, written

#: Thresholds of the filters.
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT, SYMBOLS = 200, 50, 2, "[#$%&*|]"

#: Filters that look at one text alone: name and condition of failure. E, copies, needs all texts.
FILTERS = {
    "A": lambda text, words: F.size(words) < MIN_WORDS,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * F.size(words),
    "C": lambda text, words: 100 * F.regexp_count(text, F.lit("[A-Z]")) > MAX_CAPITAL_PERCENT * F.char_length(text),
    "D": lambda text, words: text.rlike(SYMBOLS),
}
COPIES = "E"


def with_failures(df: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """doc_id, part and fails (a struct of a boolean per filter) of each document."""
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    judged = let(words_of(raw), lambda w: F.struct(*(fails(raw, w).alias(f) for f, fails in FILTERS.items())))
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.sha2(raw, 256).alias("digest"), judged.alias("fails"))
    rows = written(rows, "judged")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.join(firsts, "digest", "left").select("doc_id", "part", F.col("fails").withField(COPIES, copy).alias("fails"))


def removals(survivors: DataFrame, filters: str) -> DataFrame:
    """part, state (filters applied, in order of the alphabet), filter, n, removed, good_lost and
    toxic_lost for each edge of the trie and each part that the state has. survivors: part, fails, good, toxic of all documents."""
    spark = survivors.sparkSession
    path = f"{shared_dir(spark)}/removals-{uuid.uuid4().hex}"
    seen = set()

    def visit(state: frozenset, rows: DataFrame) -> None:
        if state in seen or len(state) == len(filters):
            return
        seen.add(state)
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        left = [f for f in filters if f not in state]
        counts = [F.count("*").alias("n")]
        for f in left:
            gone = F.col("fails")[f]
            counts += [F.count_if(gone).alias(f"removed_{f}"), F.count_if(gone & F.col("good")).alias(f"good_{f}"), F.count_if(gone & F.col("toxic")).alias(f"toxic_{f}")]
        edges = [F.struct(F.lit(f).alias("filter"), F.col(f"removed_{f}").alias("removed"), F.col(f"good_{f}").alias("good_lost"), F.col(f"toxic_{f}").alias("toxic_lost")) for f in left]
        counted = rows.groupBy("part").agg(*counts)
        counted.select("part", F.lit("".join(sorted(state))).alias("state"), "n", F.inline(F.array(*edges))).write.mode("append").parquet(path)
        for f in left:
            visit(state | {f}, rows.filter(~F.col("fails")[f]))
        rows.unpersist()

    visit(frozenset(), survivors)
    return spark.read.schema("part string, state string, n long, filter string, removed long, good_lost long, toxic_lost long").parquet(path)


def audit(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    filters = "".join([*FILTERS, COPIES])
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = with_failures(df, text, doc_id, part).join(marks, "doc_id", "left")
    rows = written(rows.select("part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")), "verdicts")

    orders = ["".join(p) for p in permutations(filters)]
    trie = [("".join(sorted(p[:k])), p[k], p, k + 1) for p in orders for k in range(len(p))]
    steps = df.sparkSession.createDataFrame(trie, "state string, filter string, filter_order string, step int")
    edges = sorted({(state, f) for state, f, _, _ in trie})

    def alone(f: str) -> Column:
        others = [F.col("fails")[g] for g in filters if g != f]
        found = F.col("fails")[f]
        for other in others:
            found = found & ~other
        return F.count_if(found)

    per_filter = [F.struct(F.lit(f).alias("filter"), F.count_if(F.col("fails")[f]).alias("failing"), alone(f).alias("unique_fails")) for f in filters]
    parts = rows.groupBy("part").agg(F.array(*per_filter).alias("by_filter")).select("part", F.inline("by_filter"))
    counted = removals(rows, filters)
    grid = parts.join(F.broadcast(df.sparkSession.createDataFrame(edges, "state string, filter string")), "filter")  # 80 rows
    full = grid.join(counted, ["part", "state", "filter"], "left").na.fill(0, ["n", "removed", "good_lost", "toxic_lost"])
    full = full.join(F.broadcast(steps), ["state", "filter"])  # 600 rows
    return full.select(
        "part", "filter_order", "step", (F.col("n") - F.col("removed")).alias("kept"), "removed", (F.col("failing") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )
