"""Embedding near-dedup by sorted projection passes.

Only vectors of one label are compared. Equal vectors are one point. In each pass
points are ordered by label and by the concatenated signs of random projections;
each point is compared, in double precision, with the points before it within a
bounded window of that order, in a stream over range partitions, so that no group
of points is gathered. The points at both sides of a border between partitions are
compared with each other too. Verified pairs of all passes are united to components.

An exact count follows: within a component every point is compared with every
other, in pairs of blocks, and only counts of links leave the tasks.

Measured recall against brute force is in the README. A pair that no pass brings
near each other, directly or over others, is not found; each pass is a new order,
so passes make that rare, and there are more of them for larger labels.

Defined cases: a null, empty or zero vector, one with a null or non-finite component, a null
label and a null id link with nothing (0 links, a component of their own); labels
of any type are equal as SQL has it; very large and very small components neither
overflow nor vanish; vectors of different sizes don't link;
repeated rows are vectors of their own and link as copies; ties in the order go by
id; an empty table gives an empty table; other columns don't matter. Ids are of an integer
type; others are an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlane.llm.common import written
from offerlane.llm.components import connected_components, local_components

COSINE = 0.98
#: Passes up to CROWD points of a label, and passes more for each power of e beyond: the window covers less of a denser order.
PASSES, CROWD, MORE_PASSES = 10, 200_000, 2.5
#: Bits of an order, points before a point that it is compared with.
BITS, WINDOW, SEED = 63, 64, 7
#: Points of a range partition; points compared at once.
RANGE, STEP = 65_536, 512
#: Least and most points of a block of a component, and blocks that a component has in between.
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 128, 8192, 8


def _unit(vectors) -> np.ndarray:
    """Vectors of one size, scaled by powers of two (which is exact, and keeps squares finite), with norm 1."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _spanning(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    """Pairs that connect what the pairs of places (i, j) connect."""
    root = local_components(len(ids), i, j)
    at = np.flatnonzero(root != np.arange(len(ids)))
    return pd.DataFrame({"a": ids[at], "b": ids[root[at]]})


#: What a pass gives: linked pairs (a, b), or points at a border of two range partitions, on its first side or not.
PASS = "a long, b long, border long, first boolean, pid long, label string, vec array<double>"


def _links(batches, cosine: float, window: int):
    """Spanning pairs of the links within the window of a sorted stream of points, and
    the points at its ends, which have neighbours in the partitions on either side."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    ids, labels, x, last, seen = np.zeros(0, np.int64), np.zeros(0, object), None, None, 0

    def ends(some: pd.DataFrame, border: int, first: bool) -> pd.DataFrame:
        return pd.DataFrame({"a": None, "b": None, "border": border, "first": first, "pid": some["pid"], "label": some["label"], "vec": some["vec"]})

    for pdf in batches:
        if seen < window:
            yield ends(pdf.iloc[: window - seen], part, False)
        seen += len(pdf)
        last = pd.concat((last, pdf)).iloc[-window:] if last is not None and len(pdf) < window else pdf.iloc[-window:].copy()
        for k in range(0, len(pdf), STEP):
            some = pdf.iloc[k : k + STEP]
            for _, same in some.groupby(some["vec"].map(len).ne(some["vec"].map(len).shift()).cumsum()):  # runs of one size
                new, old = _unit(same["vec"]), len(ids)
                if x is not None and x.shape[1] != new.shape[1]:
                    ids, labels, x, old = ids[:0], labels[:0], None, 0
                ids = np.concatenate((ids, same["pid"].to_numpy(np.int64)))
                labels = np.concatenate((labels, same["label"].to_numpy(object)))
                x = new if x is None else np.concatenate((x, new))
                i, j = np.nonzero(new @ x.T >= cosine)
                i += old
                near = (j < i) & (i - j <= window)
                i, j = i[near], j[near]
                near = labels[i] == labels[j]
                found = _spanning(ids, i[near], j[near])
                if len(found):
                    yield found.assign(border=None, first=None, pid=None, label=None, vec=None)
                ids, labels, x = ids[-window:], labels[-window:], x[-window:]
    if last is not None:
        yield ends(last, part + 1, True)


def _over_border(pdf: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Spanning pairs of the links between the points on the two sides of a border."""
    found = [pd.DataFrame({"a": [], "b": []}, dtype="int64")]
    for _, same in pdf.groupby(["label", pdf["vec"].map(len)]):
        first = same["first"].to_numpy(bool)
        if first.any() and not first.all():
            x, ids = _unit(same["vec"]), same["pid"].to_numpy(np.int64)
            found.append(_spanning(ids, *np.nonzero((x @ x.T >= cosine) & (first[:, None] & ~first[None, :]))))
    return pd.concat(found)


def near_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, passes: int | None = None, window: int = WINDOW) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept. passes: how many, if not by the size of the largest label."""
    if df.schema[vec_id].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{vec_id} must be of an integer type; number the vectors first")
    v = F.col("vec")
    # vectors of floats travel as such; all arithmetic is in double precision
    same_type = df.schema[vector].dataType.simpleString() in ("array<float>", "array<double>")
    vec = F.col(f"`{vector}`") if same_type else F.col(f"`{vector}`").cast("array<double>")
    rows = df.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), vec.alias("vec"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    valid = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))
    good = rows.filter(valid)
    points = good.groupBy("label", "vec").agg(F.min("vec_id").alias("pid"), F.count("*").alias("copies"))
    points = written(points, "points")
    per_label = points.groupBy("label").agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    n, most = per_label[0] or 0, per_label[1] or 0
    if passes is None:
        passes = PASSES + max(0, round(MORE_PASSES * float(np.log(max(most, 1) / CROWD))))

    found, parts = None, max(1, -(-n // RANGE))
    for p in range(passes):
        ordered = points.select("pid", F.col("label").cast("string").alias("label"), "vec", _signs(v, p).alias("bits"))
        ordered = ordered.repartitionByRange(parts, "label", "bits", "pid").sortWithinPartitions("label", "bits", "pid")
        done = written(ordered.select("pid", "label", "vec").mapInPandas(lambda b: _links(b, cosine, window), PASS.replace("array<double>", points.schema["vec"].dataType.simpleString())), "pass")
        pairs = done.filter("a is not null").select("a", "b")
        if parts > 1:  # one partition has no borders
            over = done.filter("border is not null").groupBy("border").applyInPandas(lambda pdf: _over_border(pdf, cosine), "a long, b long")
            pairs = pairs.unionByName(over)
        found = pairs if found is None else found.unionByName(pairs)
    groups = connected_components(found)

    members = points.join(groups, F.col("pid") == F.col("node"))
    links = _count_links(members, cosine)
    smallest = groups.groupBy("component").agg(F.min("node").alias("component_id"))
    of = groups.join(smallest, "component").join(links, F.col("node") == F.col("of"), "left")
    of = of.select(F.col("node").alias("pid"), "component_id", F.coalesce("n", F.lit(0)).alias("n"))
    of = points.join(of, "pid", "left").select("label", "vec", F.coalesce("component_id", "pid").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = good.join(of, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~valid).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _signs(v, p: int):
    """BITS signs of random projections as one number, whose order is their lexicographic order."""

    @F.pandas_udf("long")
    def signs(vectors: pd.Series) -> pd.Series:
        out = np.zeros(len(vectors), np.int64)
        sizes = np.array([len(x) for x in vectors])
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            planes = np.random.default_rng([SEED, p, int(d)]).standard_normal((int(d), BITS))
            bits = _unit(vectors.iloc[at]) @ planes > 0
            out[at] = bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
        return pd.Series(out)

    return signs(v)


def _count_links(members: DataFrame, cosine: float) -> DataFrame:
    """of, n: for each point the vectors other than its own copies that it links with."""
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    block = F.greatest(F.lit(LEAST_BLOCK), F.least(F.lit(MOST_BLOCK), F.col("size") / BLOCKS))
    sized = members.join(sizes, "component").withColumn("blocks", F.ceil(F.col("size") / block))
    sized = sized.withColumn("block", F.pmod(F.xxhash64("pid"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = sized.select("component", "pid", "vec", "copies", "block", "blocks", other.alias("other"))
    # small components share tasks by hash; each pair of blocks of a large one is a task
    key = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(4096))).otherwise(F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")))
    dealt = dealt.select("component", "pid", "vec", "copies", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), key.alias("task"))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, lo, hi), own in pdf.groupby(["component", "lo", "hi"]):
            for _, same in own.groupby(own["vec"].map(len)):
                left, right = same[same["block"] == lo], same[same["block"] == hi]
                if not len(left) or not len(right):
                    continue
                near = _unit(left["vec"]) @ _unit(right["vec"]).T >= cosine
                if lo == hi:
                    np.fill_diagonal(near, False)
                out.append(pd.DataFrame({"of": left["pid"], "n": near @ right["copies"].to_numpy(np.int64)}))
                if lo != hi:
                    out.append(pd.DataFrame({"of": right["pid"], "n": near.T @ left["copies"].to_numpy(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"of": [], "n": []}, dtype="int64")

    return dealt.groupBy("task").applyInPandas(count, "of long, n long").groupBy("of").agg(F.sum("n").alias("n"))
