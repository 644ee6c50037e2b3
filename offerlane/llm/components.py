"""Connected components of a graph given as pairs, as joins over DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlane.llm.common import written


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n indexes over the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label[a] == label[b]).all():
            break
    return label


def connected_components(pairs: DataFrame, max_rounds: int = 100) -> DataFrame:
    """pairs: two columns of one type. Returns node, component (the smallest node
    reachable); nodes without a pair are not in it.

    Defined cases: pairs in either direction or repeated count once; a pair of a node
    with itself, or with a null, is no pair; an empty table gives an empty table. Nodes
    with very many pairs are parted by Spark's skew joins; their minima are combined
    before any shuffle.

    In each round a node takes the smallest label of its neighbours and then the
    label of that label, so long chains shorten quickly. Minima are combined before
    the shuffle. Each round's labels are written, as the next reads them twice."""
    a, b = pairs.columns
    one = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    edges = written(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    for _ in range(max_rounds):
        own = labels.select(F.col("node").alias("a"), "label")
        heard = edges.join(own, "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("heard"))
        told = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        told = written(told, "labels")
        if told.filter("label <> old").isEmpty():
            break
        to = told.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = written(told.join(to, "label").select("node", F.least("label", "next").alias("label")), "labels")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return labels.select("node", F.col("label").alias("component"))
