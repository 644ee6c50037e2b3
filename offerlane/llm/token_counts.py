"""Token counts by an exact length histogram.

Each document is encoded once and only its number of tokens is kept. Documents
are then counted by length, and suffix sums over the lengths answer every
question about totals, quantiles and truncation without another pass.

The histogram can have as many rows as there are lengths, so its running sums are
taken in two steps: over blocks of BLOCK lengths (few rows), and within a block.

Defined cases: null and empty texts have 0 tokens and count as documents; very
long texts are encoded whole; repeated rows count each; an empty table gives an
empty histogram; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlane.llm.common import written

#: Lengths whose running sums are taken together.
BLOCK = 1024


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str, pattern: str) -> Column:
    """Number of tokens of each whole text under the rank file at path."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoding(path, pattern).encode_ordinary
        return pd.Series([len(encode(x)) if x else 0 for x in texts], dtype="int64")

    return count(text)


def length_histogram(lengths: DataFrame, length: str = "n_tokens", block: int = BLOCK) -> DataFrame:
    """For every length that occurs, as a context limit:

    context_limit, n_docs (documents of just that length), docs_longer and
    tokens_longer (documents above the limit and all their tokens), total_docs,
    total_tokens, truncated_tokens (tokens left if every document is cut to the
    limit), share_within (share of documents that fit)."""
    counts = lengths.groupBy(F.col(length).cast("long").alias("context_limit")).agg(F.count("*").alias("n_docs"))
    counts = written(counts, "lengths")  # read twice below, encoded once
    counts = counts.withColumn("tokens", F.col("context_limit") * F.col("n_docs")).withColumn("block", F.floor(F.col("context_limit") / block))
    after = Window.orderBy(F.col("block").desc())
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select(
        "block",
        *(F.coalesce(F.sum(c).over(after.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"{c}_after") for c in "dt"),
        *(F.sum(c).over(after.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"{c}_all") for c in "dt"),
    )
    within = Window.partitionBy("block").orderBy(F.col("context_limit").desc()).rowsBetween(Window.unboundedPreceding, -1)
    joined = counts.join(blocks, "block")
    joined = joined.withColumn("docs_longer", F.col("d_after") + F.coalesce(F.sum("n_docs").over(within), F.lit(0)))
    joined = joined.withColumn("tokens_longer", F.col("t_after") + F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    return joined.select(
        "context_limit",
        "n_docs",
        "docs_longer",
        "tokens_longer",
        F.col("d_all").alias("total_docs"),
        F.col("t_all").alias("total_tokens"),
        (F.col("t_all") - F.col("tokens_longer") + F.col("context_limit") * F.col("docs_longer")).alias("truncated_tokens"),
        ((F.col("d_all") - F.col("docs_longer")) / F.col("d_all")).alias("share_within"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> int:
    """Tokens left if every document is cut to limit; limit need not occur in the histogram."""
    below = histogram.filter(F.col("context_limit") <= limit)
    row = below.agg(F.max_by(F.struct("docs_longer", "tokens_longer", "total_tokens"), "context_limit").alias("x")).first()["x"]
    if row is None:  # all documents are longer, or there are none
        return limit * (histogram.agg(F.max("total_docs")).first()[0] or 0)
    return row["total_tokens"] - row["tokens_longer"] + limit * row["docs_longer"]


def length_quantile(histogram: DataFrame, q: float) -> int | None:
    """The smallest length that at least a share q of the documents do not exceed."""
    return histogram.filter(F.col("total_docs") - F.col("docs_longer") >= F.ceil(q * F.col("total_docs"))).agg(F.min("context_limit")).first()[0]
