"""Prefix full-text search over an inverted index, ranked by BM25."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlane.functions.text import norm_text, search_words

#: Fixed values of the ranking: k1, b, and the least inverse document frequency.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def index_terms(docs: DataFrame, key: str, *fields: str) -> DataFrame:
    """One row per (document, term): key, term, tf over all fields, and doc_len."""
    words = search_words(F.concat_ws(" ", *(F.col(f) for f in fields)))
    rows = docs.select(F.col(key).alias("doc"), words.alias("words")).select("doc", F.size("words").alias("doc_len"), F.explode("words").alias("term"))
    return rows.groupBy("doc", "doc_len", "term").agg(F.count("*").alias("tf"))


def search(terms: DataFrame, docs: DataFrame, key: str, query: str, limit: int | None = None) -> DataFrame:
    """Documents with a word beginning with each word of the query: doc and score,
    best (most negative) first. An empty query finds nothing."""
    if not norm_text(query):
        return terms.select("doc", F.lit(0.0).alias("score")).limit(0)
    corpus = docs.select(F.col(key).alias("doc")).distinct().agg(F.count("*").alias("n_all"))
    total = terms.agg(F.sum("tf").alias("len_all")).crossJoin(F.broadcast(corpus))  # one row each
    best = ranked(terms, query, total)
    return best.limit(limit) if limit else best


def ranked(terms: DataFrame, query: str, totals: DataFrame) -> DataFrame:
    """search(), given one row n_all, len_all: the number of documents and of all their words. terms can be
    just those that begin with words of the query."""
    words = list(dict.fromkeys(norm_text(query).split()))
    if not words:
        return terms.select("doc", F.lit(0.0).alias("score")).limit(0)
    hit = F.filter(F.array(*(F.lit(w) for w in words)), lambda w: F.startswith(F.col("term"), w))
    hits = terms.select("doc", "doc_len", "tf", F.explode(hit).alias("word")).groupBy("doc", "doc_len", "word").agg(F.sum("tf").alias("tf"))
    found = hits.groupBy("word").agg(F.count("*").alias("n"))  # at most one row per word of the query
    scored = hits.join(F.broadcast(found), "word").crossJoin(F.broadcast(totals))
    idf = F.greatest(F.log((F.col("n_all") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(LEAST_IDF))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") * F.col("n_all") / F.col("len_all")))
    best = scored.groupBy("doc").agg(F.sum(-part).alias("score"), F.count("*").alias("n_words")).filter(F.col("n_words") == len(words))
    return best.select("doc", "score").orderBy("score", "doc")
