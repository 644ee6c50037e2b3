"""A corpus pipeline of five operators over the table documents.

Each stage works on all that its predecessor kept. The last gives, per document,
the digests of its tokens; the others give the columns of documents.

Defined cases, through all stages: a null or empty text fails the quality rules, so
later stages see none (each takes them, as its module says); null ids are documents
like others; repeated rows are judged alike, and the near-duplicate stage keeps one
of them; very long texts are read whole; an empty table goes through as such; other
columns pass unchanged, whatever their names, up to the last stage; n_chars follows
the text where there is such a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlane.llm.bpe import digests, encoded
from offerlane.llm.common import drop_written, table, written
from offerlane.llm.lines import drop_boilerplate
from offerlane.llm.mixing import mix_documents
from offerlane.llm.quality import keep_quality
from offerlane.llm.simhash import keep_one


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and all thresholds."""
    return keep_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source."""
    kept = drop_boilerplate(docs)
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars").cast("long")))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, as its text."""
    return mix_documents(docs, n_chars="n_chars" if "n_chars" in docs.columns else None)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of each document."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return digests(encoded(docs, path, decode=True), path)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_dedup),
    ("mixing sources to target weights", mixing),
    ("BPE encoding and decoding", bpe),
]

#: Fingerprints, draws and a vocabulary are not to be had in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each on what its predecessor wrote; a stage's table goes when the next is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return made
        made = written(made, f"stage-{k}")
        if k:
            drop_written(docs, f"stage-{k - 1}")
        docs = made
