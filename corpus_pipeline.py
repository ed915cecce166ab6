"""Training-corpus pipeline: toxicity, line dedup, n-gram Jaccard join, decontamination, BPE.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame;
each is written as Parquet in the shared folder and read again before the next. All but the last keep the
columns of documents.

Row rules of all stages: rows with null or empty text stay, having nothing to be judged by, and so do rows with a
null doc_id; texts may have any length and are taken whole. Rows that repeat are judged one by one where a
stage looks at a text alone; in line dedup and in the n-gram join rows that share a doc_id are one document,
which keeps its lines against itself and goes as a whole. Ties go to the smallest doc_id. Empty tables give
empty results, and without labels no document is toxic. Columns beside those of documents pass through,
whatever their names. The last stage returns its own three columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import bpe, decontaminate, line_dedup, ngram_join, toxicity
from sievework.llm.common import free_name, materialize, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model learns from the labelled documents of docs."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    own = free_name(docs, "__sw_score")
    return toxicity.score(docs, model, out=own).where(F.col(own) < toxicity.THRESHOLD).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a smaller doc_id holds; n_chars follows the text."""
    out = line_dedup.apply_keep_runs(docs, line_dedup.keep_bitmaps(docs))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, which names the group.

    Shingles of five words and a similarity of 0.8, the pipeline's definition of near duplicates.
    """
    _, components = ngram_join.join_components(docs, size=5, percent=80)
    gone = materialize(components.where("id <> component").select(F.col("id").alias("doc_id")), "pipeline-copies")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    own = free_name(docs, "__sw_hits")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), out=own)
    return found.where(F.size(f"{own}.hit_words") == 0).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token_ids (little-endian unsigned 32-bit integers) of every document."""
    coded = bpe.encode(docs.select("doc_id", "text"), keep=["doc_id"])
    return coded.select("doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: A learned model and BPE have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
