"""The corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of documents. run() writes each stage's result to the folder that driver and executors share and reads it again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import bpe, decontam, jaccard, linededup, quality, shared, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules and the boosted trees keep."""
    return quality.keep(docs, quality.train(docs, shared.table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that recur across documents."""
    return linededup.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, that with the smallest doc_id. Links are those of op2's fingerprints
    and, as these miss most texts that differ by more than a few words, those of an exact similarity (five words, 0.8)."""
    close = simhash.near_duplicates(docs).select("doc_id", "component_id")
    links = close.union(jaccard.near_duplicates(docs)).where("doc_id != component_id")
    roots = simhash.components(links.select(F.col("doc_id").alias("x"), F.col("component_id").alias("y")))
    gone = shared.written(roots.where("node != root").select(F.col("node").alias("doc_id")), "copies")
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontam.keep(docs, shared.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the documents that are left."""
    return bpe.digests(docs, bpe.load(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: SQL can express neither the trees nor the fingerprints nor the tokens; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over documents."""
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
