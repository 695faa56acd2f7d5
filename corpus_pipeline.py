"""The corpus pipeline: classify, filter, deduplicate, mask and pack the documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import fertility, packing, pii, quality_votes, simhash
from driftline.llm.shared import stored, table, unused_prefix


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that their labelled neighbours vote good (operator 7)."""
    model = quality_votes.fit(docs, table(spark, sf_dir, "labels"))
    own = unused_prefix(docs.columns)
    scored = quality_votes.classify(docs, model, *docs.columns, score=f"{own}score")
    return scored.filter(F.col(f"{own}score") >= 0.5).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that pass the base rules and the fertility bands (operator 8).

    Short texts have been judged by the classifier already, and being short is
    no fault of a clean one, so the base rules ask for one word here.
    """
    names, own = docs.columns, unused_prefix(docs.columns)
    return fertility.judge(docs, *names, min_words=1, prefix=own).filter(f"{own}kept").select(*names)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each near-duplicate group (operator 3).

    Groups link at a similarity of 0.8 over five-word shingles.
    """
    return simhash.deduplicate(docs, shingle_words=5, similarity=0.8)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the name of its kind (operator 2)."""
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens (operator 10)."""
    return packing.pack_documents(docs, capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("mask_personal_data", mask_personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: Learned votes, fingerprints of learned groups and public tokenisers are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
