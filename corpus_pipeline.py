"""documents -> less toxic -> better -> one of each near-duplicate group -> mixed to target weights -> packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. Deleted together with lumendex/llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumendex.llm import _store, jaccard, mixing, packing, quality, toxicity


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-or model takes for toxic go."""
    return toxicity.filter_documents(docs, _store.table(spark, sf_dir, "labels"))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the corpus' own thresholds reject go."""
    return quality.filter_documents(docs)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays.

    Words in shingles of five, similarity 0.8 or more: the setting for near duplicates."""
    return jaccard.filter_documents(docs, shingle=5, threshold=(8, 10))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return mixing.mix_documents(docs)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", stage_toxicity),
    ("quality rules", stage_quality),
    ("n-gram jaccard join", stage_near_duplicates),
    ("mixing sources", stage_mixing),
    ("best-fit packing", stage_packing),
]

#: A trained classifier decides in the first stage; SQL can't express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _store.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = _store.cut(docs, "stage-" + name.replace(" ", "-"))
            _store.drop(before)
    return docs
