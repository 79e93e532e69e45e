"""A corpus from raw documents to packed sequences: each stage works on all that the one before has kept.

Common to all stages: texts are taken whole, however long; other columns than those a stage reads pass through it, whatever
their names; an empty table gives an empty table of the same columns (the last stage: of its own).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import drop_stash, stash, table
from tessella.llm.cotrain import classify_quality
from tessella.llm.neardup import near_duplicates
from tessella.llm.packing import best_fit_packing
from tessella.llm.perplexity import quality_rules


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within the perplexity band of their language.

    Null and empty texts have no words and go. A null language is a language. Rows with a null id are judged as others.
    Repeated rows share a verdict and stay or go together.
    """
    return quality_rules(docs, carry=True).where("kept").select("carried.*")


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier takes for good.

    Null texts are empty texts, and null metadata a value of its own: both are scored as any. Rows with a null id are
    scored but not learnt from. Repeated rows share a score and stay or go together. Without labels of both classes among
    the documents all stay.
    """
    return classify_quality(docs, table(spark, sf_dir, "labels"), carry=True).where("kept").select("carried.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the least id.

    Texts without a word are like no other, and stay. A null id is never the least. Of repeated rows one stays; rows of one
    id with different texts stay if that id does.
    """
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    staying = docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")
    own = "_text"
    while own in docs.columns:
        own += "_"
    return staying.withColumn(own, F.xxhash64("text")).dropDuplicates(["doc_id", own]).drop(own)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences. Null and empty texts are the end mark alone; repeated rows
    are pieces of their own."""
    return best_fit_packing(docs)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_dedup", near_dedup_stage),
    ("packing", packing_stage),
]

#: The models of the first two stages cannot be expressed in SQL; tests hold the pipeline against its parts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again before the next, which then replaces it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_stash(before)
        before = docs
    packed = STAGES[-1][1](spark, docs, sf_dir)
    drop_stash(docs)
    return packed
