"""The corpus pipeline: quality classifier, exact dedup, near-duplicate join, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept; ``run`` writes what each returns as Parquet and reads it back.  All stages
but the last return the columns of ``documents``.

Cases: null and empty texts go through every stage (the quality stage scores
them like any other text); repeated rows stay once after the exact stage; an
empty table gives an empty result; extra columns are carried along by every
stage but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.llm import exact_dedup, ngram_join, packing, quality, suffix_dedup
from roadweave.llm._common import materialize, read

NEAR_WORDS = 5
NEAR_PERCENT = 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier scores ``quality.THRESHOLD`` or more."""
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    extra = docs.withColumnsRenamed({"score": "own_score"}) if "score" in docs.columns else docs
    kept = quality.score(extra, model).filter(F.col("score") >= quality.THRESHOLD).drop("score")
    return kept.withColumnsRenamed({"own_score": "score"}) if "score" in docs.columns else kept


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased), the row with the largest doc_id."""
    return exact_dedup.keep_one(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 % of their five-word shingles, directly or over others, the one with the smallest doc_id."""
    groups = ngram_join.similar_groups(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)
    kept = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col("kept_id")), "left_semi")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that stand anywhere else; n_chars follows."""
    cut = suffix_dedup.remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns) if "n_chars" in docs.columns else cut


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("exact_dedup", drop_exact),
    ("near_duplicates", drop_near),
    ("suffix_array_dedup", cut_repeats),
    ("packing", pack),
]

#: The classifier and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
