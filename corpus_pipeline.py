"""From raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage
before kept, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from framewright.llm import langid, near, packing, suffixes
from framewright.session import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a language can be told; a missing ``lang`` is filled in.

    Nulls and texts without a letter are left out. If no row has a label to
    learn from, all other documents stay, with a null ``lang``.
    """
    languages, model = langid.train_languages(docs)
    if not languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    others = [c for c in docs.columns if c != "doc_id"]
    found = langid.predict_languages(docs, languages, model, keep=others)
    told = found.where(F.col("lang_pred") != langid.UNKNOWN)
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Near duplicates share at least 0.8 of their five-word shingles, by Jaccard.
    """
    return near.keep_first_of_near_copies(docs, size=5, least=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts without the bytes that a document with a smaller id already has."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = suffixes.remove_repeats(docs, keep=others)
    cut = cut.withColumnRenamed("kept_text", "text").withColumn("n_chars", F.length("text").cast("long"))
    return cut.select(docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in the training sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("sequences", sequences),
]

#: the stages hash, cluster and tokenize, which SQL does not express; the tests compare near duplicates with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
