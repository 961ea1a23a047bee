"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.llm import common, jaccard, language, packing, registry, surrogates, toxicity


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; those without letters (null and empty texts too) or with a text like none of the
    languages go. Null and repeated keys are no matter, other columns stay; no rows: no rows."""
    learned = registry.remainder(5) > 0
    profiles = language.fit(docs, learned)
    return language.recognised(docs, profiles, least_by_length=language.limits(docs, learned & F.col("lang").isNotNull(), profiles))


def by_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3; a null or empty text has no match and stays. Rows without a key are scored and never
    learned from; other columns stay; no rows: no rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.below(docs, toxicity.fit(docs, labels, ~registry.remainder(4).isin(-1, 2)), 0.3)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, Jaccard similarity of 0.8 or more) the document with the smallest
    doc_id: links of the SimHash operator, checked exactly, and after them those that differ in too many bits for it. Of rows
    with one doc_id one stays; rows without a doc_id stay; texts without a word are alike; no rows: no rows."""
    return jaccard.keep_one(docs, words=5, least=0.8)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; n_chars follows the text (a null text keeps its own). Null and repeated
    keys and any other columns stay; no rows: no rows."""
    safe = surrogates.pseudonymise(docs, registry.pii_key(spark))
    if "n_chars" in docs.columns:
        safe = safe.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return safe.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens; a null or empty text is its end token. Repeated and null keys
    have their own pieces; no rows: no rows."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, 2)


STAGES = [
    ("language", by_language),
    ("toxicity", by_toxicity),
    ("near_duplicates", without_copies),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: No stage but the filters' bookkeeping can be said in SQL: models, XXH64 and BPE can't. tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
