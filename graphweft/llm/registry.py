"""Queries of the operators over the driver's tables, with the parameters meant for production."""

from __future__ import annotations

import secrets
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, common, embeddings, language, packing, quality, sharding, simhash, surrogates, token_counts, toxicity


#: A text's measurements and verdict, in DuckDB's SQL.
OP5_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
),
windows AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM words WHERE len(w) >= 3),
counted AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM windows),
covered AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS at FROM counted WHERE n > 1),
repeated AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
measured AS (
  SELECT words.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words,
         len(lines) AS n_lines, len(regexp_extract_all(t, '[A-Z\x{00C0}-\x{00DE}]')) AS n_upper,
         len(regexp_extract_all(t, '[!?]')) AS n_marks, len(list_distinct(w)) AS n_distinct
  FROM words LEFT JOIN repeated ON words.doc_id = repeated.doc_id
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
            OR (n_dup_lines >= 2 AND 10 * n_dup_lines > 3 * n_lines)
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_upper > word_chars
            OR 2 * n_marks > n_words OR (n_words >= 50 AND 10 * n_distinct < n_words)) AS kept
FROM measured
"""


#: All pairs of vectors of one label, and what links reach, in DuckDB's SQL.
OP9_SQL = """
WITH RECURSIVE every AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
good AS (
  SELECT * FROM every
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.r AS a, b.r AS b, b.vec_id AS other FROM good a JOIN good b
  ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
),
reach AS (SELECT r, r AS at FROM good UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.at),
least AS (SELECT reach.r, min(every.vec_id) AS component_id FROM reach JOIN every ON every.r = reach.at GROUP BY reach.r),
linked AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT every.vec_id, coalesce(linked.n, 0)::BIGINT AS n_links, coalesce(least.component_id, every.vec_id) AS component_id,
       every.vec_id IS NOT DISTINCT FROM coalesce(least.component_id, every.vec_id) AS kept
FROM every LEFT JOIN least ON least.r = every.r LEFT JOIN linked ON linked.a = every.r
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents. The cache starts empty, in a folder of this call."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    cache = f"{common.shared_dir(spark)}/graphweft-token-cache-{uuid.uuid4().hex}"
    counted = token_counts.count_tokens(docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")), public_tokenizers.path("word_bpe_49k.json"), cache)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op2_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near equal bytes."""
    placed = sharding.kd_shard_documents(_table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024, 2)


def remainder(n: int):
    """crc32 of doc_id as text, mod n; -1 for a null doc_id, so that it is neither held out nor learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n, F.lit(-1))


def pii_key(spark: SparkSession) -> str:
    """The key of surrogates: graphweft.pii.key of the session, which a deployment sets to a secret of its own. Where it is
    unset, a random one, which the session keeps: surrogates then agree inside the session and with no other."""
    key = spark.conf.get("graphweft.pii.key", None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set("graphweft.pii.key", key)
    return key


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = language.fit(docs, remainder(5) > 0)
    found = language.predict(docs, profiles, ["doc_id"])
    return found.select("doc_id", (remainder(5) == 0).alias("held_out"), "lang_pred", "score")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule ledger of all documents under the newest policy."""
    rows = quality.verdicts(quality.stored_ledger(_table(spark, sf_dir, "documents")), max(quality.POLICIES))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed").bitwiseAND(F.lit(quality.BASE)) != 0).alias("base_failed"),
        F.col("kept_by_policy").alias("kept"),
    )


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of all documents, as digests."""
    docs = _table(spark, sf_dir, "documents")
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates in place of personal data, and how many."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.pseudonymise(docs, pii_key(spark), count="n_entities")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, limit=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    found = embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"), least_cosine=0.93)
    return found.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labelled rows that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), ~remainder(4).isin(-1, 2))
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (op1_token_counts, op2_kd_sharding, op3_best_fit_packing, op4_language_id, op5_quality_rules, op6_byte_bpe, op7_pii_surrogates, op8_simhash, op9_embedding_dedup, op10_toxicity)
    }


def oracle_sql() -> dict:
    return {"op5_quality_rules": OP5_SQL, "op9_embedding_dedup": OP9_SQL}
