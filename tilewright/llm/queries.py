"""One query per operator over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import byte_bpe, impact_topk, mixing, multiset_hash, parity_join, pu_quality, secrets, token_frames, url_lm, warc_audit
from tilewright.llm.oracles import ORACLE_SQL  # noqa: F401  the driver reads it here
from tilewright.llm.shared import use_small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in ("documents", "pages"):
        use_small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules of the URL query.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op1_url_char_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lm.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_live", "n_example")


def op3_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.edited_likeness(_table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = impact_topk.integer_vectors(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return impact_topk.top_k(vectors, F.col("vec_id") % 50 == 0)


def op6_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pu_quality.score(docs, pu_quality.train(docs, _table(spark, sf_dir, "labels")))


def op7_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.similar_documents(_table(spark, sf_dir, "documents"))


def op8_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("source")


def op9_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_frames.write_and_read(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


#: Records of the replica that are damaged on purpose, for the audit to find: some 50 together in each million, so that at any
#: size most files are whole and most branches of the others are.
DAMAGED = "page_id % 1000000 < 5000 and page_id % 97 = 13"


def op10_warc_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_audit.archive_and_audit(_table(spark, sf_dir, "pages"), F.expr(DAMAGED)).select("page_id", "n_bytes", "record_sha256", "status")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_char_lm": op1_url_char_lm,
    "op2_secret_ownership": op2_secret_ownership,
    "op3_multiset_fingerprint": op3_multiset_fingerprint,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_impact_topk": op5_impact_topk,
    "op6_pu_quality": op6_pu_quality,
    "op7_parity_join": op7_parity_join,
    "op8_weighted_mix": op8_weighted_mix,
    "op9_token_frames": op9_token_frames,
    "op10_warc_merkle": op10_warc_merkle,
}