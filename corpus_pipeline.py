"""A corpus pipeline in stages: each takes the documents that the one before kept, and the folder of the tables.

Every stage takes a table with the columns of documents, in any number of rows, and returns all its columns, also further ones
whatever their names; only the last returns token ids instead. What stages do with rows at the edges:

| rows | quality | near duplicates | secrets | mix | encode |
|-|-|-|-|-|-|
| null text | scored as an empty one | stays | unchanged | stays once | no tokens |
| empty text | scored by its length | stays | unchanged | stays once | no tokens |
| very long text | whole | whole | whole | whole | whole |
| null doc_id | scored; unlabelled | stays | redacted by its own text | drawn by its text | null id |
| repeated doc_id | scored one by one | the least text stays | each by its own text | drawn by id and text | one by one |
| null source or lang | no part in scores | no part | an owner or repository of its own | a source, the last | no part |
| ties | score 0.3 stays | the least doc_id stays | owners count once | by id, then size | leftmost pair |
| no rows | no rows | no rows | no rows | no rows | no rows |
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tilewright.llm import byte_bpe, mixing, parity_join, pu_quality, secrets
from tilewright.llm.shared import drop, keep, use_small_batches


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the classifier rejects go. Without labels of quality 1 all have score 0.5 and stay."""
    use_small_batches(spark)
    model = pu_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return pu_quality.keep_quality(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each group of near copies the document with the least doc_id stays; rows without words or an id stay."""
    use_small_batches(spark)
    return parity_join.drop_similar(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: secrets are replaced by their kind, and n_chars follows."""
    use_small_batches(spark)
    return secrets.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents are repeated or left out until each source has its share of words."""
    return mixing.repeat_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: doc_id, n_tokens, token_ids; other columns end here."""
    use_small_batches(spark)
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: The classifier's training and the encoding have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents; each result but the last is written and read again, and removed when the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = keep(docs, "stage")
            if before is not None:
                drop(before)
            before = docs
    return docs
