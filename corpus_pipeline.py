"""A cleaning pipeline over ``documents``: each stage applies one training-data operator.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; a stage's result is written as
Parquet and read again as the next one's docs.  All but the last return the columns of documents.

1. toxicity        drops documents whose toxicity score reaches the threshold
2. near_duplicates keeps one document of each class of SimHash near-duplicates (five-word shingles, a
                   similarity of 0.8), the least doc_id
3. decontaminate   drops documents that hold a benchmark passage
4. pii             masks personal data in the texts (n_chars follows)
5. byte_bpe        encodes the texts to ids and decodes them: doc_id, n_tokens and digests of both
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgraph.llm.bpe import token_digest
from linkgraph.llm.common import fresh, materialize, release
from linkgraph.llm.decontaminate import drop_contaminated
from linkgraph.llm.pii import mask_pii
from linkgraph.llm.simhash import keep_one_of_each
from linkgraph.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop toxic documents; labels outside the held-out fold teach the score.

    Null and empty texts score like a text without a hit and stay; repeated rows fare alike.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return drop_toxic(docs, labels)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the least doc_id of each class of near-duplicates (null doc_ids last).

    Null and empty texts are one class; of repeated rows one stays, of rows with one doc_id any.
    """
    return keep_one_of_each(docs, shingle=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of a benchmark item.

    Null and empty texts hold none and stay; repeated rows fare alike.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put [KIND] in place of personal data; n_chars is the new length where the text changed.

    Null and empty texts stay as they are; every row is kept, repeated ones too.
    """
    before = fresh(docs, "_before")
    masked = mask_pii(docs.withColumn(before, F.col("text")))
    changed = ~F.col("text").eqNullSafe(F.col(before))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return masked.select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each text by the byte-level vocabulary.

    A null text counts as empty: no tokens, the hashes of no bytes.  A row each, repeated ones too.
    """
    return token_digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("pii", pii),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; a stage's rows are written to the shared folder in between, and
    deleted when those of the next stage are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = materialize(docs, name)
            release(before)
    return docs


#: No SQL engine has the learned score, the fingerprints or the merges; tests/llm/test_pipeline.py
#: holds run() against plain Python versions instead.
ORACLE_SQL = None
