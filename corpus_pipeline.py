"""Documents to token ids: toxicity, near copies, personal data, mixing of sources, SentencePiece.

Every stage takes documents with any further columns, whatever their names. Null and empty texts are texts like any other, null ids are
ids like any other, equal rows are rows each, and an empty table gives an empty one; what each stage makes of them is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from specloom.llm.common import save
from specloom.llm.mixing import mixed
from specloom.llm.pieces import encode_documents
from specloom.llm.pii import mask
from specloom.llm.simhash import keep_one
from specloom.llm.toxicity import keep_clean, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go. Texts of null and without words are scored like any other; equal rows stay or go together."""
    return keep_clean(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), threshold=0.3)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies on shingles of five words stays, that of the least doc_id (nulls last), then of the
    least text hash. Texts without words, null or not, are one group; of equal rows one stays."""
    return keep_one(docs, n_words=5)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets. No row goes; texts of null stay null."""
    return mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as its source's target asks, twice at most. Texts without words add nothing to a target and come
    as their hash decides; a null source is one more source; equal rows come as often as the one of them that is taken least."""
    return mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) with an end id, a row for each row; a null or empty text has the end id alone."""
    return encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Trained models, connected components and tokenizer ids are not expressible in SQL; tests/llm holds it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = save(docs, name)
    return docs
