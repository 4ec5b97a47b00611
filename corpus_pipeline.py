"""Corpus preparation: language ID, near-dedup, decontamination, secret redaction, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet into the shared folder and
reads it back as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import bpe, decontaminate, langid, minhash, secrets
from maskwright.llm.common import fresh_path, map_rows, remove, table

#: Least share of a text's n-grams that its language must hold.
LEAST_LANGUAGE_SCORE = 0.2
#: Words of a shingle of near-duplicates, and their least similarity.
SHINGLE, SIMILARITY = 5, 0.8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without an identified language; filters are learned from the labelled rows of the stage's input.

    Null texts and texts without letters are dropped; without labelled rows all are. Repeated rows and extra columns stay.
    """
    return langid.keep_identified(docs, langid.train(docs), LEAST_LANGUAGE_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each near-duplicate group, once; rows without doc_id stay.

    Null and empty texts are no one's duplicates but their equals with the same doc_id.
    """
    kept = minhash.near_duplicates(docs, SHINGLE, SIMILARITY).where("doc_id = component_id").withColumnRenamed("spot", "__spot")
    one = docs.withColumn("__spot", F.xxhash64("text")).join(kept, ["doc_id", "__spot"], "left_semi").dropDuplicates(["doc_id", "__spot"])
    return one.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in texts; n_chars becomes the new length. Null texts stay as they are, and no row is dropped."""
    return secrets.redact_secrets(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids): every text's token ids; a null text has none, rows are kept as often as they come."""

    def setup():
        b = bpe.load(bpe.vocabulary())

        def row(key, lang, source, text):
            ids = b.encode(text or "")
            return [(key, lang, source, len(ids), ids)]

        return row

    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return map_rows(docs, ["doc_id", "lang", "source", "text"], schema, "doc_id bigint, lang string, source string, n_tokens bigint, ids array<int>", setup, 128)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminated),
    ("secret_scan", redact_secrets),
    ("bpe", tokenise),
]

#: Language filters and MinHash aren't expressible in SQL; tests hold run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
