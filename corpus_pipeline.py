"""Corpus pipeline: documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelspark.llm import byte_bpe, language_id, mixing, secrets, simhash
from gavelspark.llm._common import DOCUMENT_COLUMNS, materialize, pick, table

def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of learnt languages; that of the greatest share becomes their lang. Those without letters go, and those whose letters an even guess explains better than the languages that were learnt."""
    own = pick(docs, **DOCUMENT_COLUMNS)
    model = language_id.fit(own.where(~language_id.held_out()))
    found = language_id.identify(own, model, own.columns, prefix="found_")
    kept = found.where((F.col("found_lang_pred") != language_id.UNKNOWN) & (F.col("found_evidence") > 0))
    return kept.withColumn("lang", F.col("found_lang_pred")).select(*DOCUMENT_COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the least doc_id."""
    return simhash.deduplicate(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in them replaced."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their mixing weights. The budget covers every source once, so every document is there at least once and those of small sources are repeated, mixing.REPEATS times at most."""
    return mixing.mix(docs, cover=True, hold_repeats=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, whole (the ids decode to the text)."""
    return byte_bpe.encode_checked(docs)


STAGES = [
    ("language", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("byte-bpe", encode),
]

#: SQL has no mixture inference, no SimHash components and no byte-level BPE: tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's result is a Parquet table in the shared folder, which the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
