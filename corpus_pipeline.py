"""From raw documents to token ids: five stages, each written and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefops.llm import bpe, decontaminate, jaccard, quality, queries, secrets
from prefops.sources import io


def with_text(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns of documents, with another text and its length."""
    new = {"text": F.col(text), "n_chars": F.char_length(text).cast("long")}
    return rows.select(*(new.get(c, F.col(c)).alias(c) for c in columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are like the trusted ones; a null text fails the base rules."""
    trusted = queries.trusted_texts(docs, queries.table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, trusted).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays, of identical rows one.

    Documents are told apart by a number of their row, so that different texts
    under one id are decided each by itself. Documents without an id, and without
    words, stay.
    """
    rows = io.written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    groups = jaccard.jaccard_components(rows.select("__row", "text"), key="__row").select("__row", "component_id")
    named = rows.select("__row", "doc_id").where("doc_id is not null").join(groups, "__row")
    first = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "__row")).alias("first"))
    gone = io.written(named.join(first, "component_id").where("__row <> first.__row").select("__row"), "gone")
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that mostly consists of them goes; a null text stays."""
    found = decontaminate.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))
    return with_text(found.where("kept"), docs.columns, "clean_text")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays, a null text as it is."""
    found = secrets.find_secrets(docs, public_tokenizers.path(queries.BPE_RANKS), public_tokenizers.PATTERN)
    return with_text(found, docs.columns, "clean_text")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, and the digest of the text that they decode to.

    The ids are written first, so that a task has one worker: encoding or decoding.
    """
    ranks, pattern = public_tokenizers.path(queries.BPE_RANKS), public_tokenizers.PATTERN
    ids = io.written(bpe.encode(docs.select("doc_id", "text"), ranks, pattern), "ids")
    return bpe.decode(ids, ranks, pattern).select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("text_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("byte-level BPE", token_ids),
]

#: The quality score, the random strings and the token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = io.written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
