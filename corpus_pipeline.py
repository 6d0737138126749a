"""From raw documents to token ids: five operators of listingloom.llm as stages over one corpus.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of the docs it is given; run() writes each result as
Parquet and rereads it as the docs of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingloom.llm import bpe, jaccard, mixing, quality, secrets
from listingloom.llm.queries import tokenizer_path
from listingloom.llm.texts import bounded
from listingloom.sources.shared import shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands; the others go, so do null and empty texts."""
    bounded(spark)
    return quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (five words, similarity 0.8).

    Documents without an id stay, as they link with nothing. Rows that share an id stay or go together, equal texts
    among them once.
    """
    bounded(spark)
    found = jaccard.near_duplicates(docs, jaccard.Rule(words=5, percent=80))
    kept = found.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.select([f"`{c}`" for c in docs.columns]).unionByName(docs.filter("doc_id is null"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with [SECRET] in place of every secret, and n_chars of what the text is then."""
    bounded(spark)
    found = secrets.scanned(docs)
    now = {"text": F.col("redacted").alias("text"), "n_chars": F.length("redacted").cast("long").alias("n_chars")}
    return found.select(*(now.get(c, F.col(f"row.`{c}`")) for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents as often as their source's weight asks."""
    return mixing.mixed(docs).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, beside its other columns; columns named n_tokens or ids give way to the new ones."""
    bounded(spark)
    found = bpe.encoded(docs, tokenizer_path())
    others = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("text", "n_tokens", "ids")]
    return found.select(*others, F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing", mix),
    ("BPE encoding", encode),
]

#: SQL cannot express the compression bands or the encoding; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each result written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{k}")
        docs = spark.read.parquet(f"{home}/{k}")
    return docs
