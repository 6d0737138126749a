"""The registered queries of the operators: each applies one to its whole table and returns its digest columns."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingloom.llm import bpe, codes, copies, jaccard, langid, merkle, mixing, pfor, quality, repeats, secrets, topk, warc
from listingloom.llm import texts as t
from listingloom.sources.shared import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    t.bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-ids")
    pfor.write_ids(table(spark, sf_dir, "documents"), folder, tokenizer_path(), end=2)
    return pfor.read_ids(spark, folder, ("doc_id", "start", "n_tokens", "ids_crc32"))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.deduplicated(table(spark, sf_dir, "documents"), length=50, digest=True)


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), folder)
    # The payloads are read too, and so checked against the digests in the headers.
    key = F.substring_index("record_id", ":", -1)
    return warc.read_warc(spark, folder).select(
        F.when(key != "", key.cast("long")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.substring_index("refers_to", ":", -1).cast("long").alias("refers_to"),
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("spans")
    counts = {kind: secrets.of_kinds(spans, kind) for kind in secrets.BASE_KINDS}
    return secrets.scanned(docs).select(
        F.col("row.doc_id").alias("doc_id"), *(F.size(c).cast("long").alias(f"n_{k}") for k, c in counts.items()),
        F.sha2(secrets.listed(secrets.of_kinds(spans, *secrets.BASE_KINDS)).cast("binary"), 256).alias("base_sha256"), secrets.listed(spans).alias("spans"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mix.select("row.doc_id", "row.source", "n_tokens", "epoch", "place")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    model = langid.learn(docs.filter(~held_out).select("lang", "text"))
    found = langid.identified(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), jaccard.Rule(words=3, percent=90))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    failed = quality.base_failed()
    return quality.measured(docs).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & quality.in_bands()).alias("kept"), "whole_share", "n_chunks", "n_bad_chunks",
    )


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), changed=merkle.tampered())


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.digests(table(spark, sf_dir, "embeddings"))


def op13_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.verdicts(table(spark, sf_dir, "documents"))


QUERIES = {
    "op2_repeats": op2_repeats,
    "op3_top_k": op3_top_k,
    "op4_warc": op4_warc,
    "op1_token_ids": op1_token_ids,
    "op5_bpe": op5_bpe,
    "op6_secret_scan": op6_secret_scan,
    "op7_mixing": op7_mixing,
    "op8_language_id": op8_language_id,
    "op9_jaccard": op9_jaccard,
    "op10_quality_rules": op10_quality_rules,
    "op11_merkle": op11_merkle,
    "op12_vector_codes": op12_vector_codes,
    "op13_copies": op13_copies,
}
SQL: dict[str, str] = {"op7_mixing": mixing.oracle(), "op11_merkle": merkle.oracle(), "op13_copies": copies.ORACLE}
