"""Exact duplicates: counting quotient filters find the texts that may repeat, and only their bytes are compared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingloom.llm import buckets, quotient
from listingloom.sources.shared import written


def normal(text: str = "text") -> F.Column:
    """The text with one blank for every run of white space (blank, \\t, \\n, \\v, \\f, \\r); '' for null."""
    return F.regexp_replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def fingerprint(text: F.Column, bits: int) -> F.Column:
    return F.shiftrightunsigned(F.xxhash64(text), 64 - bits)


def repeated(keys: DataFrame, bits: int) -> DataFrame:
    """key: the values of the column `key` (0 to 2^bits - 1) that occur more than once.

    Every task builds filters of what it reads, one per range of keys, about a million keys at a time. Those of one range
    meet and are merged by their sorted remainders. A key of a third of all rows is one slot with a count by then.
    """
    spark = keys.sparkSession
    split = max(0, min(int(np.ceil(np.log2(buckets.count(spark)))), bits - quotient.LEAST_REMAINDER - 1))
    rest = bits - split
    low = np.uint64((1 << rest) - 1)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def filters(parts: list[np.ndarray]) -> pa.RecordBatch:
            found, counts = np.unique(np.concatenate(parts), return_counts=True)
            cuts = np.searchsorted(found >> np.uint64(rest), np.arange((1 << split) + 1))
            used = np.flatnonzero(np.diff(cuts))
            made = [quotient.built(found[cuts[b] : cuts[b + 1]] & low, counts[cuts[b] : cuts[b + 1]], rest) for b in used]
            return pa.record_batch([pa.array(used, pa.int64()), pa.array(made, pa.binary())], names=["range", "filter"])

        parts, held = [], 0
        for batch in batches:
            parts.append(batch.column(0).to_numpy().astype(np.uint64))
            held += batch.num_rows
            if held >= buckets.GATHERED:
                yield filters(parts)
                parts, held = [], 0
        if held:
            yield filters(parts)

    def merge(table: pa.Table) -> pa.Table:
        found = quotient.merged(table.column("filter").to_pylist(), rest)
        return pa.table({"range": pa.array([table.column("range")[0].as_py()], pa.int64()), "filter": pa.array([found], pa.binary())})

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, counts = quotient.read(data)
                key = found[counts > 1].astype(np.int64) | np.int64(at << rest)
                yield pa.record_batch([pa.array(key, pa.int64())], names=["key"])

    whole = keys.select("key").mapInArrow(build, "range long, filter binary").groupBy("range").applyInArrow(merge, "range long, filter binary")
    return whole.mapInArrow(often, "key long")


def verdicts(df: DataFrame, text: str = "text", id: str = "doc_id", bits: int = 62) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of `df`.

    Texts are equal if they are after normal(). Of equal texts the row with the smallest id stays; rows without an id come
    last, so keep_id is null where no row of the group has one. Of rows with equal id and text exactly one stays. Null and
    empty texts are one group, texts of white space only another one. Other columns are not looked at; an empty table
    gives an empty result.

    Texts whose fingerprint no other row has go nowhere. The others are grouped by their whole bytes, with a sum per task
    first, so that a group of a third of all rows reaches its reducer as one row per task. Spark broadcasts the
    fingerprints that repeat only if they are small, and else shuffles and splits skewed ones. `bits` (4 to 63) only
    decides how many texts are compared in vain.
    """
    docs = df.select(F.col(f"`{id}`").alias("doc_id"), normal(text).alias("text"))
    found = docs.select(
        "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), fingerprint(F.col("text"), bits).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = written(found, "copies-rows")
    keys = written(repeated(rows, bits), "copies-keys")

    same = docs.withColumn("key", fingerprint(F.col("text"), bits)).join(keys, "key", "left_semi").groupBy("text").agg(F.count("*").alias("group_size"))
    sums = same.select(F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "group_size").groupBy("text_sha256").agg(F.count("*").alias("texts"), F.max("group_size").alias("group_size"))
    one = F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("Different texts have one SHA-256.")))
    first = rows.join(keys, "key", "left_semi").groupBy("text_sha256").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    groups = written(sums.select("text_sha256", one.alias("group_size")).join(first, "text_sha256").select("text_sha256", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row")), "copies-groups")

    alone = F.col("group_size").isNull()
    return rows.join(groups, "text_sha256", "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256",
    )


#: DuckDB SQL for the verdicts on `documents`.
ORACLE = r"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW same AS (PARTITION BY t)
"""
