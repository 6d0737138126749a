"""Vector codes: each part of a vector becomes the index of its nearest codebook entry, trained by exact rounds of means."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingloom.llm import anchors
from listingloom.sources.shared import written

#: Vectors of one stored block, whose parts get a metric tree each.
BLOCK = 2048
#: Components beyond this size would let a squared distance leave 64 bits.
_LARGEST = 1 << 28


def whole_numbers(vectors: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, a row per vector."""
    flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if np.abs(flat).max(initial=0) >= _LARGEST:
        raise ValueError(f"A component times {scale} is beyond {_LARGEST}.")
    sizes = vectors.value_lengths().to_numpy()
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("Vectors have different lengths.")
    return flat.astype(np.int64).reshape(len(vectors), -1)


def finite(vector: str) -> F.Column:
    """Whether a vector is there and has finite components only."""
    x = F.col(f"`{vector}`")
    return F.coalesce(F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))), F.lit(False))


def _blocks(df: DataFrame, parts: int, scale: int) -> DataFrame:
    """Blocks of rows (row, vector): rows, points (all components) and one metric tree per part, all as bytes."""
    kind = df.schema["row"].dataType.simpleString()

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        points = whole_numbers(table.column("vector").combine_chunks(), scale)
        if not points.shape[1] or points.shape[1] % parts:
            raise ValueError(f"Vectors of {points.shape[1]} components have no {parts} equal parts.")
        rows = table.column("row").combine_chunks()
        trees = [anchors.tree(np.ascontiguousarray(p)).to_bytes() for p in np.split(points, parts, axis=1)]
        listed = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
        return pa.record_batch([listed, pa.array([points.astype(np.int32).tobytes()], pa.binary()), pa.array([trees], pa.list_(pa.binary()))], names=["rows", "points", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, BLOCK - n)
                held.append(part)
                at, n = at + part.num_rows, n + part.num_rows
                if n == BLOCK:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    return df.mapInArrow(run, f"rows array<{kind}>, points binary, trees array<binary>")


def _opened(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple[pa.Array, list[np.ndarray], list[anchors.Tree]]]:
    """Block by block: its rows, and per part its points and its tree."""
    parts, _, width = books.shape
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            points = np.frombuffer(one.column("points")[0].as_buffer(), dtype=np.int32).astype(np.int64).reshape(-1, parts * width)
            trees = [anchors.Tree.from_bytes(t) for t in one.column("trees")[0].as_py()]
            yield one.column("rows").flatten(), [np.ascontiguousarray(p) for p in np.split(points, parts, axis=1)], trees


def _summed(blocks: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Sums and counts of the parts of every entry, and how many parts were owned by balls and distances of points made."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        work = np.zeros(2, dtype=np.int64)
        for _, points, trees in _opened(batches.__iter__(), books):
            for p in range(parts):
                found = anchors.nearest(trees[p], points[p], books[p])
                sums[p] += found.sums
                counts[p] += found.counts
                work += found.owned, found.compared
        flat = np.concatenate((sums.ravel(), counts.ravel(), work))
        at = np.flatnonzero(flat)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(flat[at], pa.int64())], names=["at", "value"])

    found = blocks.mapInArrow(run, "at long, value long").groupBy("at").agg(F.sum("value").alias("value")).collect()
    # At most parts x entries x (width + 1) + 2 rows, whatever the table's size.
    flat = np.zeros(parts * entries * (width + 1) + 2, dtype=np.int64)
    for row in found:
        flat[row.at] = row.value
    cut = parts * entries * width
    return flat[:cut].reshape(books.shape), flat[cut:-2].reshape(parts, entries), int(flat[-2]), int(flat[-1])


def encoded(df: DataFrame, vector: str = "embedding", id: str = "vec_id", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, work: list | None = None) -> DataFrame:
    """row, code, error, codebooks_sha256: every row of `df` whose vector is there and finite, in one column `row` (a struct).

    Components become floor(scale * x), and a vector `parts` consecutive parts of equal length. The codebook of a part
    starts as that part of the rows with the `entries` smallest ids (fewer rows: all of them; rows without an id come last;
    rows of one id come by their vectors). Each round assigns every part to the nearest entry, the lower one of equals, and
    replaces each entry by the floor of its parts' mean; an entry without parts stays. At last the parts are assigned
    again: `code` holds the entries as two hexadecimal digits each, `error` the sum of the squared distances.

    Repeated rows count as often as they occur, other columns pass through whatever their names, and an empty table gives
    an empty result. Vectors of different lengths, of a length that `parts` does not divide, or with components of 2^28
    and more after scaling are an error. entries may be up to 256.

    Blocks of BLOCK rows are stored once with a metric tree per part; a round reads them and moves only sums. `work`, if
    given, receives per round the parts assigned with a whole ball and the distances of single parts that were computed.
    """
    packed = df.filter(finite(vector)).select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(f"`{vector}`").alias("vector"))
    least = packed.orderBy(F.col(f"row.`{id}`").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow().column("vector").combine_chunks()
    kind = packed.schema["row"].dataType.simpleString()
    schema = f"row {kind}, code string, error long, codebooks_sha256 string"
    if not len(least):
        return df.sparkSession.createDataFrame([], schema)
    start = whole_numbers(least, scale)
    if start.shape[1] % parts:
        raise ValueError(f"Vectors of {start.shape[1]} components have no {parts} equal parts.")
    books = np.stack([np.ascontiguousarray(p) for p in np.split(start, parts, axis=1)])
    blocks = written(_blocks(packed, parts, scale), "code-blocks")
    for _ in range(rounds):
        sums, counts, owned, compared = _summed(blocks, books)
        books = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], books)
        if work is not None:
            work.append((owned, compared))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, points, trees in _opened(batches, books):
            found = [anchors.nearest(t, p, b).codes for t, p, b in zip(trees, points, books)]
            error = sum(((p - b[c]) ** 2).sum(1) for p, b, c in zip(points, books, found))
            codes = [bytes(c).hex() for c in np.stack(found, axis=1).astype(np.uint8)]
            yield pa.record_batch([rows, pa.array(codes, pa.string()), pa.array(error, pa.int64()), pa.array([digest] * len(codes), pa.string())], names=["row", "code", "error", "codebooks_sha256"])

    return blocks.mapInArrow(run, schema)


def digests(df: DataFrame, **settings: object) -> DataFrame:
    """vec_id, code, error, label_error (the errors of all rows with the same label, nulls together), codebooks_sha256."""
    found = written(encoded(df.select("vec_id", "embedding", "label"), **settings).select("row.vec_id", "row.label", "code", "error", "codebooks_sha256"), "codes")
    sums = found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same")
    return found.join(sums, F.col("label").eqNullSafe(F.col("same"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
