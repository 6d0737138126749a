"""Records of CSV files, cut so that many tasks share one file although its fields hold line breaks."""

import math
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window, functions as F

from listingloom.sources.shared import written

#: The most bytes of a split, the fewest that pay for a task of their own, and the bytes read or sent at a time.
SPLIT_BYTES, LEAST_BYTES, CHUNK_BYTES = 16 << 20, 1 << 20, 4 << 20

QUOTE, COMMA, NEWLINE, RETURN = 34, 44, 10, 13
BOM = b"\xef\xbb\xbf"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark lists it, and the path on it. Names may hold blanks."""
    parts = urlsplit(path.replace("?", "%3F").replace("#", "%23"))
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), path.removeprefix("file:").replace("///", "/", 1)
    system, base = fs.FileSystem.from_uri(f"{parts.scheme}://{parts.netloc}/")
    return system, f"{base.rstrip('/')}/{path.split(parts.netloc, 1)[1].lstrip('/')}"


def _surveyed(data: np.ndarray, first: int, size: int, at_end: bool) -> tuple[int, list[int]]:
    """Quotes in a split, and those out of place if an even or an odd number of quotes comes before it.

    `data` holds the split from place `first` on, with the byte before and the byte after it where there are any. A quote
    that opens stands behind a comma, a line break, a closing quote or nothing; one that closes stands before one of them.
    """
    places = first + np.flatnonzero(data[first : first + size] == QUOTE)
    before = np.where(places > 0, data[places - 1], NEWLINE)
    after = np.where(places + 1 < len(data), data[np.minimum(places + 1, len(data) - 1)], NEWLINE if at_end else QUOTE)
    if first == 0 and data[:3].tobytes() == BOM:
        before[places == 3] = NEWLINE
    opens_well = np.isin(before, (COMMA, NEWLINE, QUOTE))
    closes_well = np.isin(after, (COMMA, NEWLINE, RETURN, QUOTE))
    opening = np.arange(len(places)) % 2 == 0
    return len(places), [int((~np.where(opens, opens_well, closes_well)).sum()) for opens in (opening, ~opening)]


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split: path, start, size, quotes, misplaced quotes under either parity, and the first record of its file."""
    for batch in batches:
        for row in batch.to_pylist():
            system, path = opened(row["path"])
            with system.open_input_file(path) as file:
                first = min(row["start"], 1)
                file.seek(row["start"] - first)
                data = np.frombuffer(file.read(row["size"] + first + 1), dtype=np.uint8)
                header = None
                if row["start"] == 0:
                    file.seek(0)
                    header = _rest(file, 0).removeprefix(BOM).decode("utf-8", "replace").rstrip("\r")
            quotes, (even, odd) = _surveyed(data, first, row["size"], row["start"] + row["size"] >= row["length"])
            yield pa.RecordBatch.from_pylist([{
                "path": row["path"], "start": row["start"], "size": row["size"], "quotes": quotes, "even": even, "odd": odd, "header": header,
            }], _SURVEY)


_SURVEY = pa.schema([*((c, pa.string() if c in ("path", "header") else pa.int64()) for c in ("path", "start", "size", "quotes", "even", "odd", "header"))])


def outer_newlines(data: np.ndarray, quoted: int) -> np.ndarray:
    """Places of the line breaks that end a record; `quoted`: whether the first byte is inside quotes."""
    lines = np.flatnonzero(data == NEWLINE)
    return lines[(np.searchsorted(np.flatnonzero(data == QUOTE), lines) + quoted) % 2 == 0]


def _rest(file, quoted: int) -> bytes:
    """What a file holds up to the next line break that ends a record, or up to its end."""
    parts = []
    while chunk := file.read(CHUNK_BYTES):
        data = np.frombuffer(chunk, dtype=np.uint8)
        ends = outer_newlines(data, quoted)
        if len(ends):
            parts.append(chunk[: ends[0]])
            break
        parts.append(chunk)
        quoted = (quoted + int((data == QUOTE).sum())) % 2
    return b"".join(parts)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records that begin in each split, behind a line break in it; the first record of a file is its header."""
    for batch in batches:
        for row in batch.to_pylist():
            system, path = opened(row["path"])
            with system.open_input_file(path) as file:
                file.seek(row["start"])
                raw = file.read(row["size"])
                data = np.frombuffer(raw, dtype=np.uint8)
                ends = outer_newlines(data, row["quoted"])
                if not len(ends):
                    continue
                raw += _rest(file, (row["quoted"] + int((data == QUOTE).sum())) % 2)
            del data
            stops = np.append(ends[1:], len(raw))
            size, records = 0, []
            for start, stop in zip(map(int, ends + 1), map(int, stops), strict=True):
                record = raw[start:stop].removesuffix(b"\r")
                if record:
                    records.append(record.decode("utf-8", "replace"))
                    size += len(record)
                if size >= CHUNK_BYTES:
                    yield pa.record_batch({"record": pa.array(records, pa.string()), "header": pa.array([row["header"]] * len(records), pa.string())})
                    size, records = 0, []
            yield pa.record_batch({"record": pa.array(records, pa.string()), "header": pa.array([row["header"]] * len(records), pa.string())})


def surveyed(files: DataFrame, split_bytes: int | None = None) -> DataFrame:
    """The splits of plain CSV files: path, start, size, quoted (whether it begins inside quotes), header, misplaced.

    files: path, length. Every split is read once by a task of its own, and says how many quotes it holds; whether a split
    begins inside quotes is the parity of all quotes before it. `misplaced` counts the quotes of the whole file that stand
    where neither side of a quoted field is: with none, parity and a reader from the start agree on every record.
    """
    spark = files.sparkSession
    if split_bytes is None:
        total = files.agg(F.sum("length")).first()[0] or 0
        split_bytes = min(SPLIT_BYTES, max(LEAST_BYTES, math.ceil(total / spark.sparkContext.defaultParallelism)))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long")))
    splits = files.filter("length > 0").select("path", "length", starts.alias("start"))
    splits = written(splits.withColumn("size", F.least(F.lit(split_bytes).cast("long"), F.col("length") - F.col("start"))), "csv-splits")
    found = splits.repartition(max(1, splits.count())).mapInArrow(
        _survey, "path string, start long, size long, quotes long, even long, odd long, header string")
    whole = Window.partitionBy("path")
    before = F.coalesce(F.sum("quotes").over(whole.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    placed = written(found, "csv-quotes").withColumn("quoted", before).withColumn("wrong", F.when(F.col("quoted") == 0, F.col("even")).otherwise(F.col("odd")))
    return written(placed.select(
        "path", "start", "size", "quoted", F.max("header").over(whole).alias("header"), F.sum("wrong").over(whole).alias("misplaced")), "csv-places")


def records(splits: DataFrame) -> DataFrame:
    """The text of every record of the splits, headers left out, and the header of its file: record, header.

    A record belongs to the split in which the line break before it lies; its task reads on to its end. Empty lines are no
    records. Lines end in \\n or \\r\\n.
    """
    return splits.repartition(max(1, splits.count())).mapInArrow(_cut, "record string, header string")
