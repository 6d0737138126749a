"""The raw listings file."""

import csv
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from listingloom import fixed
from listingloom.errors import DatasetError
from listingloom.functions.parse import null_tokens
from listingloom.sources.records import records, surveyed
from listingloom.sources.shared import spread, written


def read_or_none(spark: SparkSession, path: str, file_format: str = "parquet", **options) -> DataFrame | None:
    """A table, or None where the path does not exist. A folder without readable files is damage, and an error."""
    try:
        return spark.read.options(**options).format(file_format).load(str(path))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        if error.getCondition() == "UNABLE_TO_INFER_SCHEMA":
            raise DatasetError(f"{path} holds no readable table.") from error
        raise


def _headers(spark: SparkSession, files: list[str]) -> dict[str, list[str]]:
    """The first line of every file, and the files that begin with it.

    Lines are numbered in the order of a file within its first block.
    """
    lines = spark.read.text(files)
    # Names beside the lines, so that a file without any line is not missed as a header.
    first = lines.select("value", "_metadata.file_path", "_metadata.file_block_start").where("file_block_start = 0")
    first = first.withColumn("place", F.monotonically_increasing_id()).groupBy("file_path").agg(F.min_by("value", "place").alias("header"))
    found: dict[str, list[str]] = {}
    for row in first.collect():
        found.setdefault(row["header"], []).append(unquote(row["file_path"]))
    return found


def _bound(header: str, file: str) -> list[str]:
    """The names in a header, which must have all mapped columns."""
    names = next(csv.reader([header.removeprefix("\ufeff")]), [])
    if missing := missing_columns(names):
        raise DatasetError(f"Dataset is missing expected columns: {missing} in {file}")
    return names


def _read_whole(spark: SparkSession, files: list[str]) -> list[DataFrame]:
    """Files that are read from their start, each by one task."""
    parts = []
    for header, some in sorted(_headers(spark, files).items()):
        _bound(header, sorted(some)[0])
        parts.append(standard_columns(spark.read.csv(sorted(some), header=True, multiLine=True, escape='"')))
    return parts


def _mapped(names: list[str]) -> Column:
    """An array of one struct, the mapped columns of a record, parsed once by the names of its header."""
    cells = F.from_csv("record", ", ".join(f"c{i} string" for i in range(len(names))), {"escape": '"', "multiLine": "true"})
    places = {new: names.index(old) for old, new in fixed.RAW_COLUMNS.items()}
    return F.transform(F.array(cells), lambda row: F.struct(*(null_tokens(row[f"c{i}"]).alias(new) for new, i in places.items())))


def _parsed(rows: DataFrame, headers: dict[str, list[str]]) -> DataFrame:
    """Records as the mapped columns, each bound by the names in the header of its file."""
    return rows.select(F.inline(F.coalesce(*(F.when(F.col("header") == header, _mapped(names)) for header, names in headers.items()))))


def read_listings(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """Raw listings as strings: the mapped columns only, renamed, with missing values as null.

    Columns are bound by name in every file: each header must have all mapped columns, in any order, among any others.
    A file is shared by many tasks, although quoted fields hold line breaks: the parity of the quotes before a split
    tells whether it begins in a field (sources/records.py). Compressed files, and files with quotes inside
    or around parts of a field, where that rule does not hold, are parsed from their start by one task each; if their lines end in \\r\\n, Spark
    then gives such breaks in fields as \\n.
    """
    listed = read_or_none(spark, path, "binaryFile")
    if listed is None:
        raise DatasetError(f"Dataset not found at {path}.")
    files = written(listed.select("path", "length"), "csv-files")
    packed = F.col("path").rlike(r"\.(gz|bz2|deflate|lz4|snappy|zst|zstd|xz)$")
    splits = surveyed(files.filter(~packed), split_bytes)
    odd = splits.filter("misplaced > 0").select("path").distinct().unionByName(files.filter(packed & (F.col("length") > 0)).select("path"))
    whole = sorted(row["path"] for row in odd.collect())
    plain = splits.filter("misplaced = 0")
    headers = {row["header"]: _bound(row["header"], row["file"]) for row in plain.groupBy("header").agg(F.min("path").alias("file")).orderBy("header").collect()}
    parts = [_parsed(records(plain), headers)] if headers else []
    parts += _read_whole(spark, whole) if whole else []
    if not parts:
        raise DatasetError(f"Dataset is missing expected columns: {missing_columns([])} in {path}")
    return spread(reduce(DataFrame.unionByName, parts))


def missing_columns(names: list[str]) -> list[str]:
    return sorted(set(fixed.RAW_COLUMNS) - set(names))


def standard_columns(raw: DataFrame) -> DataFrame:
    """The mapped columns under their names here; an error when the header lacks any of them."""
    if missing := missing_columns(raw.columns):
        raise DatasetError(f"Dataset is missing expected columns: {missing}")
    return raw.select(*(null_tokens(F.col(f"`{old}`")).alias(new) for old, new in fixed.RAW_COLUMNS.items()))
