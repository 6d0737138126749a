"""CSV files cut into splits, and winners settled on narrow keys."""

import csv
import gzip
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from listingloom import fixed
from listingloom.operators.entities import best_listings, of_winners, placed, read_reviews, winners
from listingloom.sources import records as r
from listingloom.sources.listings import read_listings

HEADER = [*fixed.RAW_COLUMNS, "extra"]
PIECES = ['"', '""', ",", "\n", "\r\n", "é", "a", " b", "x,\"\n\"", ""]


def made(seed, n=60):
    rng = random.Random(seed)
    return [["".join(rng.choices(PIECES, k=rng.randrange(6))) for _ in HEADER[:-1]] + [str(i)] for i in range(n)]


def text(rows, end="\r\n", header=HEADER):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows([header, *rows])
    return out.getvalue()


def kept(rows):
    return sorted(str([None if x in fixed.NULL_TOKENS else x for x in row[:-1]]) for row in rows)


def read(spark, path, split_bytes=None):
    rows = read_listings(spark, str(path), split_bytes).select(*fixed.RAW_COLUMNS.values())
    return sorted(str(list(row)) for row in rows.collect())


@pytest.mark.parametrize(("seed", "end", "size"), [(1, "\n", 300), (2, "\r\n", 300), (3, "\n", 333), (4, "\r\n", 1 << 20)])
def test_one_file_in_many_splits(spark, tmp_path, seed, end, size):
    rows = made(seed)
    (tmp_path / "a b?#.csv").write_bytes(("﻿" if seed == 3 else "").encode() + text(rows, end).encode())
    assert read(spark, tmp_path, size) == kept(rows)


def test_records_are_shared_by_tasks(spark, tmp_path):
    rows = made(5, 400)
    (tmp_path / "x.csv").write_text(text(rows, "\n"), newline="")
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "length")
    found = r.records(r.surveyed(files, 2000)).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(found) > 10 and sum(x["count"] for x in found) == 400 and max(x["count"] for x in found) < 100


def test_a_field_longer_than_many_splits(spark, tmp_path):
    rows = made(6, 5)
    rows[2][0] = "line, \"x\"\n" * 500
    (tmp_path / "x.csv").write_text(text(rows, "\n").rstrip("\n"), newline="")
    assert read(spark, tmp_path, 400) == kept(rows)


@pytest.mark.parametrize("field", ['5" wide', 'a "b" c', '""x'])
def test_quotes_out_of_place_are_read_from_the_start(spark, tmp_path, field):
    """Bare quotes inside a field without quotes around it: parity is of no use there."""
    lines = [",".join(HEADER), *(",".join([field, *(f"v{i}" for _ in HEADER[1:])]) for i in range(30))]
    (tmp_path / "x.csv").write_text("\n".join(lines) + "\n")
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "length")
    assert r.surveyed(files, 500).first()["misplaced"] > 0
    whole = spark.read.csv(str(tmp_path), header=True, multiLine=True, escape='"').select(*(f"`{c}`" for c in HEADER[:-1]))
    assert read(spark, tmp_path, 500) == sorted(str(list(x)) for x in whole.collect())


def test_plain_and_packed_files_together(spark, tmp_path):
    rows = made(7)
    (tmp_path / "a.csv").write_text(text(rows[:20]), newline="")
    (tmp_path / "b.csv").write_text(text([x[::-1] for x in rows[20:40]], header=HEADER[::-1]), newline="")
    (tmp_path / "c.csv.gz").write_bytes(gzip.compress(text(rows[40:], "\n").encode()))
    (tmp_path / "d.csv").write_text("")
    (tmp_path / "e.csv").write_text(",".join(HEADER))
    assert read(spark, tmp_path, 700) == kept(rows)


def test_cuts_agree_with_a_reader_from_the_start():
    rng = random.Random(8)
    for _ in range(200):
        raw = text(made(rng.randrange(1 << 30), 4), rng.choice(["\n", "\r\n"])).encode()
        data, cut = np.frombuffer(raw, dtype=np.uint8), rng.randrange(1, len(raw))
        quoted = raw[:cut].count(b'"') % 2
        ends = [*r.outer_newlines(data[:cut], 0), *(cut + r.outer_newlines(data[cut:], quoted))]
        assert ends == list(r.outer_newlines(data, 0)) and len(ends) == 5
        n, either = r._surveyed(data[cut - 1 : cut + 40], 1, min(39, len(raw) - cut), cut + 39 >= len(raw))
        assert either[quoted] == 0 and n == raw[cut : cut + 39].count(b'"')


COLUMNS = "name string, address string, votes string, url string, category string, reviews string, note string"


def test_review_text_stays_out_of_the_aggregate(spark):
    rows = spark.createDataFrame([("a", "b", "1", "u", "c", "['x']", "n")], COLUMNS)
    plan = winners(placed(rows))._jdf.queryExecution().executedPlan().toString()
    aggregates = [line for line in plan.split("\n") if "Aggregate(" in line or "Exchange hashpartitioning(name" in line]
    assert aggregates and all("reviews" not in line and "note" not in line for line in aggregates)
    assert plan.count("regexp_replace(name") <= 1


def test_ties_and_equal_rows(spark):
    rows = [("a", "b", "1", None, "c", "['x']", note) for note in ("n", None, "m", "n", "n")] + [("a ", " b", "1", None, "d", None, "z"), (None, "b", "9", "u", "c", None, "n")]
    results = set()
    for n in (1, 2, 5):
        (row,) = best_listings(spark.createDataFrame(rows, COLUMNS).repartition(n)).collect()
        results.add(str(row))
        assert (row["name"], row["categories"], row["reviews"]) == ("a", ["c", "d"], "['x']")
    assert len(results) == 1
    swapped = [("a", "b", "1", "u", "c", None, "x"), ("a", "b", "1", "u", "c", "x", None), ("q", "b", "1", "u", "c", None, "x")]
    assert best_listings(spark.createDataFrame(swapped, COLUMNS)).count() == 2
    assert best_listings(spark.createDataFrame([], COLUMNS)).count() == 0


def test_memory_of_a_whole_split(tmp_path):
    import tracemalloc

    import pyarrow as pa

    line = 'k,"' + 'one ""two""\nthree ' * 20 + '"\n'
    (tmp_path / "x.csv").write_text("a,b\n" + line * ((64 << 20) // len(line)))
    length = (tmp_path / "x.csv").stat().st_size
    row = {"path": str(tmp_path / "x.csv"), "start": 0, "length": length, "size": min(length, r.SPLIT_BYTES), "quoted": 0, "header": "a,b"}
    tracemalloc.start()
    found = sum(batch.num_rows for run in (r._survey, r._cut) for batch in run(iter([pa.RecordBatch.from_pylist([row])])) if run is r._cut)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == (row["size"] - 4) // len(line) + (row["size"] < length) and peak < 128 << 20


def test_winners_at_any_place(spark):
    rows = spark.range(0, 100_000, numPartitions=3).select((F.col("id") % 3 * (1 << 33) + F.col("id")).alias("place"), "id")
    for wanted in (F.col("id") % 7 == 0, F.col("id").isin(0, 1, 32_768, 32_769, 99_999), F.lit(False)):
        best = rows.where(wanted).select("place")
        assert sorted(r["id"] for r in of_winners(rows, best).collect()) == sorted(r["id"] for r in rows.where(wanted).collect())


def test_many_winners_do_not_shuffle_the_text_of_others(spark):
    """Where winners are too many to broadcast, only what is read of their own text is shuffled."""
    rows = spark.range(20_000).select(
        F.md5((F.col("id") % 10_000).cast("string")).alias("name"), F.lit("b").alias("address"), F.col("id").cast("string").alias("votes"),
        F.lit("u").alias("url"), F.lit("c").alias("category"), F.lit("[('', 'RATED\\n  " + "a long review " * 20 + "')]").alias("reviews"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "30k")
    try:
        best = best_listings(rows.repartition(spark.sparkContext.defaultParallelism), read_reviews)
        assert best.count() == 10_000
        plan = best._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    dealt, read, marked = (
        [i for i, line in enumerate(plan) if word in line] for word in ("Exchange hashpartitioning(place", "ArrowEvalPython", "BroadcastHashJoin [bucket"))
    assert len(dealt) == 2 and dealt[1] < read[0] < marked[0]
