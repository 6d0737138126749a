import math
from collections import Counter, defaultdict

import duckdb
import pytest

from listingloom.llm import mixing, queries


def both(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, source string, place int, part string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = con.sql(queries.SQL["op7_mixing"])
    out = queries.op7_mixing(spark, str(tmp_path))
    assert sorted(out.columns) == sorted(sql.columns)
    got = out.select(*sql.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, sql.fetchall()))
    return got


def test_skewed_sources(spark, tmp_path):
    rows = [(i, "w " * (i % 40 + 1), f"s{min(i % 30, 6) if i % 3 else 0}", 1, "x") for i in range(3000)]
    out = both(spark, tmp_path, rows)
    total = sum(i % 40 + 1 for i in range(3000))
    tokens, most = Counter(), defaultdict(int)
    for r in out:
        tokens[r.source] += r.n_tokens
        most[r.source] = max(most[r.source], r.epoch + 1)
    mixed = sum(tokens.values())
    assert 0.97 * total < mixed <= total
    entropy = -sum(n / mixed * math.log(n / mixed) for n in tokens.values())
    natural = Counter()
    for r in rows:
        natural[r[2]] += len(r[1]) // 2
    assert -sum(n / total * math.log(n / total) for n in natural.values()) < entropy < 0.95 * math.log(len(natural)) + 0.02
    assert max(most.values()) <= 2


def test_odd_rows(spark, tmp_path):
    rows = [(None, None, None, 1, "x"), (1, "", "empty", 1, "x"), (1, "", "empty", 1, "x"), (2, "a b", None, 1, "x"), (2, "a b", None, 1, "x"),
            (3, "word " * 50000, "long", 1, "x"), *((i, "t " * 9, "rest", 1, "x") for i in range(10, 60))]
    out = both(spark, tmp_path, rows)
    assert Counter(r.source for r in out)["empty"] == 2


@pytest.mark.parametrize("rows", [[], [(1, None, "a", 1, "x")], [(1, "a b c", "a", 1, "x")]])
def test_small_tables(spark, tmp_path, rows):
    assert len(both(spark, tmp_path, rows)) <= 1


def test_repetition_limit_decides(spark):
    rows = [(i, "w " * 10, "large" if i < 1900 else f"small{i % 4}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for limit in (1.5, 3.0):
        out = mixing.mixed(df, mixing.Target(entropy=1.0, repeats=limit)).collect()
        n = Counter(r.row.source for r in out)
        assert max(n[f"small{k}"] / 25 for k in range(4)) <= limit + 1e-6
        assert min(n[f"small{k}"] / 25 for k in range(4)) > limit - 0.1
    assert all(c == 1 for c in Counter((r.row.doc_id, r.epoch) for r in out).values())


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    plan = mixing.mixed(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_documents_of_the_test_tables(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    sql = con.sql(queries.SQL["op7_mixing"])
    out = queries.op7_mixing(spark, "/root/testdata/sf0.001").select(*sql.columns).collect()
    assert sorted(map(tuple, out)) == sorted(sql.fetchall()) and len(out) > 100
