import math
import random

import numpy as np
import pytest

from listingloom.llm import queries as registered
from listingloom.llm import topk


def brute(rows):
    whole = [(i, v) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    vectors = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in whole]
    out = []
    for n, (i, v) in enumerate(vectors):
        if i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for m, (j, w) in enumerate(vectors) if m != n)
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:20], 1)]
    return sorted(out)


def check(spark, tmp_path, rows, n=4):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score double").repartition(n).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(map(tuple, registered.op3_top_k(spark, str(tmp_path)).collect())) == brute(rows)


def test_ties_and_odd_vectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_VECTORS", 40)
    monkeypatch.setattr(topk, "PACK_VECTORS", 5)
    rng = random.Random(1)
    small = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(5)], 0, 0.0) for i in range(300)]
    odd = [(400, None, 0, 0.0), (420, [1.0, None], 0, 0.0), (440, [1.0, math.nan], 0, 0.0), (460, [math.inf], 0, 0.0), (480, [], 0, 0.0),
           (500, [2.0, 1.0], 0, 0.0), (520, [0.0] * 5, 0, 0.0), (None, [1.0] * 5, 0, 0.0), (540, [1.0] * 7, 0, 0.0), (540, [1.0] * 7, 0, 0.0), (540, [0.5] * 7, 0, 0.0)]
    check(spark, tmp_path, small + odd + small[:50])


def test_rows_that_share_an_id(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_VECTORS", 30)
    rng = random.Random(3)
    rows = [(rng.choice([20, 40, 41, i]), [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)], 0, 0.0) for i in range(300)]
    check(spark, tmp_path, rows + rows[:90])


def test_one_vector_held_by_most_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_VECTORS", 30)
    rng = random.Random(2)
    rows = [(i, [1.0, -1.0, 0.5] if i % 3 else [rng.uniform(-1, 1) for _ in range(3)], 0, 0.0) for i in range(400)]
    check(spark, tmp_path, rows)


@pytest.mark.parametrize("rows", [[], [(None, None, 0, 0.0)], [(20, [1.0], 0, 0.0)], [(20, [1.0], 0, 0.0), (3, [2.0], 0, 0.0)], [(1, [1.0], 0, 0.0)],
                                  [(i, [1e5 * i, 1e7, -1e7 + i], 0, 0.0) for i in range(60)]])
def test_few_and_large(spark, tmp_path, rows):
    check(spark, tmp_path, rows, 1)


def test_vectors_of_the_test_tables(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert sorted(map(tuple, registered.op3_top_k(spark, "/root/testdata/sf0.001").collect())) == brute(rows)


def test_lists_stop_early_on_clustered_vectors():
    rng = np.random.default_rng(6)
    centres = rng.integers(-60, 60, (40, 3))
    vectors = np.repeat(centres, 100, axis=0) + rng.integers(-2, 3, (4000, 3))
    lists = topk.Lists(vectors, 64)
    queries = vectors[::60].astype(lists.vectors.dtype)
    looked = []
    for q, (_, scores, n) in zip(queries, lists.top(queries, [-math.inf] * len(queries), 21), strict=True):
        assert sorted(scores)[-21:] == sorted(vectors @ q.astype(int))[-21:]
        looked.append(n)
    assert sorted(looked)[len(looked) // 2] < len(vectors) / 2


def test_no_cross_join(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 5)]) for i in range(50)]
    plan = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), registered.F.col("vec_id") % 20 == 0)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
