import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from listingloom.llm import anchors, codes, queries

SCHEMA = "vec_id long, embedding array<float>, label int, row int, code string, error long"


def brute(rows, parts=4, entries=256, rounds=4):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return Counter()
    whole = [[math.floor(1024 * float(np.float32(x))) for x in v] for _, v, _ in kept]
    width = len(whole[0]) // parts
    cut = [[w[p * width : (p + 1) * width] for p in range(parts)] for w in whole]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[cut[i][p] for i in order] for p in range(parts)]

    def assign():
        out = []
        for p in range(parts):
            points, book = np.array([c[p] for c in cut], dtype=object), np.array(books[p], dtype=object)
            far = np.array([[((x - e) ** 2).sum() for e in book] for x in points])
            out.append([(int(row.argmin()), int(row.min())) for row in far])
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            held = defaultdict(list)
            for c, (e, _) in zip(cut, found[p]):
                held[e].append(c[p])
            for e, some in held.items():
                books[p][e] = [sum(xs) // len(some) for xs in zip(*some)]
    found = assign()
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    errors = [sum(found[p][i][1] for p in range(parts)) for i in range(len(kept))]
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors):
        by_label[label] += e
    return Counter((r[0], "".join(f"{found[p][i][0]:02x}" for p in range(parts)), errors[i], by_label[r[2]], digest) for i, r in enumerate(kept))


def corpus(seed, n, dims=8, spread=0.02):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(9)]
    rows = []
    for i in range(n):
        v = [float(np.float32(x + rng.gauss(0, spread))) for x in rng.choice(centers)]
        rows.append((i, v, rng.choice([None, 1, 1, 1, 2])))
    rows += [(3, rows[3][1], 1), (3, rows[3][1], 1), (5, rows[9][1], None), (None, rows[7][1], 2), (n + 1, None, 1), (n + 2, [None] * dims, 1), (n + 3, [math.nan] * dims, 1), (n + 4, [math.inf] + [0.0] * (dims - 1), 7)]
    rows += [(n + 10 + i, [0.0] * dims, None) for i in range(n // 3)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "c", 2) for r in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("n", [200, 420])
def test_query_is_as_brute_force(spark, tmp_path, n):
    rows = corpus(n, n)
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.op12_vector_codes(spark, str(tmp_path))
    assert found.columns[:5] == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, found.collect())) == brute(rows)


def test_few_entries_over_many_balls(spark, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK", 100)
    monkeypatch.setattr(anchors, "LEAF", 3)
    rows, work = corpus(5, 500), []
    found = codes.digests(frame(spark, rows), entries=12, rounds=3, work=work)
    assert Counter(map(tuple, found.collect())) == brute(rows, entries=12, rounds=3)
    assert all(owned > 0 for owned, _ in work)


def test_empty_tables(spark):
    assert codes.digests(frame(spark, [])).collect() == []
    assert codes.digests(frame(spark, [(1, None, 1), (2, [math.nan] * 4, None)])).collect() == []


@pytest.mark.parametrize("vectors", [[[1.0] * 8, [1.0] * 12], [[1.0] * 6], [[1e9] * 8]])
def test_vectors_that_have_no_codes(spark, vectors):
    with pytest.raises(Exception, match="lengths|equal parts|beyond"):
        codes.digests(frame(spark, [(i, v, 1) for i, v in enumerate(vectors)], 1)).collect()


def test_balls_hold_their_points():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-50, 50, (700, 5)), np.zeros((90, 5), dtype=np.int64)])
    t = anchors.Tree.from_bytes(anchors.tree(points).to_bytes())
    assert sorted(t.order) == list(range(len(points)))
    for k in range(len(t.first)):
        inside = points[t.order[t.first[k] : t.last[k]]]
        assert (inside.sum(0) == t.sums[k]).all() and ((inside - t.center[k]) ** 2).sum(1).max() == t.radius[k]
        if t.left[k] >= 0:
            a, b = t.left[k], t.right[k]
            assert (t.first[a], t.last[b]) == (t.first[k], t.last[k]) and t.last[a] == t.first[b]


@pytest.mark.parametrize("seed", range(6))
def test_nearest_entries_are_exact(seed):
    rng = np.random.default_rng(seed)
    scale = [2, 30, 1000, 1 << 27][seed % 4]
    points = rng.integers(-scale, scale, (600, 3))
    entries = np.concatenate([points[:20], points[:5], rng.integers(-scale, scale, (15, 3))])
    found = anchors.nearest(anchors.tree(points), points, entries)
    far = np.array([[int(((p.astype(object) - e) ** 2).sum()) for e in entries] for p in points], dtype=object)
    best = np.array([min(range(len(entries)), key=lambda j: (row[j], j)) for row in far])
    assert (found.codes == best).all()
    assert (found.counts == np.bincount(best, minlength=len(entries))).all()
    assert all((found.sums[e] == points[best == e].sum(0)).all() for e in range(len(entries)))
