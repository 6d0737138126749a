import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from listingloom.llm import copies, queries, quotient

SCHEMA = "doc_id long, text string, row long, key string, kept int"


def brute(rows):
    texts = [re.sub("[ \t\n\v\f\r]+", " ", x or "") for _, x in rows]
    sizes, keep = Counter(texts), {}
    for (i, _), x in zip(rows, texts):
        if i is not None:
            keep[x] = min(keep.get(x, i), i)
    return Counter((i, keep.get(x), sizes[x], hashlib.sha256(x.encode()).hexdigest()) for (i, _), x in zip(rows, texts)), set(texts)


def check(found, rows):
    expected, texts = brute(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == expected
    kept = [r for r in found if r.kept]
    assert len(kept) == len(texts) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def corpus(seed, n):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("ab  \t\n é") for _ in range(rng.randrange(0, 12))) for _ in range(n // 2)] + ["hot  text"] * (n // 3)
    rows = [(i, rng.choice(pool)) for i in range(n)]
    rows += [(None, "hot text"), (None, "only here, without an id"), (None, "only here, without an id"), (3, rows[3][1]), (3, rows[3][1]), (n, None), (n + 1, ""), (n + 2, " "), (n + 3, "\n")]
    rows += [(n + 4, "long " * 200_000), (n + 5, "long\t" * 200_000), (n + 6, "long " * 200_000 + "x")]
    rng.shuffle(rows)
    return rows


def test_query_is_as_brute_force(spark, tmp_path):
    rows = corpus(1, 600)
    spark.createDataFrame([(i, x, 1, "k", 0) for i, x in rows], SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op13_copies(spark, str(tmp_path))
    assert found.columns[:5] == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    check(found.collect(), rows)


@pytest.mark.parametrize("bits", [5, 9])
def test_equal_fingerprints_of_different_texts_are_told_apart(spark, bits):
    rows = corpus(2, 300)
    check(copies.verdicts(spark.createDataFrame([(i, x, 1, "k", 0) for i, x in rows], SCHEMA).repartition(3), bits=bits).collect(), rows)


def test_empty_table(spark):
    assert copies.verdicts(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repeated_keys_are_those_of_a_count(spark):
    rng = random.Random(3)
    keys = [int(rng.paretovariate(0.4)) % (1 << 20) for _ in range(4000)] + [0] * 500 + [(1 << 20) - 1] * 3
    df = spark.createDataFrame([(k,) for k in keys], "key long").repartition(6)
    assert sorted(r.key for r in copies.repeated(df, 20).collect()) == sorted(k for k, c in Counter(keys).items() if c > 1)


@pytest.mark.parametrize("seed", range(12))
def test_filters_keep_and_add_all_counts(seed):
    rng = random.Random(seed)
    bits = rng.choice([4, 5, 8, 16, 40, 62])
    parts = []
    for _ in range(rng.randrange(1, 5)):
        keys = {rng.randrange(1 << bits) for _ in range(rng.choice([0, 1, 10, 300]))} | ({0, (1 << bits) - 1} if rng.random() < 0.5 else set())
        parts.append({k: rng.choice([1, 1, 1, 2, 3, 4, 5, 9, 1000, 10**9]) for k in keys})
    made = []
    for part in parts:
        keys = sorted(part)
        made.append(quotient.built(np.array(keys, dtype=np.uint64), np.array([part[k] for k in keys], dtype=np.int64), bits))
        found, counts = quotient.read(made[-1])
        assert dict(zip(found.tolist(), counts.tolist())) == part and found.tolist() == keys
    total = Counter()
    for part in parts:
        total.update(part)
    found, counts = quotient.read(quotient.merged(made, bits))
    assert dict(zip(found.tolist(), counts.tolist())) == dict(total) and found.tolist() == sorted(total)


def test_every_short_run_is_read_back():
    width = 3
    for x in range(1 << width):
        for count in [*range(1, 80), 500]:
            for y in range(x + 1, 1 << width):
                for again in (1, 2, 3, 11):
                    run = []
                    for v, c in ((x, count), (y, again)):
                        run += [v] * c if c < 3 else quotient._counted(v, c, width)
                    assert quotient._uncounted(run, width) == [(x, count), (y, again)]
