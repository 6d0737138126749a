import random
import re

import pytest
from pyspark.sql import functions as F

from listingloom.llm import jaccard, links, queries


def shingles(text, k):
    words = re.findall("[^ \t\n\v\f\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def brute(rows, k, percent):
    sets = [shingles(x, k) for _, x in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return sorted(((key, len(sets[i]), least[find(i)] if key is not None else None) for i, (key, _) in enumerate(rows)), key=str)


def near(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def corpus(seed, groups=12, copies=25):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    license = [f"lic{i}" for i in range(40)]
    texts = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 30, 60, 120, 200]))]
        if g % 3 == 0:
            base = license + base
        texts += [" ".join(near(rng, base, rng.choice([0, 0, 1, 1, 2, 3, 5, 8]))) for _ in range(copies if g else 3 * copies)]
    texts += [None, "", "  ", "a", "A", "a b", "A\tB", "a b c", "x " * 50, "x " * 60, "É é", "é é"]
    rng.shuffle(texts)
    return [(i, x) for i, x in enumerate(texts)]


def run(spark, tmp_path, rows):
    spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, node string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op9_jaccard(spark, str(tmp_path))
    assert out.columns[:3] == ["doc_id", "n_shingles", "component_id"]
    return sorted((tuple(r)[:3] for r in out.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_query_agrees_with_brute_force(spark, tmp_path, seed):
    rows = corpus(seed)
    assert run(spark, tmp_path, rows) == brute(rows, 3, 90)


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, "a b c d")], [(None, "a b c d"), (4, "a b c d"), (None, "a b c d"), (4, "z y x"), (4, "a b c D"), (2, "z  y x")]])
def test_small_tables(spark, tmp_path, rows):
    assert run(spark, tmp_path, rows) == brute(rows, 3, 90)


def test_without_hubs_and_with_every_number_of_matches(spark, monkeypatch):
    rows = corpus(7, groups=6, copies=15)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "_hub_pairs", lambda sets, rule: sets.limit(0).select(F.col("node").alias("a"), F.col("doc_id").alias("a_id"), F.col("node").alias("b"), F.col("doc_id").alias("b_id")))
    for cost in (0, 1000):
        monkeypatch.setattr(jaccard, "VERIFY_COST", cost)
        out = jaccard.near_duplicates(df, jaccard.Rule(words=5, percent=80)).collect()
        assert sorted(map(tuple, out), key=str) == brute(rows, 5, 80)


def test_documents_of_the_test_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    out = queries.op9_jaccard(spark, "/root/testdata/sf0.001").collect()
    assert sorted((tuple(r)[:3] for r in out), key=str) == brute(rows, 3, 90)


def test_components_of_a_chain(spark):
    rng = random.Random(3)
    names = rng.sample(range(10**6), 200)
    chain = [(a, b) for a, b in zip(names, names[1:], strict=False) if names.index(b) != 100]
    out = dict(map(tuple, links.components(spark.createDataFrame([*chain, *chain[:5], (7, 7)], "a long, b long")).collect()))
    assert len(set(out.values())) == 2 and len(out) == 200 and len({out[n] for n in names[:100]}) == 1
