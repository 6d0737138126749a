import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from listingloom.llm import merkle, queries, ranks

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, id int, tree string, row long, total int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def grown(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def beside(tree, at):
    out = []
    for nodes in tree[:-1]:
        run = at // 2 * 2
        out.append([(x, i < at) for i, x in enumerate(nodes[run : run + 2], run) if i != at])
        at //= 2
    return out


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    trees = {}
    for lang, part in groups.items():
        part.sort(key=lambda r: (r[0] is None, r[0] or 0, leaf(r)))
        trees[lang] = grown([leaf(r) for r in part])
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    top = grown([trees[x][-1][0] for x in names])
    found = []
    for lang, part in groups.items():
        for at, row in enumerate(part):
            way = beside(trees[lang], at) + beside(top, names.index(lang))
            hit = zlib.crc32(str("" if row[0] is None else row[0]).encode()) % 7 == 0
            node = leaf((*row[:3], row[3] + 1, row[4])) if hit and row[3] is not None else leaf(row)
            for run in way:
                node = digest(*[x for x, left in run if left], node, *[x for x, left in run if not left])
            root = top[-1][0]
            found.append((row[0], leaf(row), trees[lang][-1][0], root, digest(*[x for run in way for x, _ in run]), node, node == root))
    return Counter(found)


def corpus(seed, n):
    rng = random.Random(seed)
    ids = [*range(n // 2), *(rng.randrange(-(1 << 62), 1 << 62) for _ in range(n // 4)), *(rng.choice([-70000, -1, 65535, 65536, n + 5]) for _ in range(n // 8))]
    langs = [None, "", "de", "en", "en", "en", "en", "zz", "é", "null"] + [f"l{i}" for i in range(12)]
    rows = [(i, rng.choice(["web", None, ""]), rng.choice(langs), rng.choice([None, 0, 9, 99, 9999]), rng.choice([None, "", "é" * 300, f"text {rng.random()}"])) for i in ids]
    rows += [(None, "web", "en", 4, f"t{rng.randrange(20)}") for _ in range(n // 4)] + [(7, "web", "only", 1, "x")]
    rows += rng.choices(rows, k=n // 6) + [(11, "s", "de", 1, "long " * 300_000)]
    rng.shuffle(rows)
    return rows


def check(found, rows):
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, found.collect())) == brute(rows)


def test_query_is_as_brute_force(spark, tmp_path):
    rows = corpus(1, 900)
    spark.createDataFrame([(*r, 1, "t", 2, 3) for r in rows], SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    check(queries.op11_merkle(spark, str(tmp_path)), rows)


def test_small_arrays_and_containers(spark, monkeypatch):
    """Many rounds of arrays, also over the groups, and containers as bits."""
    monkeypatch.setattr(merkle, "BITS", 2)
    monkeypatch.setattr(ranks, "MOST_LISTED", 3)
    rows = corpus(2, 240)
    df = spark.createDataFrame([(*r, 1, "t", 2, 3) for r in rows], SCHEMA).repartition(3)
    check(merkle.manifest(df, changed=merkle.tampered()), rows)


@pytest.mark.parametrize("n", [0, 1])
def test_few_rows(spark, n):
    rows = [(5, None, None, None, None)][:n]
    check(merkle.manifest(spark.createDataFrame([(*r, 1, "t", 2, 3) for r in rows], SCHEMA), changed=merkle.tampered()), rows)


def test_ranks_of_lists_and_bits():
    rng = np.random.default_rng(1)
    sets = [np.sort(rng.choice(65536, size=n, replace=False)) for n in (1, 4096, 4097, 65536, 30000, 7)]
    data = [ranks.container(x) for x in sets]
    assert all((ranks.members(d, len(x)) == x).all() for d, x in zip(data, sets))
    found = ranks.Ranks(data, np.array([len(x) for x in sets]))
    at, low = rng.integers(0, len(sets), 3000), rng.integers(0, 65536, 3000)
    assert found.below(at, low).tolist() == [int((sets[a] < x).sum()) for a, x in zip(at, low)]


def test_tampering_is_found(spark):
    rows = [(i, "s", "en", 10, f"text {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    found = merkle.manifest(df, changed=merkle.tampered()).collect()
    assert {r.doc_id for r in found if not r.verified} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 7 == 0}
    assert all(r.verified for r in merkle.manifest(df).collect())
