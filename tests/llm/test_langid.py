import itertools
import random
import zlib

import numpy as np
import pytest

from listingloom.llm import langid, queries

SYLLABLES = {"aa": ["ka", "lo", "mi", "tur"], "bb": ["sch", "ein", "zu", "pf"], "гг": ["при", "вет", "да", "ко"]}


def prose(lang, rng, n=40):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(5)
    rows = [(lang, prose(lang, rng)) for lang in SYLLABLES for _ in range(60)] + [(None, "ka ka"), ("aa", None)]
    return langid.learn(spark.createDataFrame(rows, "lang string, text string"))


def test_paths_are_the_best_of_all(spark):
    rng = np.random.default_rng(2)
    scores = rng.normal(size=(30, 3)).astype(np.float32)
    first = np.array([0, 5, 5, 12, 13])
    at = rng.integers(0, 30, 13)
    path = langid._best_paths(scores, at, first, 1.3)

    def value(words, labels):
        return sum(scores[w, x] for w, x in zip(words, labels, strict=True)) - 1.3 * sum(a != b for a, b in itertools.pairwise(labels))

    for a, b in itertools.pairwise(first):
        best = max((value(at[a:b], p) for p in itertools.product(range(3), repeat=b - a)))
        assert value(at[a:b], path[a:b]) == pytest.approx(best, abs=1e-4)


def test_spans_of_mixed_texts(spark, model):
    rng = random.Random(9)
    parts = [("aa", 30), ("bb", 20), ("гг", 10)]
    text = " 17 ".join(prose(lang, rng, n) for lang, n in parts)
    df = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "12 34 --", "x"), (4, "", "x"), (5, "при ka", "x")], "id long, text string, score string")
    out = {r.row.id: r for r in langid.identified(df, model).collect()}
    assert [s.lang for s in out[1].spans] == ["aa", "bb", "гг"] and sum(s.words for s in out[1].spans) == 62
    assert out[1].lang_pred == "aa" and out[1].score == pytest.approx(0.5, abs=0.05) and out[1].row.score == "x"
    for k in (2, 3, 4):
        assert (out[k].spans, out[k].lang_pred, out[k].score) == ([], "und", 0.0)
    assert langid.identified(df.limit(0), model).count() == 0


def test_scripts_narrow_candidates(model):
    names = list(langid.SCRIPTS)
    latin, cyrillic, greek = (2 + names.index(x) for x in ("latin", "cyrillic", "greek"))
    assert model.candidates[latin].tolist() == [True, True, False]
    assert model.candidates[cyrillic].tolist() == [False, False, True]
    assert model.candidates[greek].all()


def test_without_rows_to_learn_from(spark):
    df = spark.createDataFrame([(1, None, "ka lo")], "doc_id long, lang string, text string")
    empty = langid.learn(df)
    assert [(r.lang_pred, r.score) for r in langid.identified(df, empty).collect()] == [("und", 0.0)]


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    out = queries.op8_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(out) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.97
