"""Parsing and text functions, value by value."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from listingloom import fixed
from listingloom.functions import parse, reviews, text, vectors
from tests import rows


def values(spark, cases, function, schema="string"):
    frame = spark.createDataFrame([(i, case) for i, case in enumerate(cases)], f"i int, x {schema}")
    return [row[1] for row in frame.select("i", function(F.col("x"))).orderBy("i").collect()]


def check(spark, cases, function, schema="string"):
    assert values(spark, list(cases), function, schema) == list(cases.values())


def test_rating(spark):
    """n/5 with any white space, and nothing else."""
    rng = random.Random(1)
    numbers = [str(rng.randrange(12)) for _ in range(6)] + [f"{rng.randrange(12)}.{rng.randrange(99)}" for _ in range(12)]
    check(spark, {f"{rng.choice(['', ' '])}{n}{rng.choice(['', ' ', chr(9)])}/{rng.choice(['', ' '])}5{rng.choice(['', ' '])}": float(n) for n in numbers}, parse.rating)
    check(spark, {case: None for case in [*(f"{n}/50" for n in numbers), *(f"x{n}/5" for n in numbers), *numbers, "", "--", None]}, parse.rating)


def test_price(spark):
    """Digits with commas anywhere, and nothing else."""
    rng = random.Random(2)
    numbers = [rng.randrange(10**k) for k in range(1, 9) for _ in range(2)]
    check(spark, {f" {n:,} ": n for n in numbers} | {str(n): n for n in numbers} | {f"{n},": n for n in numbers}, parse.price)
    check(spark, {case: None for case in [*(f"{n}.0" for n in numbers), *(f"-{n}" for n in numbers), *(f"{n} x" for n in numbers), "", None]}, parse.price)


def test_votes(spark):
    check(spark, {"775": 775, " 12 ": 12, "3.7": 3, "1e3": 1000, None: 0, "many": 0, "1,000": 0, "5d": 0, "inf": 0, "-2": -2}, parse.votes)


def test_fix_text(spark):
    check(spark, {
        **{word.encode().decode("latin-1") + "  \n x ": f"{word} x" for word in ("zöß", "ñandù çà", "ÿ")},
        "  a  b\u0085c \x1c d ": "a b c d",
        "Ã but 漢": "Ã but 漢",  # not Latin-1
        "Ã©a â": "Ã©a â",  # not UTF-8 bytes
        "plain text": "plain text", None: "", "   ": "",
    }, text.fix_text)


def test_split_list(spark):
    rng = random.Random(3)
    lists = [[rows.word(rng) + rng.choice(["", " q"]) for _ in range(rng.randrange(5))] for _ in range(20)]
    check(spark, {rng.choice([",", " ,", ", "]).join(x) + rng.choice(["", ",", " , "]): x for x in lists}, text.split_list)
    check(spark, {"b, a ,b,, ": ["b", "a"], None: []}, text.split_list)


def test_truncate(spark):
    check(spark, {"short": "short", "one two three": "one two...", "one two 345 6": "one two...", "onetwothreefour": "onetwothre...", "one two 34": "one two 34"},
          lambda c: text.truncate(c, 10))


def test_entity_id_is_the_md5_of_name_and_address(spark):
    import hashlib

    names = [rows.word(random.Random(i)) for i in range(9)]
    expected = [hashlib.md5(f"{n}|é 1".encode()).hexdigest()[:16] for n in names]
    assert values(spark, names, lambda c: text.entity_id(c, F.lit("é 1"))) == expected


def test_base_area(spark):
    areas = rows.vocabulary(random.Random(4))[1]
    check(spark, {a: re.sub(r"\s+\d.*$", "", a) for a in areas} | {"7x y": "7x y", "A 1 B 2": "A", "B2": "B2"}, text.base_area)


def test_url_yes_and_numbers(spark):
    check(spark, {"http://a?b?c": "http://a", "http://a": "http://a", None: None}, parse.url_path)
    check(spark, {"Yes": True, "yes": False, None: False}, parse.yes)
    check(spark, {"4.5": 4.5, "NaN": None, "x": None, None: None}, parse.clean_number)
    check(spark, {"NA": None, "": None, "nan": None, "N/A": None, "Nan": "Nan", "x": "x", None: None}, parse.null_tokens)


def test_parse_reviews(spark):
    rng = random.Random(5)
    said = [" ".join(rows.word(rng) for _ in range(rng.choice([1, 5, 12]))) for _ in range(40)]
    cells = {repr([(rows.word(rng), rng.choice(["", "RATED\n  "]) + s) for s in part]): [s for s in dict.fromkeys(part) if len(s) >= 30]
             for part in (rng.choices(said, k=rng.randrange(6)) for _ in range(30))}
    check(spark, cells, reviews.parse_reviews)
    odd = "[1, 'text', ('only one',), (None, 'RATED A label may be missing here, fine.'), ('n', 12345678901234567890123456789012)]"
    check(spark, {
        odd: ["A label may be missing here, fine.", "12345678901234567890123456789012"],
        "plain words": [], "[(cut off": [], "[]": [], None: [], "[('a', 'b'": [], "[{[]: 1}]": [], "(('a', 'b'),)": [],
    }, reviews.parse_reviews)


def test_parse_reviews_keeps_escapes_and_lone_surrogates(spark):
    cell = "[('a', 'It\\'s a \"quoted\" text \\u00e9 with an odd \\d \\ud800 end')]"
    assert values(spark, [cell], reviews.parse_reviews) == [["It's a \"quoted\" text é with an odd \\d ? end"]]


def test_excerpts_put_topics_first_and_keep_source_order(spark):
    rng = random.Random(6)
    texts = [f"{rows.word(rng, 2)} {rng.choice([t.upper(), t, t + 'z', 'é' + t])} {i}" for i, t in enumerate(rng.choices(fixed.REVIEW_TOPICS, k=12))]
    topical = [t for t in texts if t.split()[1].lower() in fixed.REVIEW_TOPICS]
    assert 0 < len(topical) < len(texts)
    assert values(spark, [texts], reviews.excerpts, "array<string>") == [(topical + [t for t in texts if t not in topical])[:6]]


def test_pure_veg(spark):
    """A name that says so without negating it, or a review that says it strictly."""
    by_name = {"": False, "veg": True, "vegas": False, "non-veg veg": False, "éveg": False, "Vegetarian": True}
    by_review = {"pure ": True, "pure-": True, "PURE  ": True, "impure ": False, "": False, "pure": True}
    cases = [(f"q {name}", [f"q {prefix}veg{tail} q"], said or (strict and tail != "x"))
             for name, said in by_name.items() for prefix, strict in by_review.items() for tail in ("", "etarian", "x")]
    frame = spark.createDataFrame([case[:2] for case in cases], "n string, r array<string>")
    assert [row[0] for row in frame.select(reviews.is_pure_veg(F.col("n"), F.col("r"))).collect()] == [case[2] for case in cases]


@pytest.mark.parametrize("sizes, limit", [([300] * 5, 700), ([800, 10, 10], 700), ([], 700), ([5, 5, 5], 19), ([5, 5, 5], 18)])
def test_pack(spark, sizes, limit):
    texts = [chr(97 + i) * size for i, size in enumerate(sizes)]
    [packed] = values(spark, [texts], lambda c: reviews.pack(c, limit), "array<string>")
    assert "\n".join(packed) == "\n".join(f'- "{t}"' for t in texts)  # whole and in order
    assert all(len(body) <= limit or body.count("\n") == 0 for body in packed)
    for first, second in zip(packed, packed[1:]):  # greedy: the next piece did not fit
        assert len(first) + 1 + len(second.split("\n")[0]) > limit


def test_embedding_has_unit_length_and_is_the_same_in_any_batch(spark):
    texts = ["red bolts", "", None, "red bolts red", "Über café"]
    vectors_by = [values(spark, texts, lambda c: vectors.embed(c, vectors.HashedTokens(16), size)) for size in (1, 64)]
    assert vectors_by[0] == vectors_by[1]
    lengths = [round(sum(x * x for x in v), 5) for v in vectors_by[0]]
    assert lengths == [1.0, 0.0, 0.0, 1.0, 1.0]


def test_a_model_is_loaded_once_per_worker(monkeypatch):
    import sys
    import types

    loaded = []

    class Model:
        def __init__(self, name, device):
            loaded.append((name, device))

        def encode(self, texts):
            return [[1.0]] * len(texts)

    monkeypatch.setitem(sys.modules, "sentence_transformers", types.SimpleNamespace(SentenceTransformer=Model))
    monkeypatch.setitem(sys.modules, "listingloom_worker", types.ModuleType("listingloom_worker"))
    encoder = vectors.SentenceEncoder("m")
    assert encoder()(["a", "b"]) == encoder()(["c", "d"]) == [[1.0], [1.0]]
    assert loaded == [("m", "cpu")]


def test_l2_normalise(spark):
    assert values(spark, [[3.0, 4.0], [0.0, 0.0], None], vectors.l2_normalise, "array<float>") == [[0.6, 0.8], [0.0, 0.0], None]


def test_hashed_tokens_count_words_of_each_text():
    rng, encode = random.Random(4), vectors.HashedTokens(32)()
    for n in (0, 1, 3, 64):
        texts = ["".join(rng.choice("abCD éß٣①_ \n\0.-") for _ in range(rng.randint(0, 40))) for _ in range(n)]
        want = np.zeros((n, 32))
        for row, text in zip(want, texts, strict=True):
            for word in re.findall(r"[^\W_]+", text):
                row[int(hashlib.md5(word.lower().encode()).hexdigest()[:8], 16) % 32] += 1
        assert encode(texts).shape == (n, 32) and (encode(texts) == want).all()


def test_parsed_cells_leave_the_worker_in_slices(monkeypatch):
    monkeypatch.setattr(text, "SLICE_CHARS", 100)
    cells = pd.Series([repr([("", "x" * n)]) if n else None for n in (10, 20, 0, 300, 5, 90, 1)])
    parts = list(reviews._literal_texts.func(iter([cells])))
    assert [len(part) for part in parts] == [3, 1, 1, 1, 1] and all(part.index.tolist() == list(part.index) for part in parts)
    assert [x for part in parts for x in part] == [["x" * n] if n else [] for n in (10, 20, 0, 300, 5, 90, 1)]


def test_long_texts_are_not_encoded_together(spark):
    counts = lambda: lambda texts: np.array([[len(texts), 0.0] if len(texts) == 1 else [0.0, len(texts)] for _ in texts])
    texts = ["x" * 600_000] * 3 + ["y", "z"]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").coalesce(1)
    found = [r[1] for r in frame.select("i", vectors.embed(F.col("x"), counts)).orderBy("i").collect()]
    assert found == [[1.0, 0.0]] * 2 + [[0.0, 1.0]] * 3
