import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from listingloom.llm import quality

BLANK = " \t\n\v\f\r"
TEXTS = [
    None, "", " \n ", "one", "a b c a b c", "x\nx\n\nx \ny # <b>", "été à l’été é z", "same line\nsame line\r\nsame line",
    "word " * 3000, "#*$%&|<> " * 40, "a\x00b c", "z" * 9000, "ab ab ab ab", "a\n\n\na",
    " ".join(f"w{i * 7919 % 1000}" for i in range(4000)),
]


def brute(text):
    text = text or ""
    words = re.findall(f"[^{BLANK}]+", text)
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))


def test_counts_agree_with_brute_force(spark, tmp_path):
    rows = [(i, x, "clash") for i, x in enumerate(TEXTS + TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string").repartition(3)
    out = quality.measured(df).select("row.doc_id", F.col("row.n_words").alias("own"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert len(out) == len(rows)
    for r in out:
        assert tuple(r[2:]) == brute(rows[r.doc_id][1]), rows[r.doc_id]
        assert r.own == "clash"


def test_documents_of_the_test_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for r in quality.measured(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.row.text)


def test_bands_reject_repetition_and_noise_only(spark):
    import base64, random
    rng = random.Random(4)
    prose = " ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(900))
    noise = " ".join(base64.b64encode(rng.randbytes(9)).decode() + chr(rng.randint(0x4E00, 0x9FFF)) * 2 for _ in range(900))
    loop = " ".join(f"{w}" for _ in range(300) for w in ("round", "and", "about"))
    half = prose[:2200] + "\n" + "-=" * 5000
    df = spark.createDataFrame([(0, prose), (1, noise), (2, loop), (3, half), (4, "short " * 3), (5, None)], "doc_id long, text string")
    kept = {r.row.doc_id for r in quality.measured(df).filter(quality.in_bands()).collect()}
    assert kept == {0, 4, 5}
    assert [r.doc_id for r in quality.accepted(df).collect()] == [0]


@pytest.mark.parametrize("rows", [[], [(None, None)]])
def test_empty_tables_and_nulls(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert quality.measured(df).count() == len(rows)
    assert quality.accepted(df).columns == ["doc_id", "text"]


LENGTHS = [270, 300, 350, 400, 430, 480, 600, 700, 900, 1500, 3000, 6000, 12000, 20000, 100000]


def cut(piece, n):
    text = ""
    while len(text.encode()) < n:
        text += piece()
    return text.encode()[:n].decode(errors="ignore")


@pytest.fixture(scope="module")
def bands_by_kind(spark):
    """Whether texts lie inside the bands, by kind and bytes."""
    import base64, random
    rng = random.Random(11)
    words = ["".join(rng.choices("etaoinshrdlucmfw", range(16, 0, -1), k=rng.randint(1, 9))) for _ in range(3000)]
    common = [chr(0x4E00 + 13 * i) for i in range(600)]
    kinds = {
        "prose": lambda: rng.choices(words, [1 / (i + 3) for i in range(3000)])[0] + rng.choice("    \n,"),
        "chinese": lambda: rng.choices(common, [1 / (i + 5) for i in range(600)])[0],
        "base64 lines": lambda: base64.b64encode(rng.randbytes(57)).decode() + "\n",
        "base64 words": lambda: base64.b64encode(rng.randbytes(6)).decode() + " ",
        "printable": lambda: chr(rng.randint(33, 126)) + " " * (rng.random() < 0.12),
        "ideographs": lambda: chr(rng.randint(0x4E00, 0x9FFF)),
        "latin-1": lambda: chr(rng.choice([*range(32, 127), *range(160, 256)])),
        "hex": lambda: rng.randbytes(16).hex() + " ",
    }
    rows = [(kind, n, cut(piece, n)) for kind, piece in kinds.items() for n in LENGTHS]
    df = spark.createDataFrame(rows, "kind string, n int, text string")
    out = quality.measured(df).select("row.kind", "row.n", "n_chunks", "n_bad_chunks", quality.in_bands().alias("inside")).collect()
    return {(r.kind, r.n): r for r in out}


@pytest.mark.parametrize("n", LENGTHS)
def test_each_length_band_parts_prose_from_noise(bands_by_kind, n):
    for kind in ("prose", "chinese", "hex"):  # hex is no denser than short prose; see DOCUMENT_BANDS
        r = bands_by_kind[kind, n]
        assert r.inside and r.n_bad_chunks == 0, r
    for kind in ("base64 lines", "base64 words", "printable", "ideographs", "latin-1"):
        r = bands_by_kind[kind, n]
        assert not r.inside and r.n_bad_chunks == r.n_chunks, r
