"""The verdict of op10_quality_rules on whole tables, held against the rules restated in tests/llm/test_pipeline.py."""

import random

from listingloom.llm import queries
from tests.llm.test_pipeline import passes
from tests.llm.test_quality import brute


def expected(rows):
    out = []
    for key, text in rows:
        n_words, _, _, _, n_repeat = brute(text)
        out.append((key, n_words < 50 or 100 * n_repeat > 50 * n_words, passes(text or "")))
    return sorted(out)


def found(spark, sf_dir):
    return sorted(map(tuple, queries.op10_quality_rules(spark, sf_dir).select("doc_id", "base_failed", "kept").collect()))


def test_documents_of_the_test_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert found(spark, "/root/testdata/sf0.001") == expected(rows)


def test_repetition_noise_and_wide_scripts(spark, tmp_path):
    rng = random.Random(10)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    han = [chr(0x4E00 + i) for i in range(3000)]
    ascii_noise = [chr(i) for i in range(33, 127)]
    rows = [(1, None), (2, ""), (3, "word " * 49)]
    rows += [(10 + i, " ".join(word("abcdefghij", rng.randrange(2, 7)) for _ in range(60 * 4**i))) for i in range(5)]
    rows += [(20 + i, " ".join(word(ascii_noise, 12) for _ in range(60 * 4**i))) for i in range(5)]
    rows += [(30 + i, " ".join(word(han, rng.randrange(1, 4)) for _ in range(60 * 4**i))) for i in range(4)]
    # Long runs inside words compress far, though no window of three words repeats.
    rows += [(40 + i, " ".join(f"{k:05d}" + "x" * 400 for k in range(60 * 4**i))) for i in range(4)]
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = found(spark, str(tmp_path))
    assert got == expected(rows)
    kept = {k for k, _, ok in got if ok}
    assert any(10 <= k < 20 for k in kept) and not any(20 <= k < 30 or 40 <= k < 50 for k in kept)
    assert any(not base and not ok for _, base, ok in got)
