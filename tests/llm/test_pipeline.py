import duckdb
import pyarrow as pa
import pytest
import zstandard
from tokenizers import Tokenizer

import corpus_pipeline
from listingloom.llm import mixing, quality, queries, secrets
from tests.llm.test_jaccard import brute as near_duplicates
from tests.llm.test_quality import brute as counts

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def passes(text):
    """The quality rules on one text, restated."""
    n_words, _, _, _, n_repeat = counts(text)
    if n_words < 50 or 100 * n_repeat > 50 * n_words:
        return False
    raw, bands = text.encode(), quality.Bands()
    share = lambda x: len(zstandard.ZstdCompressor(level=3).compress(x)) / len(x)
    _, low, high = max(b for b in bands.document if b[0] <= len(raw))
    chunks = [raw[i : i + 2048] for i in range(0, len(raw), 2048)] if len(raw) >= 4096 else []
    chunks = [c for c in chunks if len(c) >= 1024]
    bad = sum(not bands.chunk[0] <= share(c) <= bands.chunk[1] for c in chunks)
    return low <= share(raw) <= high and bad <= 0.5 * len(chunks)


def brute(rows):
    rows = [r for r in rows if passes(r[1])]
    least = near_duplicates([(r[0], r[1]) for r in rows], 5, 80)
    stays = {k for k, _, c in least if k == c}
    rows = list({(r[0], r[1]): r for r in rows if r[0] in stays}.values()) + [r for r in rows if r[0] is None]
    rows = [(k, x := secrets.covered(text, secrets.spans(text), "[SECRET]"), lang, source, len(x)) for k, text, lang, source, _ in rows]
    documents = pa.table({c.split()[0]: [r[i] for r in rows] for i, c in enumerate(COLUMNS.split(", "))}, schema=pa.schema(
        [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]))
    con = duckdb.connect()
    con.register("documents", documents)
    drawn = [r[0] for r in con.sql(f"SELECT doc_id FROM ({mixing.oracle()})").fetchall()]
    by, library = {r[0]: r for r in rows}, Tokenizer.from_file(queries.tokenizer_path())
    out = []
    for k in drawn:
        ids = library.encode(by[k][1], add_special_tokens=False).ids
        out.append((*by[k][:1], *by[k][2:], len(ids), ids))
    return sorted(out, key=str)


def test_documents_of_the_test_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids")
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows) and out.count() > 50


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(None, " ".join(f"{i * i * 7919 % 99991:x}" for i in range(200)), None, None, 5)] * 2])
def test_small_tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == len([r for r in rows if r[1]])


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.toArrow())
