import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from listingloom.llm import pfor, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("make", [
    lambda r, n: np.zeros(n), lambda r, n: r.integers(0, 2**32, n), lambda r, n: r.integers(500, 49408, n),
    lambda r, n: np.where(r.random(n) < 0.05, 2**32 - 1, r.integers(7, 9, n)), lambda r, n: np.full(n, 2**32 - 1),
    lambda r, n: np.where(r.random(n) < 0.2, 2**31, 0),
])
@pytest.mark.parametrize("percentile", [1, 90, 100])
def test_blocks_round_trip(make, percentile):
    ids = make(np.random.default_rng(3), 5 * pfor.BLOCK).astype(np.uint32)
    blocks = pfor.pack(ids, percentile)
    starts = np.cumsum([0, *map(len, blocks)])
    assert (pfor.unpack(b"".join(blocks), starts[:-1]) == ids).all()


def test_outliers_do_not_widen_a_block():
    ids = np.arange(pfor.BLOCK, dtype=np.uint32) % 16
    ids[::100] = 40_000
    assert len(pfor.pack(ids)[0]) < 8 + 4 * 128 + 11 * 6 + 1


def expected(rows, library):
    start = 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        yield key, start, ids
        start += len(ids)


@pytest.mark.parametrize("rows", [
    [], [(None, None)], [(5, "b"), (3, None), (4, ""), (9, "long " * 40000), (7, "x y z"), (1, "<|endoftext|> é")],
    [(i, f"Doc {i * i} of many") for i in range(300)],
])
def test_query_agrees_with_the_library(spark, tmp_path, rows):
    library = Tokenizer.from_file(PATH)
    spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, start int").write.parquet(f"{tmp_path}/documents.parquet")
    out = [tuple(r) for r in queries.op1_token_ids(spark, str(tmp_path)).collect()]
    wanted = [(k, s, len(i), zlib.crc32(np.array(i, dtype="<u4").tobytes())) for k, s, i in expected(rows, library)]
    assert sorted(out, key=lambda r: r[1]) == wanted


def test_ids_come_back_whole_with_equal_keys(spark, tmp_path):
    library = Tokenizer.from_file(PATH)
    rows = [(i % 3 or None, f"text {i % 5}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    pfor.write_ids(df, f"{tmp_path}/ids", PATH, 2)
    out = sorted(pfor.read_ids(spark, f"{tmp_path}/ids").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == sorted((r[0] for r in rows), key=lambda k: k or 0)
    assert sorted((r.doc_id or 0, *r.ids) for r in out) == sorted((k or 0, *i) for k, _, i in expected(rows, library))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(out, out[1:], strict=False))


def test_other_tokenizers_take_whole_texts(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(1, "Two  words\n\nand more"), (0, "x")], "doc_id long, text string")
    pfor.write_ids(df, f"{tmp_path}/ids", path, None)
    out = sorted(pfor.read_ids(spark, f"{tmp_path}/ids").collect(), key=lambda r: r.doc_id)
    assert out[1].ids == Tokenizer.from_file(path).encode("Two  words\n\nand more").ids and out[1].start == len(out[0].ids)


def test_documents_of_the_test_tables(spark):
    library = Tokenizer.from_file(PATH)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    out = sorted((tuple(r) for r in queries.op1_token_ids(spark, "/root/testdata/sf0.001").collect()), key=lambda r: r[1])
    assert out == [(k, s, len(i), zlib.crc32(np.array(i, dtype="<u4").tobytes())) for k, s, i in expected(rows, library)]


def test_pieces_that_come_again_are_not_forgotten():
    from listingloom.llm.worker import Generations

    made, memo = [], Generations(10)

    def ids(piece):
        made.append(piece)
        return piece.encode()

    for i in range(200):
        for piece in ("often", f"once{i}"):
            assert (memo.get(piece) or memo.add(piece, ids)) == piece.encode()
        assert len(memo) <= 10 and len(memo.older) <= 10
    assert made.count("often") == 1 and len(made) == 201
