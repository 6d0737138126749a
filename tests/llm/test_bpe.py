import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from listingloom.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "Hello, World's best!", "it's we'll I'D you're <|endoftext|> x<|startoftext|>y <|END|>", "ΣΑΣ ΟΔΟΣ σς İstanbul ǅ",
    "été été ﬁ Å Å", "a\x1cb\x1dc\x85d e᠎f​g﻿h", "日本語テキスト 12345 ½ ٣", "😀👩‍👩‍👧 ok", "a" * 5000, "ab" * 3000 + "!?" * 3000,
    "\x00\x01\x7f", "the quick brown fox " * 200, "'s't're", "''''ss", "<|endoftext|><|endoftext|>", "unbelievableness antidisestablishmentarianism",
]


@pytest.fixture(scope="module")
def words():
    return bpe.vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_and_texts_agree_with_the_library(words, library):
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz' -_.,éüßñÇЖ中0123456789\n"
    texts = [x or "" for x in TEXTS] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 200))) for _ in range(1500)]
    texts += ["".join(rng.choice("aehinorst") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    ids, counts = words.encoder.ids(pa.array(texts))
    ends = np.cumsum(counts)
    decoded = words.decode(ids, counts).to_pylist()
    for text, end, n, back in zip(texts, ends, counts, decoded, strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids[end - n : end].tolist() == expected, text
        assert back == library.decode(expected, skip_special_tokens=False), text


def test_every_token_is_its_own_encoding(words, library):
    merges = words.encoder.encode.__self__
    for token in range(0, len(merges.parts), 53):
        if merges.parts[token]:
            assert not merges.compatible(*merges.parts[token])
            name = words.names[int(merges.ids[token])].as_py()
            assert [y.id for y in library.model.tokenize(name.removesuffix("</w>"))] == [merges.ids[token]] or not name.endswith("</w>")


def test_query_agrees_with_the_library(spark, tmp_path, library):
    rows = [(i, x, 5) for i, x in enumerate(TEXTS + TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op5_bpe(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    for r in out:
        ids = library.encode(rows[r.doc_id][1] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_columns_round_trip(spark, library):
    df = spark.createDataFrame([(1, x, [9]) for x in TEXTS], "a long, text string, ids array<int>")
    coded = bpe.encoded(df, PATH)
    for r in coded.collect():
        assert r.row.ids == [9] and r.ids == library.encode(r.row.text or "", add_special_tokens=False).ids
    back = bpe.decoded(coded.select("row", "ids"), PATH).collect()
    assert all(r.decoded == library.decode(r.row.ids, skip_special_tokens=False) for r in back)
    odd = spark.createDataFrame([(None,), ([],), ([320, 10**9, 49407],)], "ids array<bigint>")
    assert [r.decoded for r in bpe.decoded(odd, PATH).collect()] == ["", "", library.decode([320, 49407], skip_special_tokens=False)]
    assert bpe.encoded(df.limit(0), PATH).count() == 0


def test_documents_of_the_test_tables(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in queries.op5_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
