import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from downfield.llm import simple8b as S
from tests.llm import fixtures as X

P = pytest.importorskip("public_tokenizers")


def test_round_trip_of_any_values():
    r = random.Random(1)
    for n in (0, 1, 2, 59, 60, 61, 1000, 5000):
        for bits in (0, 1, 7, 16, 40, 60, 64):
            v = np.array([r.getrandbits(r.randint(0, bits)) if bits else 0 for _ in range(n)], np.uint64)
            words = S.pack(v)
            assert (S.unpack(words, n) == v).all()
    assert len(S.pack(np.zeros(600, np.uint64))) == 10
    v = np.full(10, 15 << 60, np.uint64)
    assert (S.unpack(S.pack(v), 10) == v).all()


def test_marks_let_a_reader_start_anywhere():
    v = np.arange(20000, dtype=np.uint64)
    data = S.block(3, [9], [0], [20000], v)
    magic, shard, n_docs, n_words, n_marks, n_ids = S._HEAD.unpack_from(data)
    marks = np.frombuffer(data, np.uint32, n_marks, S._HEAD.size + 13)
    words = np.frombuffer(data, np.uint64, n_words, S._HEAD.size + 13 + 4 * n_marks)
    for k in (0, 1, n_marks - 1):
        assert (S.unpack(words[k * S.MARK :], 50)[:50] == v[marks[k] : marks[k] + 50]).all()


def test_files_equal_the_library(spark, monkeypatch):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = X.AWKWARD + ["It's 12 o'clock\tÉÇOLE  é Σας ΣΑΣ <|endoftext|> x", "a b ́c"]
    rows = sorted((-1 if x == "no id" else i, x or "") for i, x in enumerate(texts))
    got = S.token_table(X.docs(spark, texts), path).collect()
    got.sort(key=lambda r: r["start"])
    at = 0
    assert len(got) == len(rows)
    for r, (i, x) in zip(got, rows):
        ids = [*t.encode(x, add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (None if i < 0 else i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_a_document_over_several_blocks(spark):
    long = " ".join(X.words(40000, 3))
    got = S.token_table(X.docs(spark, ["a", long, "b", long]), P.path("word_bpe_49k.json")).orderBy("start").collect()
    assert [r["n_tokens"] for r in got][1] == [r["n_tokens"] for r in got][3] > S.BLOCK_IDS
    assert got[1]["ids_crc32"] == got[3]["ids_crc32"]


def test_empty(spark):
    assert S.token_table(X.empty(spark), P.path("word_bpe_49k.json")).count() == 0


def test_encoder_on_odd_texts():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t, e = Tokenizer.from_file(path), S.Encoder.at(path)
    odd = ["naïve Straße İstanbul ’s «x» 12½ it'S ''s we'll\x85a\xa0b\x1cc", "x ́y", "é", "漢字 and", "ŉ ǆ K µ", "don''t've", "", "<|startoftext|>a", "ΣΣ ΣαΣ", "a b c"]
    for texts in (odd, odd[::-1], X.AWKWARD[1:]):
        for text, got in zip(texts, e.encode(texts)):
            assert got == np.array(t.encode(text, add_special_tokens=False).ids, np.uint32).tobytes(), text


def test_read_from_any_place():
    r = random.Random(9)
    v = np.array([r.getrandbits(r.choice((1, 5, 17, 63))) for _ in range(30000)], np.uint64)
    v[5000:9000] = 1 << 63  # escapes on both sides of marks
    data = S.block(3, [9, 10], [0, 0], [20000, 10000], v)
    for begin, n in [(0, 30000), (0, 1), (29999, 1), (4999, 2), (8990, 40)] + [(r.randrange(29000), r.randrange(1, 900)) for _ in range(60)]:
        assert (S.read_from(data, begin, n) == v[begin : begin + n]).all(), (begin, n)


def test_repeated_rows_and_clashing_columns(spark):
    docs = X.docs(spark, ["a b", "c"]).withColumn("shard", F.lit("x"))
    got = S.token_table(docs.unionByName(docs), P.path("word_bpe_49k.json")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [0, 0, 1, 1] and got[0]["ids_crc32"] == got[1]["ids_crc32"]


def test_words_of_the_cache_before_are_not_encoded_again(monkeypatch):
    encoder, learned = S.Encoder(P.path("word_bpe_49k.json")), []
    monkeypatch.setattr(encoder, "CACHE", 10)
    learn = encoder.learn
    monkeypatch.setattr(encoder, "learn", lambda words: (learned.extend(words), learn(words)))
    texts = [f"common words {' '.join('abcdefg'[k] * n for n in range(2, 8))}" for k in range(5)]
    for t in texts:
        assert encoder.encode([t]) == [encoder.whole(t)]
    assert learned.count("common") == learned.count("words") == 1 and len(encoder.cache) <= 10
