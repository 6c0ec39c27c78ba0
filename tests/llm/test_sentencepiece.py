import numpy as np
import pytest
import sentencepiece

from skein.llm import sentencepiece as coding

TEXTS = ["", " hello  world\n\tx  ", "a", "   ", "日本語 テキスト😀 é\r\n\r\n  x", "\x00\x01 z z z", "a" * 60 + "       b", "<s> </s> <0x0A>", "Don't  stop-me,now... 12345 6.7"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=coding.MODEL)


def ids(encoder, texts):
    return [np.frombuffer(x, np.int32).tolist() for x in encoder.encode(texts)]


def test_ids_are_those_of_the_library(library, words):
    e = coding.Encoder(coding.load())
    texts = TEXTS + [" ".join(words(300, k)) for k in range(20)] + [" ".join(words(40_000, 99))]
    assert ids(e, texts) == library.encode(texts)
    assert [e.decode(x) for x in ids(e, texts)] == texts


def test_documents_of_the_smallest_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = {r["doc_id"]: r for r in coding.round_trip(docs).collect()}
    for r in docs.collect():
        assert list(out[r["doc_id"]]["ids"]) == library.encode(r["text"]) and out[r["doc_id"]]["exact"]


def test_cache_bound_does_not_change_results(monkeypatch, words):
    texts = [" ".join(words(200, k)) for k in range(10)]
    whole = coding.Encoder(coding.load()).encode(texts)
    monkeypatch.setattr(coding, "CACHE_WORDS", 5)
    e = coding.Encoder(coding.load())
    assert [e.encode([t])[0] for t in texts] == whole


def test_unigram_models_take_the_best_sum():
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    for piece, score, kind in [("<unk>", 0.0, 2), ("▁ab", -3.0, 1), ("▁a", -1.0, 1), ("b", -1.5, 1), ("bc", -1.2, 1), ("c", -2.5, 1), ("▁", -2.0, 1), ("a", -2.0, 1)]:
        m.pieces.add(piece=piece, score=score, type=kind)
    m.trainer_spec.model_type = 1
    m.normalizer_spec.name = "identity"
    m.normalizer_spec.add_dummy_prefix = True
    m.normalizer_spec.remove_extra_whitespaces = False
    m.normalizer_spec.escape_whitespaces = True
    e = coding.Encoder(m.SerializeToString())
    lib = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    texts = ["abc", "ab", "abc ab", "bcb a", "aabbcc"]
    assert ids(e, texts) == lib.encode(texts)


def test_nulls_empty_and_mark(documents):
    docs = documents([(1, None), (2, ""), (None, "x"), (None, "x"), (3, "▁a")])
    out = coding.round_trip(docs).collect()
    assert sorted((r["n_tokens"], r["exact"]) for r in out) == [(0, True), (0, True), (1, True), (1, True), (2, False)]
    assert coding.round_trip(docs.limit(0)).count() == 0
    back = {r["doc_id"]: r["text"] for r in coding.decode(coding.encode(documents([(1, "a  b"), (2, None)]))).collect()}
    assert back == {1: "a  b", 2: ""}
