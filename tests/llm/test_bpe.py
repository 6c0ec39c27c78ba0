import hashlib
import random
import sys
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skein.llm import bpe

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def own():
    return bpe.encoder(bpe.load())


def ids_of(own, text):
    (raw,) = own.encode([text])
    return [int.from_bytes(raw[i : i + 4], sys.byteorder) for i in range(0, len(raw), 4)]


ODD = ["", " ", "  ", "\n", "\n\n  x", "it's 'S ''s'll we'd've", "a  b\t\tc \r\n d ", "<|endoftext|>", "x<|endoftext|><|endoftext|> y <|endoftext", "１２三  　z\x1c\x1d\x85q", "é‍👩‍👩‍👧 \U0001f1e9\U0001f1ea", "1st 2nd3rd 0x1F", "�\x00\x7f", "ǅ ⅷ ² ำ"]


def test_odd_texts(library, own):
    for t in ODD:
        assert ids_of(own, t) == library.encode(t, add_special_tokens=False).ids
        assert own.decode(ids_of(own, t)) == library.decode(ids_of(own, t), skip_special_tokens=False) == t


def test_random_texts(library, own):
    rng = random.Random(3)
    alphabets = ["ab \n", "aäö ' st", " \t\n　x", "0123 .,'sd", "".join(map(chr, range(32, 127))), "дждз привет ", "漢字かな交じり文 "]
    for k in range(3000):
        t = "".join(rng.choice(alphabets[k % 7]) for _ in range(rng.randrange(60)))
        assert ids_of(own, t) == library.encode(t, add_special_tokens=False).ids
    for _ in range(1000):
        t = "".join(chr(rng.choice((rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)))) + rng.choice(("", " ", "a", "1")) for _ in range(rng.randrange(20)))
        assert ids_of(own, t) == library.encode(t, add_special_tokens=False).ids


def test_every_character_falls_into_the_library_s_class(library, own):
    split = library.pre_tokenizer.pre_tokenize_str
    for c in (chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000):
        if unicodedata.category(c) == "Cn":  # those are split by the library itself
            continue
        text = f"a{c}1{c}!{c} {c}  b"
        assert [text[x:y] for _, (x, y) in split(text)] == own.v.pattern(text)


def cut(v, piece):
    at = [0, *v.cuts(np.frombuffer(piece, np.uint8)).tolist(), len(piece)]
    return [piece[a:b] for a, b in zip(at, at[1:], strict=False)]


def test_fragments_of_any_size_merge_alike(own, monkeypatch):
    rng = random.Random(12)
    pieces = ["".join(rng.choice("etaoinshrdlu ") for _ in range(rng.randrange(1, 60))) for _ in range(500)] + ["a" * n for n in range(1, 60)]
    together = own.v.encoded(pieces)
    monkeypatch.setattr(bpe, "SHORT", 0)
    assert together == own.v.encoded(pieces)


def test_merges_never_cross_a_certain_cut(own):
    v = own.v
    assert all(len(cut(v, t)) == 1 for k, t in enumerate(v.table) if k not in v.special.values())
    assert cut(v, b"ab1") == [b"ab", b"1"] and b"".join(cut(v, bytes(range(256)))) == bytes(range(256))
    rng = random.Random(5)
    for _ in range(500):
        piece = bytes(rng.randrange(256) if rng.random() < 0.5 else rng.choice(b"theins") for _ in range(rng.randrange(1, 30)))
        assert [k for f in cut(v, piece) for k in v.merged(f)] == v.merged(piece)


def test_decodes_any_ids_as_the_library_does(library, own):
    rng = random.Random(6)
    for _ in range(2000):
        ids = [rng.choice((rng.randrange(256), rng.randrange(50257))) for _ in range(rng.randrange(12))]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_nothing_depends_on_what_is_kept(library, words, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 5)
    monkeypatch.setattr(bpe, "LONGEST", 6)
    small = bpe.Encoder(open(FILE, encoding="utf-8").read())
    text = " ".join(words(400)) + "\n" + "antidisestablishment" * 3
    for _ in range(2):
        assert ids_of(small, text) == library.encode(text, add_special_tokens=False).ids
    assert small.older and all(len(x) <= 6 for x in small.known if x not in small.special)


def test_texts_in_groups(library, own, words, monkeypatch):
    texts = [" ".join(words(k * 7)) + ("<|endoftext|>" if k % 3 else "") for k in range(40)] + [None, "", "x" * 500]
    monkeypatch.setattr(bpe, "GROUP", 300)
    assert [np.frombuffer(x, np.int32).tolist() for x in own.encode(texts)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_a_long_text_without_cuts(library, own):
    rng = random.Random(9)
    text = "".join(rng.choice("etaoinshr") for _ in range(200_000))
    assert ids_of(own, text) == library.encode(text, add_special_tokens=False).ids


def test_tables(spark, documents, library, words):
    rows = [(1, None), (2, ""), (3, " ".join(words(3000)) + ODD[8]), (3, " ".join(words(30))), (None, "x y"), (4, "same"), (4, "same")]
    docs = documents(rows)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for k, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((k, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe.round_trip(docs).collect()), key=repr) == sorted(want, key=repr)
    encoded = bpe.encode(docs)
    assert sorted(((r["doc_id"], r["text"]) for r in bpe.decode(encoded).collect()), key=repr) == sorted(((k, t or "") for k, t in rows), key=repr)
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).collect()[0]["text"] is None
    assert bpe.round_trip(documents([])).count() == bpe.encode(documents([])).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
