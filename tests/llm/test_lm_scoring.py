import math
import zlib
from collections import Counter

import numpy as np
import pytest

from skein.llm import lm_scoring as op


def tokens(t):
    return [w for w in (t or "").encode().lower().split()]


def marginal(word, pieces, logp):
    """log of the summed probability of every segmentation of a marked word."""
    w = "▁".encode() + word
    total = [1.0] + [0.0] * len(w)
    weight = {}
    for p, x in zip(pieces, logp, strict=True):
        if p:
            weight[p] = weight.get(p, 0.0) + math.exp(x)
    for end in range(1, len(w) + 1):
        total[end] = sum(total[start] * weight.get(w[start:end], 0.0) for start in range(max(0, end - 60), end))
    return math.log(total[-1])


def test_words_and_hashes():
    texts = [b"", b"  One\ttwo\x0bTHREE ", b"x", b"\xc3\x89t\xc3\xa9 \xc2\xa0a", b" "]
    data, lengths, per = op.words_of(texts)
    assert list(per) == [len(t.split()) for t in texts]
    cuts = np.cumsum([0, *lengths])
    words = [data[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
    assert words == [w for t in texts for w in t.lower().split()]
    data, lengths, _ = op.words_of([b"ab abc ab bc \0 \0\0 ab"])
    h = op.hashes(data, lengths)
    assert h[0] == h[2] == h[-1] and len(set(h.tolist())) == 5


@pytest.fixture(scope="module")
def lattice():
    pieces, logp, end = op.vocabulary()
    return op.Lattice(pieces, logp), pieces, logp, end


def test_marginals(lattice):
    lat, pieces, logp, _ = lattice
    words = [b"the", b"anblewhs", "étreñ".encode(), b"", b"\x00\xff", "日本語".encode(), b"a" * 70, b"the"]
    got = lat.word_logps(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words]))
    assert np.allclose(got, [marginal(w, pieces, logp) for w in words])


def test_expected_uses_are_derivatives(lattice):
    lat, pieces, logp, _ = lattice
    words, times = [b"there", b"onandon", "é".encode()], np.array([3, 2, 1])
    data, lengths = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    uses = lat.expected(data, lengths, times)
    whole = lambda x: sum(n * marginal(w, pieces, x) for n, w in zip(times, words, strict=True))
    for k in [*np.flatnonzero(uses > 0.01)[:6], pieces.index(b"\xc3")]:
        up, down = logp.copy(), logp.copy()
        up[k] += 1e-4
        down[k] -= 1e-4
        assert abs((whole(up) - whole(down)) / 2e-4 - uses[k]) < 1e-3


def test_against_one_word_at_a_time(spark, words):
    rows = [(k, " ".join(words(30 + k, 5 * (k % 7)))) for k in range(60)] + [(900, None), (901, ""), (902, "Zzyzx zzyzx é"), (903, "a " * 500)]
    lang = {i: ("en", "fr", None, "en")[i % 4] for i, _ in rows}
    table = spark.createDataFrame([(i, t, lang[i], 1) for i, t in rows], "doc_id long, text string, lang string, size int")
    out = {r["doc_id"]: r for r in op.score(table, rounds=1).collect()}
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 10]

    def counts(docs):
        c = Counter(w for _, t in docs for w in tokens(t))
        once, twice = (sum(x == n for x in c.values()) for n in (1, 2))
        c["end"] = len(docs)
        return c, sum(c.values()), len(c), min(max(once / (once + 2 * twice), 0.1), 0.9)

    every = counts(train)
    classes = {k: [r for r in train if lang[r[0]] == k] for k in ("en", "fr", None)}
    count, n, v, _ = every
    # one round of expectation maximisation over the types
    pieces, logp, end = op.vocabulary()
    lat = op.Lattice(pieces, logp)
    types = [w for w in count if w != "end"]
    uses = np.where([bool(p) for p in pieces], 1e-2, 0.0) + lat.expected(np.frombuffer(b"".join(types), np.uint8), np.array([len(w) for w in types]), np.ones(len(types)))
    uses[end] = len(train) + 1e-2
    with np.errstate(divide="ignore"):
        logp = np.log(uses / uses.sum())
    starts = sum(math.exp(x) for p, x in zip(pieces, logp, strict=True) if p.startswith(b"\xe2"))
    last = math.exp(logp[end]) / (math.exp(logp[end]) + starts)
    spelled = {w: math.exp(marginal(w, pieces, logp)) for _, t in rows for w in tokens(t)} | {"end": last}
    share = lambda stats, w, rest: (max(stats[0][w] - stats[3], 0) + stats[3] * stats[2] * rest) / stats[1]
    for i, t in rows:
        r, ws = out[i], tokens(t)
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*ws, "end"])
        joint = []
        for docs in classes.values():
            stats = counts(docs)
            prob = lambda w: share(stats, w, op.SHARE * spelled[w] + (1 - op.SHARE) * share(every, w, spelled[w]))  # noqa: E731, B023
            stop, seen, score = prob("end"), Counter(), math.log10(len(docs) / len(train))
            for k, w in enumerate(ws):
                score += math.log10((1 - stop) * (seen[w] + op.PRIOR * prob(w) / (1 - stop)) / (k + op.PRIOR))
                seen[w] += 1
            joint.append(score + math.log10(stop))
        score = max(joint) + math.log10(sum(10 ** (x - max(joint)) for x in joint))
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws) + 1, sum(count[w] > 0 for w in [*ws, "end"]), n)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and abs(r["score"] - score) < 1e-6 * max(1, abs(score)), i
        alone = sum(math.log10(spelled[w]) for w in [*ws, "end"])
        assert abs(r["lattice_score"] - alone) < 1e-6 * max(1, abs(alone)), i


def test_held_out_documents_score_above_the_base(spark):
    out = op.score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000")).where("held_out").toPandas()
    assert out["score"].sum() > out["base_score"].sum()


def test_many_chunks_and_buckets_agree(spark, documents, words, monkeypatch):
    rows = [(k, " ".join(words(40, k % 9))) for k in range(40)]
    want = sorted(map(tuple, op.score(documents(rows), rounds=1).collect()))
    monkeypatch.setattr(op, "CHUNK_BYTES", 300)
    got = sorted(map(tuple, op.score(documents(rows).repartition(3), rounds=1).collect()))
    assert [x[:5] for x in got] == [x[:5] for x in want] and np.allclose([x[5:] for x in got], [x[5:] for x in want])


def test_nulls_and_empty(documents):
    assert op.score(documents([(1, "a")]).limit(0), rounds=1).count() == 0
    out = op.score(documents([(None, "a b"), (None, "a b")]), rounds=1).collect()  # crc32 of the empty text is 0: held out
    assert [(r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in out] == [(True, 3, 0, 0)] * 2
    assert all(abs(r["base_score"]) < 1e-9 and r["score"] < 0 for r in out)


def test_lgamma():
    x = np.array([1e-9, 1e-3, 0.5, 1.0, 2.5, 500.0, 1e6])
    assert np.allclose(op.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-12)
