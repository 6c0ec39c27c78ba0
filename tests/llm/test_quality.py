import math
from collections import Counter

import numpy as np
import pytest

from skein.llm import quality


def plain_model(texts, order):
    """Interpolated modified Kneser-Ney, one n-gram at a time: a function from text to log probability."""
    grams = {order: Counter()}
    for t in texts:
        t = bytes(order - 1) + t
        grams[order].update(t[i : i + order] for i in range(len(t) - order + 1))
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    levels = {}
    for k, c in grams.items():
        n = [max(1, sum(v == x for v in c.values())) for x in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        d = [min(max(x, 0.1), i - 0.05) for i, x in ((1, 1 - 2 * y * n[1] / n[0]), (2, 2 - 3 * y * n[2] / n[1]), (3, 3 - 4 * y * n[3] / n[2]))]
        total, left = Counter(), Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            left[g[:-1]] += d[min(v, 3) - 1]
        levels[k] = c, d, total, left

    def p(g):
        if not g:
            return 1 / 257
        c, d, total, left = levels[len(g)]
        if not total[g[:-1]]:
            return p(g[1:])
        v = c[g]
        return ((v - d[min(v, 3) - 1]) if v else 0) / total[g[:-1]] + left[g[:-1]] / total[g[:-1]] * p(g[1:])

    def logp(t):
        t = bytes(order - 1) + t
        return sum(math.log(p(t[i : i + order])) for i in range(len(t) - order + 1))

    return logp, p


@pytest.fixture(scope="module")
def tables(spark):
    texts = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog é", "", "on and on and on"] * 3 + ["xyz the end"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(len(texts))], "doc_id long, quality int, toxic int")
    held, quality.HELD_OUT = quality.HELD_OUT, 10**12  # none of these few is held out
    fitted = quality.fit(docs, labels, 4)
    quality.HELD_OUT = held
    return [t.encode() for t in texts], fitted


def test_against_plain_kneser_ney(tables):
    texts, fitted = tables
    logp, p = plain_model(texts, 4)
    s = quality.Scorer.opened(fitted, 4)
    new = [b"the cat sat", b"", b"zebra \xc3\xa9\x00\xff", b"t", b"dog dog dog on the mat and on" * 5]
    sums, sizes = s.score(new)
    assert list(sizes) == [len(t) for t in new]
    assert np.allclose(sums, [logp(t) for t in new])
    pieces, _ = s.score(new, slice_bytes=7)
    assert np.allclose(sums, pieces)
    for context in (b"\0\0\0", b"the", b"qqq", b" on"):
        assert abs(sum(p(context + bytes([x])) for x in range(256)) - 1) < 0.02


def test_all_trusted_texts_count_whole(spark, monkeypatch):
    # more rows than a sample would take, and one text longer than what is counted at once
    monkeypatch.setattr(quality, "TRUSTED_BYTES", 1_000)
    monkeypatch.setattr(quality, "HELD_OUT", 10**12)
    texts = ["ab" * 60_000 + "q"] + [f"the {k}" for k in range(3_500)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(len(texts))], "doc_id long, quality int, toxic int")
    grams = Counter(t[i : i + 4] for t in (bytes(3) + x.encode() for x in texts) for i in range(len(t) - 3))
    got = {r["key"]: r["c"] for r in quality.counts(quality._learnt(docs, labels), 4).collect()}
    assert got == {int.from_bytes(g, "big"): n for g, n in grams.items()}


def test_few_texts_but_the_trusted_move(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"text {n % 7}") for n, k in enumerate((*range(-50, 4_000), *range(100), *range(50), None, None))], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(-50, 4_000, 10)], "doc_id long, quality int, toxic int")
    ids = quality.trusted(labels)
    for bits, most in ((1 << 25, 5), (1 << 10, 2_000), (1, 5_000)):
        monkeypatch.setattr(quality, "BITS", bits)
        got = Counter(r["doc_id"] for r in quality._likely(docs, ids).collect())
        assert all(got[k] == 1 + (0 <= k < 100) + (0 <= k < 50) for k in range(-50, 4_000, 10)) and sum(got.values()) - 405 - 15 <= most
        learnt = Counter(bytes(r["text"]).decode() for r in quality._learnt(docs, labels).collect())
        assert learnt == Counter(r["text"] for r in docs.where(~quality._held_out()).join(ids, "doc_id").distinct().collect())


def test_table_lookup():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(-(2**60), 2**60, 5000))
    t = quality.Table(keys, keys.astype(float))
    assert (t.find(keys) == np.arange(len(keys))).all() and (t.find(keys + 1)[~np.isin(keys + 1, keys)] == -1).all()
    assert (quality.Table(np.zeros(0, np.int64), np.zeros(0)).find(keys) == -1).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    # the model is fitted on even ids; odd ids are held out
    seen = labels.where("doc_id % 2 = 0")
    out = quality.judge(docs, seen).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    good = out[(out.quality == 1) & (out.toxic == 0)]
    bad = out[out.quality == 0]
    assert good.keep.mean() > 0.98 and bad.keep.mean() < 0.15 and len(bad) > 10


def test_toxic_documents_are_bad_too(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.judge(docs, labels).join(labels, "doc_id").withColumn("held", quality._held_out()).toPandas()
    clean = out[(out.quality == 1) & (out.toxic == 0) & out.held]
    toxic, bad = out[(out.quality == 1) & (out.toxic == 1)], out[out.quality == 0]
    print("kept: clean", clean.keep.mean(), len(clean), "toxic", toxic.keep.mean(), len(toxic), "quality 0", bad.keep.mean(), len(bad))
    assert clean.keep.mean() >= 0.98 and toxic.keep.mean() < 0.8 and bad.keep.mean() < 0.05


def test_limits_take_all_held_out_documents(spark, words, monkeypatch):
    # English is nearly all; every language's limit comes from all its held-out documents, long ones too, or from those of all if they are few
    size = {"en": 300, "de": 120, "fr": 24}
    rows = [(k, lang, " ".join(words(9_000 if k % 40 == 0 else 20 + k % 60) + ["é"] * (3 * k % 50))) for k, lang in enumerate(x for x, n in size.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(k, 1, 0) for k, _, _ in rows], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(quality, "LIMIT_DOCS", 10, raising=False)
    monkeypatch.setattr(quality, "TRUSTED_BYTES", 30_000)
    out = quality.scored(docs, labels).withColumn("held", quality._held_out()).toPandas()
    held = out[out.held]

    def limit(x):
        # the quantile sketch takes values that occur: the least at or above the share
        x = np.sort(x.to_numpy())
        middle, upper = (x[math.ceil(q * len(x)) - 1] for q in (0.5, quality.UPPER))
        return middle + quality.REACH * (upper - middle)

    assert (held.text.str.len() > 30_000).any() and 0 < (held.lang == "fr").sum() < quality.LEAST_KNOWN <= (held.lang == "de").sum()
    for lang, want in (("en", limit(held[held.lang == "en"].log_perplexity)), ("de", limit(held[held.lang == "de"].log_perplexity)), ("fr", limit(held.log_perplexity))):
        assert np.allclose(out[out.lang == lang].limit, want), lang


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, None, "en", 1), (2, "", None, 1), (None, "abc", "xx", 1), (None, "abc", "xx", 1), (3, "abc abd", "en", 1)], "doc_id long, text string, lang string, keep int")
    labels = spark.createDataFrame([(3, 1, None), (None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.judge(docs, labels).collect()
    assert len(out) == 5 and all(r["keep"] for r in out if not r["n_bytes"]) and sum(r["perplexity"] is None for r in out) == 2
    assert quality.judge(docs.limit(0), labels).count() == 0
    assert all(r["keep"] for r in quality.judge(docs, labels.limit(0)).collect())
