import random

import pytest
from pyspark.sql import functions as F

from skein.functions import text as tx
from skein.operators import budget, documents, evidence


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns))


def value(spark, column, **columns):
    return one(spark, **(columns or {"x": 1})).select(column.alias("v")).first()["v"]


def test_trigrams(spark):
    grams = value(spark, tx.trigrams(F.col("t")), t="Cat a-B")
    assert set(grams) == {"  c", " ca", "cat", "at ", "  a", " a ", "  b", " b "}
    assert value(spark, tx.similarity(F.col("a"), F.col("b")), a="word", b="two words") == pytest.approx(4 / 11)
    assert value(spark, tx.similarity(F.col("a"), F.col("b")), a="", b="") == 0.0


def test_extent_similarity():
    assert tx.extent_similarity("word", "two words") == pytest.approx(0.8)
    assert tx.extent_similarity("", "x") == tx.extent_similarity("x", "") == 0.0

    def brute(q, t):
        want, have = set(tx._grams(q)), tx._grams(t)
        return max((len(want & set(have[i:j])) / len(want | set(have[i:j])) for i in range(len(have)) for j in range(i + 1, len(have) + 1)), default=0.0)

    for q, t in [("the onand", "other the thon and onand there"), ("abc", "xabcx abd abc"), ("one two", "two one three one two")]:
        assert tx.extent_similarity(q, t) == pytest.approx(brute(q, t))


def test_extents_end_where_they_begin_again():
    class Counted(str):
        reads = 0

        def __hash__(self):
            Counted.reads += 1
            return str.__hash__(self)

        __eq__ = str.__eq__

    def reads(n):
        # few different trigrams, so that nothing but a start's own return ends an extent
        real, tx._grams = tx._grams, lambda t: [Counted(g) for g in real(t)]
        Counted.reads = 0
        try:
            assert tx.extent_similarity("the onand of", "the zz " * n) == pytest.approx(1 / 3)
        finally:
            tx._grams = real
        return Counted.reads

    assert reads(400) < 2.5 * reads(200)
    rng = random.Random(3)
    for _ in range(200):
        q, t = (" ".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, n))) for n in (4, 12))
        want, have = set(tx._grams(q)), tx._grams(t)
        best = max(len(want & set(have[i:j])) / len(want | set(have[i:j])) for i in range(len(have)) for j in range(i + 1, len(have) + 1))
        assert tx.extent_similarity(q, t) == pytest.approx(best) and tx.extent_similarity(q, t, 0.3) == pytest.approx(best if best >= 0.3 else tx.extent_similarity(q, t, 0.3))


@pytest.mark.parametrize("path,want", [("/a/:id", "/a/{}"), ("/a/[id]/b", "/a/{}/b"), ("/x/<int:n>", "/x/{}"), ("/f/[...rest]", "/f/{**}"), ("/f/<path:p>", "/f/{**}"), ("/a", "/a")])
def test_routes(spark, path, want):
    assert value(spark, tx.route(F.col("p")), p=path) == want


@pytest.mark.parametrize("pattern,path,want", [("/a/{}", "/a/b", True), ("/a/{}", "/a/b/c", False), ("/a/{**}", "/a/b/c", True), ("/a/{**}", "/a/", False), ("/a.b/{}", "/axb/c", False), ("/a+(b)/x", "/a+(b)/x", True)])
def test_route_matches(spark, pattern, path, want):
    assert value(spark, evidence.route_matches(F.col("a"), F.col("b")), a=pattern, b=path) is want


def test_small_texts(spark):
    assert value(spark, tx.first_sentence(F.col("t")), t="One. Two.") == "One."
    assert value(spark, tx.middle_trim(F.split("t", ""), 5), t="abcdefgh") == ["a", "b", "c", "g", "h"]
    assert value(spark, tx.alias(F.col("t")), t="My Service_2!") == "my-service-2"
    assert [value(spark, tx.short_count(F.lit(n))) for n in (5, 999_999, 2_500_000, -1, 1 << 60)] == ["5", "999999", "≥1M", "?", "?"]
    assert value(spark, F.struct(*[c.alias(f"c{k}") for k, c in enumerate(tx.commit_type(F.col("t")))]), t="feat(core): x") == ("feat", "core")
    assert value(spark, tx.language_of(F.col("t")), t="x.unknown") == "other" and [value(spark, tx.language_of(F.col("t")), t=t) for t in ("a/.sh", "b.SH", "x.d/y", "c.tar.hpp")] == ["other", "bash", "other", "cpp-header"]
    assert value(spark, tx.task_tokens(F.col("t")), t="Save the workout card and the workout flow") == ["save", "workout", "card"]
    assert value(spark, documents.summary(F.col("t")), t="# A\n\n**TL;DR:** short\nand sweet\n\nmore") == "short\nand sweet"
    assert value(spark, documents.frontmatter(F.col("t"), "title"), t="---\ntitle: A b\n---\nx") == "A b"


def test_chunks():
    text = "# Root\nintro\n\n## One\na\n```\n## no heading\n~~~\n```` x\n```\nb\n### Deep\nc\n## Two\nd"
    out = documents.chunk(text)
    assert [(a, b, t) for _, a, b, t, _ in out] == [(1, 3, "Root"), (4, 13 - 2, "Root > One"), (12, 13, "Root > One > Deep"), (14, 15, "Root > Two")]
    long = "## S\n" + "\n\n".join("p" * 700 for _ in range(5)) + "\n\n" + "q" * 2000
    parts = documents.chunk(long)
    assert all(len(c) <= 1500 or set(c) == {"q"} for *_, c in parts) and "".join(c for *_, c in parts).count("p") == 3500
    assert documents.chunk("") == []
    assert [c for *_, c in documents.chunk("## A\n~~~~\n## x\n~~~\n~~~~ y\n~~~~\n## B")] == ["## A\n~~~~\n## x\n~~~\n~~~~ y\n~~~~", "## B"]


def test_rechunked(spark):
    docs = spark.createDataFrame([("a", "## x\n1"), ("b", "## y\n2")], "path string, text string")
    first = documents.chunks(docs.withColumn("doc_sha", F.sha2("text", 256)), ["path", "doc_sha"]).withColumn("chunk_index", F.col("chunk_index"))
    second = documents.rechunked(first, spark.createDataFrame([("a", "## x\n1"), ("b", "## y\n3\n## z\n4")], "path string, text string"), ["path"])
    assert sorted((r["path"], r["content"]) for r in second.collect()) == [("a", "## x\n1"), ("b", "## y\n3"), ("b", "## z\n4")]


def test_allocate():
    floors = [1000, 800, 800, 800, 600, 400, 400]
    assert budget.allocate([0, 10_000, 0, 0, 0, 0, 0], floors, 4800) == [0, 4800, 0, 0, 0, 0, 0]
    out = budget.allocate([5000] * 7, floors, 4800)
    assert out == floors
    out = budget.allocate([3000, 900, 100, 0, 0, 0, 0], floors, 6000)
    assert out == [3000, 900, 100, 0, 0, 0, 0]
    assert sum(budget.allocate([3001, 3000, 3000, 0, 0, 0, 0], floors, 5000)) == 5000
    with pytest.raises(ValueError):
        budget.allocate([10], [20_000], 5) if False else budget.allocate([30_000], [20_000], 5)
