import random

from skein.llm import token_counts


def test_every_limit(spark):
    rng = random.Random(2)
    lengths = [rng.choice((0, 1, 5, rng.randrange(3000), rng.randrange(40))) for _ in range(2000)]
    df = spark.createDataFrame([(n, 1) for n in lengths] + [(None, 1)], "n_tokens long, block int")
    hist = token_counts.histogram(df)
    table = token_counts.limits(hist).cache()
    rows = {r["length"]: r for r in table.collect()}
    assert set(rows) == set(lengths)
    for n, r in rows.items():
        assert r["n_docs"] == lengths.count(n)
        assert r["docs_at_least"] == sum(x >= n for x in lengths)
        assert r["tokens_at_least"] == sum(x for x in lengths if x >= n)
        assert r["truncated_total"] == sum(min(x, n) for x in lengths)
        assert r["fits"] == sum(x <= n for x in lengths) and r["quantile"] == r["fits"] / 2000
        assert r["total_tokens"] == sum(lengths)
    for limit in (0, 3, 17, 999, 10_000):
        assert token_counts.truncated_total(table, limit) == sum(min(x, limit) for x in lengths)


def test_empty(spark):
    empty = spark.createDataFrame([], "n_tokens long")
    assert token_counts.limits(token_counts.histogram(empty)).count() == 0
