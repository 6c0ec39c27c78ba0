import hashlib
import random
import zlib

import duckdb
import pytest

from skein.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(level, at):
    """The top of a list of digests, and the siblings (left, right) of the node `at` on the way up."""
    path = []
    while len(level) > 1:
        a = at - at % 3
        path.append(("".join(level[a:at]), "".join(level[at + 1 : a + 3])))
        level, at = [h(*level[i : i + 3]) for i in range(0, len(level), 3)], at // 3
    return level[0], path


def brute(rows):
    """Rows (doc_id, source, lang, n_chars, text) -> sorted result rows, one tree climbed for each leaf."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    subroots = [climb([leaf(r) for r in by[s]], 0)[0] for s in order]
    out = []
    for k, s in enumerate(order):
        leaves = [leaf(r) for r in by[s]]
        root, over = climb(subroots, k)
        for i, r in enumerate(by[s]):
            path = climb(leaves, i)[1] + over
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            now = leaf((*r[:4], text))
            for a, b in path:
                now = h(a, now, b)
            out.append((r[0], leaves[i], subroots[k], root, h(*[a + b for a, b in path]), now, now == root))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, b"x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, hash binary")


def audited(spark, rows, step):
    got = merkle.audit(table(spark, rows), merkle.without_newlines(), step)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("step", [1, 2, merkle.STEP])
def test_against_climbing_each_leaf(spark, step):
    rng = random.Random(step)
    rows = [(k, rng.choice(("hot", "hot", "hot", "b", "ä", "z\n", "", None)), "en", k * 7, "".join(rng.choice("ab\nü") for _ in range(rng.randrange(9)))) for k in range(150)]
    rows += [(500 + k, f"alone {k}", None, None, None) for k in range(11)]
    rows += [rows[0], rows[0], (None, "b", "en", 1, "x\n"), (None, "b", "en", 1, "y\n"), (None, None, None, None, None), (-5, "b", "", 0, ""), (77, "b", "en", 3, "other\n" * 30_000)]
    rng.shuffle(rows)
    got = audited(spark, rows, step)
    assert got == brute(rows)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 4, 10])
def test_odd_sizes(spark, n):
    rows = [(k, None, "en", k, "a\nb") for k in range(n)]
    assert audited(spark, rows, 2) == brute(rows)


def test_proofs_fold_to_the_root_in_spark(spark):
    rows = [(k, f"s{k % 4}", "en", k, f"t {k}") for k in range(60)]
    manifest = merkle.build(table(spark, rows), step=2)
    found = merkle.proofs(manifest, step=2).withColumn("folded", merkle.folded("leaf", "path"))
    assert found.where(found.folded == manifest.root).count() == 60
    assert sorted(r["n_leaves"] for r in manifest.subroots().collect()) == [15] * 4


def test_every_level_is_in_the_store(spark):
    manifest = merkle.build(table(spark, [(k, "s", "en", k, "t") for k in range(30)]), step=2)
    assert sorted((r["level"], r["pos"]) for r in manifest.sources.nodes.collect()) == sorted((lv, p) for lv, n in ((1, 10), (2, 4), (3, 2), (4, 1)) for p in range(n))


def test_empty(spark):
    empty = table(spark, [])
    assert merkle.build(empty).root is None
    assert audited(spark, [], merkle.STEP) == [] and merkle.proofs(merkle.build(empty)).count() == 0


def test_sql_says_the_same(spark):
    con = duckdb.connect()
    folder = "/root/testdata/sf0.001/documents.parquet"
    con.sql(f"create view documents as from read_parquet('{folder}')")
    want = con.sql(merkle.SQL)
    rows = spark.read.parquet(folder)
    got = merkle.audit(rows, merkle.without_newlines())
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
