import pytest
from pyspark.sql import functions as F

from skein.operators import budget, evidence


def pages(body, size=256, prefix="a  title", point="page "):
    """Number of pages and their texts by trying one number after another."""
    head = " ".join(prefix.split())
    limit = min(1000, size // 4)
    head = head if len(head) <= limit else head[: limit - len(budget.SHORTENED)] + budget.SHORTENED
    total = 1
    for _ in range(32):
        worst = f"_Idea part {total}/{total}; next: {point}{total}._"
        room = size - len(head) - 4 - len("-- idea-body chars=0000000000 --\n") - len("\n-- end idea-body --") - len(worst)
        if (n := max(1, -(-len(body) // room))) == total:
            break
        total = n
    out = []
    for k in range(total):
        piece = body[k * room : (k + 1) * room]
        tail = f"next: {point}{k + 2}" if k + 1 < total else "complete"
        out.append(f"{head}\n\n-- idea-body chars={len(piece):010d} --\n{piece}\n-- end idea-body --\n\n_Idea part {k + 1}/{total}; {tail}._")
    return out


def test_pages_fit_and_hold_all(spark):
    bodies = ["", "x", "é" * 99, "y" * 5_000, "z" * 20_000, "\n" * 1_300, None]
    rows = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    for prefix, point in (("a  title", "page "), ("p" * 300, "a rather long way to ask for ")):
        got = budget.pages(rows, ["id"], F.lit(prefix), "body", "idea", 256, lambda p, w=point: F.concat(F.lit(w), p.cast("string"))).collect()
        assert all(len(r["text"]) <= 256 for r in got)
        for k, body in enumerate(bodies):
            mine = sorted((r for r in got if r["id"] == k), key=lambda r: r["part"])
            assert [r["text"] for r in mine] == pages(body or "", prefix=prefix, point=point) and "".join(r["body_part"] for r in mine) == (body or "")
    with pytest.raises(ValueError):
        budget.pages(rows, ["id"], F.lit(""), "body", "idea", 255, lambda p: p)
    with pytest.raises(Exception, match="pointer exceeds"):
        budget.pages(rows, ["id"], F.lit(""), "body", "idea", 256, lambda p: F.repeat(F.lit("w"), 300)).collect()


def test_headlines_end_at_the_first_that_does_not_fit(spark):
    rows = [("few", k, "b" * 10, f"h{k}") for k in range(3)] + [("many", k, "b" * 100, "h" * (90 if k == 4 else 20)) for k in range(40)] + [("none", 1, "b" * 900, "h" * 300)]
    df = spark.createDataFrame(rows, "g string, k int, body string, line string")
    got = {r["g"]: r for r in budget.headlines_shown(df, ["g"], [F.col("k")], "body", "line", F.lit("H"), "row", "ask", 250).collect()}
    assert got["few"]["text"] == "\n".join(["b" * 10] * 3) and got["few"]["shown"] == 3
    pointer = lambda n, total, chars: f"_{n}/{total} row headline{'s' * (total > 1)} shown; complete render {chars} chars. To read omitted headlines or bodies, ask._"
    assert got["many"]["text"] == "H\n" + "\n".join(["h" * 20] * 4) + "\n\n" + pointer(4, 40, 40 * 101 - 1) and got["many"]["shown"] == 4
    assert got["none"]["text"] == "H\n\n" + pointer(0, 1, 900)
    with pytest.raises(Exception, match="pointer exceeds"):
        budget.headlines_shown(df, ["g"], [F.col("k")], "body", "line", F.lit("H"), "row", "ask", 60).collect()


def test_notices_are_shortened(spark):
    df = spark.createDataFrame([("a \n b",), ("x" * 600,)], "t string")
    got = [r[0] for r in df.select(budget.compact_nudge(F.col("t"))).collect()]
    assert got[0] == "a b" and len(got[1]) == 510 and got[1].endswith(budget.NUDGE_SHORTENED)


def test_a_rewrite_is_refused_as_a_whole(spark):
    commits = spark.createDataFrame([(1, "a" * 40), (2, "b" * 40), (3, "aaaaaaa" + "c" * 33)], "id int, commit_hash string")
    none = spark.createDataFrame([], "old_hash string, commit_id int")
    finding = lambda v: spark.createDataFrame([(7, "base_sha", v)], "id int, field string, value string")
    moves = lambda *m: spark.createDataFrame(list(m), "old_hash string, new_hash string")
    both = moves(("a" * 40, "d" * 40), ("aaaaaaa" + "c" * 33, None))
    with pytest.raises(ValueError, match="ambiguous"):
        evidence.remap_history(commits, both, finding("AAAAAAA"), none)
    with pytest.raises(ValueError, match="collision"):
        evidence.remap_history(commits, moves(("a" * 40, "b" * 40)), finding("x"), none)
    with pytest.raises(ValueError, match="collision"):  # the old hash is known from a former rewrite only
        evidence.remap_history(commits, moves(("e" * 40, "b" * 40)), finding("x"), spark.createDataFrame([("e" * 40, 1)], "old_hash string, commit_id int"))
    c, f, p = evidence.remap_history(commits, both, finding("aaaaaaaa"), none)
    assert {(r["id"], r["commit_hash"]) for r in c.collect()} == {(1, "d" * 40), (2, "b" * 40), (3, "aaaaaaa" + "c" * 33)}
    assert f.collect()[0]["value"] == "d" * 40 and {tuple(r) for r in p.collect()} == {("a" * 40, 1, "d" * 40), ("aaaaaaa" + "c" * 33, 3, None)}
    with pytest.raises(ValueError, match="fewer than 7"):
        evidence.prefix_matches(spark.createDataFrame([("abc",)], "a string"), "a", commits, "commit_hash")
