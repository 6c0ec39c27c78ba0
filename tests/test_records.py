from datetime import datetime, timedelta

import pytest

from skein.operators import records
from skein.sources import extractors

T = datetime(2024, 1, 1)


def test_superseded(spark):
    rows = spark.createDataFrame([(1, None, None), (2, None, None), (3, 9, None)], "id int, superseded_by int, retired_at timestamp_ntz")
    out = {r["id"]: (r["superseded_by"], r["retired_at"]) for r in records.superseded(rows, spark.createDataFrame([(1, 5), (2, None)], "id int, successor int"), "2024-01-01 00:00:00").collect()}
    assert out == {1: (5, None), 2: (None, T), 3: (9, None)}


def test_checklist(spark):
    docs = spark.createDataFrame([("p", "# x\n- [ ] one\n  * [X] Two \n- no\n- [y] z")], "slug string, text string")
    assert [(r["place"], r["done"], r["task"]) for r in records.checklist(docs).orderBy("place").collect()] == [(1, False, "one"), (2, True, "Two")]


def test_moves_need_evidence(spark):
    ideas = spark.createDataFrame([(1, "low"), (2, "low"), (3, "low")], "id int, band string")
    moves = spark.createDataFrame([(1, "high", "agent", " "), (2, "high", "agent", "seen"), (3, "high", "operator", None)], "id int, band string, by string, evidence string")
    assert {r["id"]: r["band"] for r in records.moved(ideas, moves).collect()} == {1: "low", 2: "high", 3: "high"}


def test_cursors(spark):
    df = spark.range(20)
    page, _ = records.page_after(df, "s", ["id"], None, 5)
    assert [r[0] for r in page.collect()] == [0, 1, 2, 3, 4]
    page, _ = records.page_after(df, "s", ["id"], records.cursor("s", [4]), 5)
    assert [r[0] for r in page.collect()] == [5, 6, 7, 8, 9]
    for bad in ("x", records.cursor("other", [4]), records.cursor("s", [4, 5])):
        with pytest.raises(ValueError):
            records.page_after(df, "s", ["id"], bad, 5)


def test_trace(spark):
    decisions = spark.createDataFrame([("d", "p", T + timedelta(hours=1), ["src/a.ts"])], "id string, project string, at timestamp_ntz, paths array<string>")
    sessions = spark.createDataFrame([("s1", "p", T, None), ("s2", "p", T - timedelta(hours=1), None), ("s3", "q", T, None)], "session string, project string, started_at timestamp_ntz, ended_at timestamp_ntz")
    commits = spark.createDataFrame([("c1", "p", "d", T), ("c2", "q", "d", T), ("c3", "p", "d", T)], "commit string, project string, id string, committed_at timestamp_ntz")
    files = spark.createDataFrame([("c1", "a")], "commit string, path string")
    nodes = spark.createDataFrame([("n1", "repo/src/a.ts"), ("n2", "a.ts"), ("n3", "xa.ts")], "id string, file_path string")
    s, c, n = records.trace(decisions, sessions, commits, files, nodes)
    assert [tuple(r) for r in s.collect()] == [("d", "s1")] and [tuple(r) for r in c.collect()] == [("d", "c1")] and {r["node"] for r in n.collect()} == {"n1", "n2"}


def test_lesson_page_and_cue(spark):
    a = spark.createDataFrame([(k, "n", k != 1, 10 - k) for k in range(5)], "id int, node string, active boolean, attached_at int")
    assert [r["id"] for r in records.lesson_page(a, "n", 2, 1).collect()] == [3, 2]
    assert records.bounded_cue("a b c d", lambda t: len(t.split()), 2) == "a b "


@pytest.mark.parametrize(
    "name,path,text,want",
    [
        ("script", "a.ts", "import x from './y'\nexport class A extends B {}\nexport const f = async (q) => 1\napp.get('/u/:id', h)\nbus.emit('e')", {("imports", "./y"), ("inherits", "B"), ("defines", "a.ts::A"), ("defines", "a.ts::f"), ("exports", "a.ts::A"), ("exports", "a.ts::f"), ("serves_route", "/u/:id"), ("emits", "e")}),
        ("go", "m.go", 'import "fmt"\ntype T struct {}\nfunc (t T) Run() {}', {("imports", "fmt"), ("defines", "m.go::T"), ("defines", "m.go::Run")}),
        ("rust", "l.rs", "use a::b;\npub struct S;\nimpl Tr for S {}\npub async fn go() {}", {("imports", "a::b"), ("defines", "l.rs::S"), ("inherits", "Tr"), ("defines", "l.rs::go")}),
        ("java", "A.java", "import x.Y;\npublic class A extends B {\n  public static void main(String[] a) {}\n}", {("imports", "x.Y"), ("defines", "A.java::A"), ("inherits", "B"), ("defines", "A.java::main")}),
        ("cpp", "a.cpp", '#include "b.h"\nclass A : public B {\n};\nint A::run(int x) {\n  if (x) {\n  }\n}', {("imports", "b.h"), ("defines", "a.cpp::A"), ("inherits", "B"), ("defines", "a.cpp::A::run")}),
        ("php", "p.php", "use A\\B;\nclass C extends D {\n public function f() { do_action('saved'); }\n}\nadd_action('init', 'g');", {("imports", "A\\B"), ("defines", "p.php::C"), ("inherits", "D"), ("defines", "p.php::f"), ("emits", "saved"), ("listens_on", "init")}),
    ],
)
def test_patterns(name, path, text, want):
    found = extractors.EXTRACTORS[name][1](path, text)
    assert {(r, t) for what, _, _, r, t, _ in found if what == "edge"} == want


def test_most_similar_compares_texts_once(spark):
    """3,000 rows of one text and 3,000 new ones are no nine million candidates; the best come by score and key."""
    from pyspark.sql import functions as F

    from skein.operators import retrieval

    new = spark.range(3_000).select(F.col("id").alias("new_id"), F.when(F.col("id") < 2_999, "red bolt steel").otherwise("blue anvil").alias("_rule"))
    rows = spark.range(3_000).select("id", F.when(F.col("id") % 1_000 == 7, "red bolt steel").when(F.col("id") % 3 == 0, "red bolts steel").when(F.col("id") == 8, None).otherwise("nothing at all").alias("rule"))
    near = retrieval.most_similar(new, rows, 0.5, 5)
    got = near.groupBy("new_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("l")).select("l").distinct().collect()
    assert [[tuple(x) for x in r["l"]] for r in got] == [[(1, 7), (2, 1_007), (3, 2_007), (4, 0), (5, 3)]]
    assert near.select("new_id").distinct().count() == 2_999
    assert retrieval.similar_pairs(spark.createDataFrame([], "new_id long, _rule string"), rows, 0.5).count() == 0
