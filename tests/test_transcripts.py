import json
from datetime import datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.operators import segments
from skein.sources import extractors, files, git, transcripts
from skein.streaming import transcripts as streams

HOUR = 3600.0


def test_rules():
    f = segments.folded
    assert f([(0, False, 0), (23 * HOUR, False, 0)]) == [0, 0]
    assert f([(0, False, 0), (24 * HOUR, False, 0)]) == [0, 1]
    assert f([(None, True, 0), (None, True, 0), (None, False, 0)]) == [0, 1, 1]
    assert f([(None, False, 100), (None, False, 51), (None, False, 99), (None, False, 400), (None, False, 0)]) == [0, 1, 1, 2, 3]
    assert f([(50 * HOUR, False, 0), (0, False, 0), (None, False, 0), (23 * HOUR, False, 0)]) == [0, 0, 0, 0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.floats(0, 1e6)), st.booleans(), st.integers(0, 200)), max_size=30), st.integers(0, 30))
def test_growing_never_moves_earlier_segments(entries, cut):
    whole = segments.folded(entries)
    assert segments.folded(entries[:cut]) == whole[:cut]
    assert all(0 <= b - a <= 1 for a, b in zip(whole, whole[1:], strict=False))


def test_batch_and_windows_agree(spark):
    t0 = datetime(2024, 1, 1)
    rows = [("t", k, None if k % 5 == 4 else t0 + timedelta(hours=h), False, 0) for k, h in enumerate((0, 23, 47, 46, 0, 71, 70, 95, 119, 0))]
    e = spark.createDataFrame(rows, "transcript string, ord long, ts timestamp, is_compaction boolean, thinking int")
    a = {r["ord"]: r["segment"] for r in segments.segments(e).collect()}
    b = {r["ord"]: r["segment"] for r in segments.gap_segments(e, "transcript", "ord", "ts").collect()}
    assert a == b and a == dict(enumerate(segments.folded([(None if t is None else (t - t0).total_seconds(), False, 0) for _, _, t, _, _ in rows])))


def test_jsonl(spark, tmp_path):
    lines = [
        {"type": "user", "sessionId": "s", "timestamp": "2024-01-01T00:00:00Z", "message": {"content": [{"type": "thinking", "thinking": "x"}, {"type": "tool_use", "id": "1", "name": "Read"}]}},
        {"type": "user", "sessionId": "s", "isCompactSummary": True, "message": {"content": [{"type": "tool_result", "tool_use_id": "1"}, {"type": "tool_result", "tool_use_id": "9"}]}},
        {"timestamp": "2024-01-02T00:00:00Z", "type": "event", "payload": {"type": "agent_reasoning"}},
    ]
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps(x) for x in lines[:2]] + ["", "not json", json.dumps(lines[2])]))
    out = transcripts.parsed(transcripts.lines(spark, str(tmp_path))).orderBy("ord").collect()
    assert [(r["dialect"], r["is_compaction"], r["thinking"]) for r in out] == [("a", False, 1), ("a", True, 0), (None, False, 0), ("b", False, 1)]
    uses = {r["tool"]: (r["calls"], r["answered"]) for r in transcripts.tool_uses(transcripts.parsed(transcripts.lines(spark, str(tmp_path)))).collect()}
    assert uses == {"Read": (1, 1), "unknown": (0, 1)}
    assert transcripts.tail(transcripts.lines(spark, str(tmp_path)), 2).count() == 2


def test_git_texts(spark, tmp_path):
    a, b, z = "a" * 40, "b" * 40, "0" * 40
    (tmp_path / "log").write_text(f"{a}\n\nx.ts\ny z.ts\n{b}\nx.ts\n")
    assert sorted((r["commit"][0], r["file"]) for r in git.name_only_log(spark, str(tmp_path / "log")).collect()) == [("a", "x.ts"), ("a", "y z.ts"), ("b", "x.ts")]
    row = spark.createDataFrame([("3\t-\tsrc/{old => new}/f.ts",), ("1\t2\ta.ts => b.ts",), ("5\t6\tsrc/{ => sub}/g.ts",)], "l string").select(*[c.alias(k) for k, c in git.numstat(F.col("l")).items()]).collect()
    assert [(r["additions"], r["deletions"], r["old_path"], r["path"]) for r in row] == [(3, None, "src/old/f.ts", "src/new/f.ts"), (1, 2, "a.ts", "b.ts"), (5, 6, "src/g.ts", "src/sub/g.ts")]
    (tmp_path / "map").write_text(f"old new\n{a} {b}\n{b} {z}\n")
    assert sorted((r[0][0], r[1] and r[1][0]) for r in git.commit_map(spark, str(tmp_path / "map")).collect()) == [("a", "b"), ("b", None)]
    assert git.status_counts(["M  a", " M b", "MM c", "?? d"]) == {"staged": 2, "unstaged": 2, "untracked": 1}


def test_files_and_extractors(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.py").write_text("import no")
    (tmp_path / "m.py").write_text('import os\nfrom . import q\nclass A(B):\n    @app.get("/x")\n    def f(self):\n        bus.emit("saved")\n        return os.getcwd()\n')
    (tmp_path / "bad.py").write_text("def (")
    (tmp_path / "run.sh").write_text("#!/bin/bash\n# comment rm\nnpm run x && ./go.sh $HOME_DIR\n")
    (tmp_path / "topic.md").write_text("---\ntitle: T\nkeywords: [a, b c]\nalways: true\n---\nbody")
    (tmp_path / "_skip.md").write_text("---\ntitle: S\n---\n")
    (tmp_path / "plan-review.md").write_text("x")
    src = files.texts(spark, str(tmp_path))
    nodes, edges = extractors.extract(src, "python")
    assert {(r["kind"], r["qualified_name"].rpartition("/")[2]) for r in nodes.collect() if "bad" not in r["qualified_name"]} >= {("class", "m.py::A"), ("function", "m.py::A::f"), ("event_channel", "saved")}
    assert {(r["relation"], r["to_name"].rpartition("/")[2]) for r in edges.collect()} >= {("imports", "os"), ("inherits", "B"), ("serves_route", "x"), ("emits", "saved"), ("calls", "os.getcwd")}
    nodes, edges = extractors.extract(src, "shell")
    assert {(r["relation"], r["to_name"]) for r in edges.collect()} == {("invokes", "npm"), ("invokes", "./go.sh"), ("reads_env", "HOME_DIR")}
    t = files.topics(spark, str(tmp_path)).where("title is not null").collect()
    assert [(r["title"], r["keywords"], r["always"]) for r in t] == [("T", ["a", "b c"], True)]
    assert {r["path"].rpartition("/")[2] for r in files.markdown(spark, str(tmp_path)).collect()} == {"topic.md"}  # Spark itself leaves names with a leading _ out


def test_incremental(spark):
    ts = datetime(2024, 1, 1)
    claims = spark.createDataFrame([(1, "active", ts), (2, "active", ts + timedelta(hours=9)), (3, "released", ts)], "id int, status string, heartbeat_at timestamp_ntz")
    assert {r["id"]: r["status"] for r in streams.live_claims(claims, "2024-01-01 10:00:00").collect()} == {1: "expired", 2: "active", 3: "released"}
    found = spark.createDataFrame([("a", 5, 10), ("b", 5, 10), ("c", 9, 3), ("d", 9, 30)], "path string, mtime int, size int")
    marks = spark.createDataFrame([("b", 5, 10, 4), ("c", 5, 10, 4), ("d", 5, 10, 4)], "path string, mtime int, size int, open_start_offset int")
    assert {r["path"]: (r["action"], r["from_offset"]) for r in streams.resume_points(found, marks).collect()} == {"a": ("new", 0), "b": ("unchanged", None), "c": ("restart", 0), "d": ("resume", 4)}
    assert {r["path"] for r in streams.unread_files(found, marks).collect()} == {"a", "c", "d"}
    msgs = spark.createDataFrame([(1, "t", "me", "note", "open", 1), (2, "t", "you", "note", "open", 5), (3, "u", "you", "note", "open", 5), (4, "u", "you", "handoff", "open", 5), (5, "t", "you", "note", "open", 2)], "id int, thread string, author string, kind string, status string, created_at int")
    marks = spark.createDataFrame([("me", 3)], "reader string, seen_at int")
    assert {r["id"] for r in streams.fresh_messages(msgs, marks, "me").collect()} == {2, 4}


def test_stream_of_late_duplicates(spark, tmp_path):
    ts = datetime(2024, 1, 10)
    spark.createDataFrame([("x", ts), ("x", ts - timedelta(days=1)), ("y", ts)], "hash string, committed_at timestamp").write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("hash string, committed_at timestamp").parquet(f"{tmp_path}/in")
    q = streams.first_seen(s, ["hash"], "committed_at").writeStream.format("memory").queryName("late").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("late").count() == 2


def test_stream_of_segments_equals_the_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    t0 = datetime(2024, 1, 1)
    rows = [("t", k, t0 + timedelta(hours=h), k == 4, 60) for k, h in enumerate((0, 1, 2, 3, 4, 40, 41, 42, 43))]
    schema = "transcript string, ord long, ts timestamp, is_compaction boolean, thinking int"
    want = {r["ord"]: r["segment"] for r in segments.segments(spark.createDataFrame(rows, schema)).collect()}
    for k, part in enumerate((rows[:3], rows[3:7], rows[7:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        s = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = streams.segmented(s).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert {r["ord"]: r["segment"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 3, 6: 3, 7: 4, 8: 4}
