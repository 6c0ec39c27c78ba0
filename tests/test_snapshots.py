import os

import pytest

from skein.sinks.snapshot import Conflict, Snapshots
from skein.sources import tail


def rows(table, version=None):
    return sorted(map(tuple, table.read(version).collect()))


@pytest.fixture()
def table(spark, tmp_path):
    return Snapshots(spark, str(tmp_path / "t"), "k int, v string", ["k"], parts=4)


def frame(spark, values):
    return spark.createDataFrame(values, "k int, v string")


def test_versions_upserts_and_removals(spark, table):
    assert rows(table) == [] and table.version() == 1
    table.upsert(frame(spark, [(k, "a") for k in range(20)]))
    before = table.manifest()["folders"]
    table.upsert(frame(spark, [(3, "b"), (3, "c"), (30, "n")]))
    after = table.manifest()["folders"]
    assert 0 < sum(before[p] != after[p] for p in before) <= 2  # only touched parts are written
    assert rows(table) == sorted([(k, "a") for k in range(20) if k != 3] + [(3, "b"), (30, "n")])
    assert rows(table, 2) == [(k, "a") for k in range(20)]
    table.remove(spark.createDataFrame([(k,) for k in range(25)], "k int"))
    assert rows(table) == [(30, "n")]
    table.append(frame(spark, [(30, "n"), (30, "m")]))
    assert rows(table) == [(30, "m"), (30, "n"), (30, "n")]
    table.replace(frame(spark, [(30, "x")]), ["k"])
    assert rows(table) == [(30, "x")] and rows(table, 2) == [(k, "a") for k in range(20)]
    table.vacuum(keep=1)
    assert table.versions() == [6] and rows(table) == [(30, "x")]


def test_a_batch_is_written_once(spark, table):
    for number in (0, 1, 1, 0, 2):
        table.append(frame(spark, [(number, "x")]), "s", number)
    assert rows(table) == [(0, "x"), (1, "x"), (2, "x")]
    table.append(frame(spark, [(9, "y")]), "other", 0)
    assert len(rows(table)) == 4


def test_a_crash_before_the_manifest_changes_nothing(spark, table, monkeypatch):
    table.upsert(frame(spark, [(1, "a"), (2, "a")]), "s", 0)
    put = Snapshots._put
    monkeypatch.setattr(Snapshots, "_put", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.upsert(frame(spark, [(1, "b")]), "s", 1)
    monkeypatch.setattr(Snapshots, "_put", put)
    again = Snapshots(spark, table.root)
    assert rows(again) == [(1, "a"), (2, "a")] and again.version() == 2
    again.upsert(frame(spark, [(1, "b")]), "s", 1)
    assert rows(again) == [(1, "b"), (2, "a")]
    assert again.vacuum(keep=1) >= 1 and rows(again) == [(1, "b"), (2, "a")]


def test_one_of_two_writers_is_told(spark, table):
    seen = table.manifest()
    table.upsert(frame(spark, [(1, "a")]))
    with pytest.raises(Conflict):
        table._put(dict(seen, version=seen["version"] + 1))
    assert rows(table) == [(1, "a")] and len(table.versions()) == 2


def test_keys_are_those_of_the_table(spark, table):
    with pytest.raises(ValueError):
        table.replace(frame(spark, [(1, "a")]), ["v"])


# ---- growing files into a table -------------------------------------------------------------------------------


def put(path, text, mode="w"):
    with open(path, mode, newline="") as f:
        f.write(text)


def run(spark, folder, table, checkpoint):
    q = spark.readStream.format("transcript_tail").option("path", folder).load().writeStream.foreachBatch(tail.lines_written(table, "tail")).option("checkpointLocation", checkpoint).trigger(once=True).start()
    q.awaitTermination()
    assert q.exception() is None


def whole_lines(folder):
    out = []
    for name in sorted(os.listdir(folder)):
        with open(os.path.join(folder, name), "rb") as f:
            data, at = f.read(), 0
        for x in data.split(b"\n")[:-1]:
            out.append((os.path.join(folder, name), at, x.removesuffix(b"\r").decode("utf-8", "replace")))
            at += len(x) + 1
    return sorted(out)


def test_append_truncate_replace_and_restart(spark, tmp_path):
    spark.dataSource.register(tail.TranscriptTail)
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    os.mkdir(folder)
    a, b = os.path.join(folder, "a.jsonl"), os.path.join(folder, "b.jsonl")
    table = Snapshots(spark, str(tmp_path / "lines"), "path string, offset long, line string", ["path"])
    put(a, '{"n": 1}\n{"n": 2}\n{"ha')
    put(b, "x\r\n\nü\n")
    step = lambda: (run(spark, folder, table, checkpoint), rows(table) == whole_lines(folder))[1]  # noqa: E731  each run is a restart from the checkpoint
    assert step() and len(rows(table)) == 5
    put(a, 'lf": 3}\n{"n": 4}\n', "a")
    put(os.path.join(folder, "c.jsonl"), "no end")
    assert step() and len(rows(table)) == 7
    version = table.version()
    assert step() and table.version() == version  # nothing new, nothing written
    put(a, '{"n": 1}\n')
    assert step() and len(rows(table)) == 4
    put(a, "another\nfile that is longer than before, with another first line\n")
    assert step() and (a, 0, "another") in rows(table)
    put(b, "")
    assert step() and {r[0] for r in rows(table)} == {a}
    put(b, "y\n", "a")
    assert step() and (b, 0, "y") in rows(table)


def test_pieces_hold_each_line_once(tmp_path):
    path = str(tmp_path / "a.jsonl")
    text = "".join(f"{'z' * (k * 7 % 23)}{k}\n" for k in range(300)) + "half"
    put(path, text)
    latest = tail._Offsets({"path": str(tmp_path)}).latest()
    want = [(r[3], r[4]) for r in tail.read_piece(tail.pieces({}, latest)[0])]
    assert [x[1] for x in want] == text.split("\n")[:-1]
    for size in (1, 5, 17, 64, 1000):
        got = [(r[3], r[4]) for p in tail.pieces({}, latest, size) for r in tail.read_piece(p)]
        assert got == want


def test_batch_read(spark, tmp_path):
    spark.dataSource.register(tail.TranscriptTail)
    put(str(tmp_path / "a.jsonl"), "1\n2\n3")
    put(str(tmp_path / "skipped.txt"), "1\n")
    got = spark.read.format("transcript_tail").option("path", str(tmp_path)).load()
    assert [(r["offset"], r["line"], r["restart"]) for r in got.orderBy("offset").collect()] == [(0, "1", False), (2, "2", False)]
