from skein.sources import git

LOG = """@@ENTRY@@
aa11\tp1 p2\t2026-01-02T03:04:05Z\t2026-01-02T03:04:06Z\tAnn
feat: first
@@BODY@@
line one

line two

@@ENDBODY@@
:100644 100644 1 2 M\tsrc/a.py
:100644 100644 1 2 R95\tsrc/old.py\tsrc/new.py
:000000 100644 0 2 A\tlogo.png
3\t1\tsrc/a.py
2\t0\tsrc/{old.py => new.py}
-\t-\tlogo.png
@@ENTRY@@
bb22\t\t2026-01-01T00:00:00Z\t2026-01-01T00:00:00Z\tBob
root
@@BODY@@
@@ENDBODY@@
:100644 000000 1 0 D\tgone.py
0\t9\tgone.py
5\t5\tx.py => y.py
@@ENTRY@@
broken entry
"""


def test_commits_and_files(spark):
    logs = spark.createDataFrame([("l", LOG), ("empty", "")], "log string, text string")
    got = {r["hash"]: r for r in git.commits(logs).collect()}
    assert set(got) == {"aa11", "bb22"}
    a, b = got["aa11"], got["bb22"]
    assert (a["parents"], a["author"], a["subject"], a["body"], a["committed_at"]) == (["p1", "p2"], "Ann", "feat: first", "line one\n\nline two", "2026-01-02T03:04:06Z")
    assert (b["parents"], b["body"], b["subject"]) == ([], "", "root")
    files = {(r["hash"], r["path"]): (r["status"], r["old_path"], r["additions"], r["deletions"], r["is_binary"]) for r in git.commit_files(logs).collect()}
    assert files == {
        ("aa11", "src/a.py"): ("modified", None, 3, 1, False),
        ("aa11", "src/new.py"): ("renamed", "src/old.py", 2, 0, False),
        ("aa11", "logo.png"): ("added", None, None, None, True),
        ("bb22", "gone.py"): ("deleted", None, 0, 9, False),
        ("bb22", "y.py"): ("renamed", "x.py", 5, 5, False),
    }


def test_the_command_prints_what_is_read():
    command = git.log_command("r", since="2026-01-01", every=True)
    assert command[:3] == ["git", "-C", "r"] and "--all" in command and "--since=2026-01-01" in command
    assert any(git.COMMIT in x and git.BODY in x and git.END in x for x in command)


def commit(repo, name, at, text="x"):
    import os
    import subprocess

    with open(os.path.join(repo, name), "w") as f:
        f.write(text)
    env = {**os.environ, "GIT_AUTHOR_DATE": at, "GIT_COMMITTER_DATE": at, "GIT_AUTHOR_NAME": "Ann", "GIT_COMMITTER_NAME": "Ann", "GIT_AUTHOR_EMAIL": "a@b.c", "GIT_COMMITTER_EMAIL": "a@b.c"}
    for args in (["add", "."], ["commit", "-q", "-m", f"feat: {name}\n\nwhy ü {at}"]):
        subprocess.run(["git", "-C", repo, *args], check=True, env=env)


def test_two_syncs_with_late_commits_equal_one(spark, tmp_path):
    import subprocess

    from skein.sinks.snapshot import Snapshots
    from skein.sources import gitlog

    spark.dataSource.register(gitlog.GitLog)
    repos = [str(tmp_path / x) for x in ("one", "two", "empty")]
    for r in repos:
        subprocess.run(["git", "init", "-q", r], check=True)
    commit(repos[0], "a.py", "2024-01-01T10:00:00+02:00")
    commit(repos[0], "b ü.py", "2024-06-01T10:00:00Z")
    commit(repos[1], "c.py", "2024-03-01T10:00:00Z")
    new = lambda name: Snapshots(spark, str(tmp_path / name), gitlog.COMMITS, ["repo", "hash"], parts=2)
    table, once = new("t"), new("once")
    assert gitlog.synced(spark, table, repos) == 3 and gitlog.synced(spark, table, repos) == 0
    commit(repos[0], "late.py", "2024-05-28T10:00:00Z")  # within the overlap
    commit(repos[1], "d.py", "2024-03-02T10:00:00Z")
    assert gitlog.synced(spark, table, repos) == 2
    assert gitlog.synced(spark, once, repos) == 5
    key = lambda t: sorted(map(tuple, t.read().collect()), key=lambda r: r[:2])
    assert key(table) == key(once)
    assert {r["subject"] for r in table.read().collect()} == {f"feat: {x}" for x in ("a.py", "b ü.py", "c.py", "d.py", "late.py")}
    logs = spark.read.format("git_log").option("repos", f'["{repos[0]}"]').option("days", "30").load()
    assert logs.rdd.getNumPartitions() == 2 and {r["path"] for r in git.commit_files(logs).collect()} == {"a.py", "b ü.py", "late.py"}
