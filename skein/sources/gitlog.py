"""Logs of repositories as a data source, and their commits in a table that is kept up to date.

    spark.dataSource.register(GitLog)
    spark.read.format("git_log").option("repos", json.dumps([...])).load()

A partition is a repository and a span of commit times; a row is one entry of its log, as git.commits() and git.commit_files()
read it.  Repositories must be readable where the tasks run.
"""

from __future__ import annotations

import json
import subprocess
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..sinks.snapshot import Snapshots
from . import git

#: Days of one partition, and days before the last known commit that a sync reads again, as commits can come late.
SPAN, OVERLAP = 90, 7
COMMITS = "repo string, hash string, parents array<string>, authored_at timestamp, committed_at timestamp, author string, subject string, body string"


@dataclass
class Span(InputPartition):
    repo: str
    since: int
    until: int


def _output(args: list[str]) -> str:
    return subprocess.run(args, check=True, capture_output=True).stdout.decode("utf-8", "replace")


def spans(repo: str, since: int | None, days: int, every: bool) -> list[Span]:
    """Spans of commit times (seconds) that hold all commits of a repository from a moment on; none for an empty repository."""
    refs = ["--all"] if every else ["HEAD"]
    try:
        times = sorted(map(int, _output(["git", "-C", repo, "log", "--format=%ct", *refs]).split()))
    except subprocess.CalledProcessError as e:
        if b"unknown revision" in e.stderr or b"does not have any commits" in e.stderr or b"bad revision" in e.stderr or b"ambiguous argument" in e.stderr:
            return []
        raise
    times = [t for t in times if since is None or t >= since]
    step = days * 86_400
    return [Span(repo, k * step, (k + 1) * step - 1) for k in sorted({t // step for t in times})]


def entries(span: Span, since: int | None, every: bool):
    """(repo, entry) of the commits of a span, each once."""
    command = git.log_command(span.repo, every=every)
    low = span.since if since is None else max(span.since, since)
    # the bounds filter each commit by its own time; a walk that ends at the first old commit would miss late ones
    command[-1 if every else len(command) :] = [*(["--all"] if every else []), f"--since-as-filter=@{low}", f"--until=@{span.until}"]
    with subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.PIPE) as run:
        held: list[str] = []
        for raw in run.stdout:
            line = raw.decode("utf-8", "replace")
            if line.rstrip("\n") == git.COMMIT and held:
                yield span.repo, "".join(held)
                held = []
            held.append(line)
        if held:
            yield span.repo, "".join(held)
        errors = run.stderr.read()
    if run.returncode:
        raise RuntimeError(f"git log of {span.repo}: {errors.decode('utf-8', 'replace').strip()}")


class GitLog(DataSource):
    """Options: repos (a JSON list of paths), since (a JSON object of path and seconds), every (all references), days (of a span)."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return "log string, text string"

    def reader(self, schema) -> DataSourceReader:
        return GitLogReader(self.options)


class GitLogReader(DataSourceReader):
    def __init__(self, options):
        self.repos, self.since = json.loads(options["repos"]), json.loads(options.get("since", "{}"))
        self.every, self.days = options.get("every", "false") == "true", int(options.get("days", SPAN))

    def partitions(self):
        found = [s for r in self.repos for s in spans(r, self.since.get(r), self.days, self.every)]
        return found or [Span("", 0, 0)]

    def read(self, partition):
        return entries(partition, self.since.get(partition.repo), self.every) if partition.repo else iter(())


def commits_of(logs: DataFrame) -> DataFrame:
    """Rows of COMMITS from the source's rows."""
    c = git.commits(logs)
    return c.select(F.col("log").alias("repo"), "hash", "parents", F.try_to_timestamp("authored_at").alias("authored_at"), F.try_to_timestamp("committed_at").alias("committed_at"), "author", "subject", "body")


def synced(spark: SparkSession, table: Snapshots, repos: list[str], overlap: int = OVERLAP, every: bool = False) -> int:
    """The number of commits that a sync has added to `table` (of COMMITS, by repo and hash); what is there stays as it is.

    Each repository is read from `overlap` days before its last known commit on.
    """
    last = {r["repo"]: r["at"] for r in table.read().groupBy("repo").agg(F.unix_seconds(F.max("committed_at")).alias("at")).collect()}  # a row a repository
    since = {r: int((datetime.fromtimestamp(last[r], UTC) - timedelta(days=overlap)).timestamp()) for r in repos if last.get(r) is not None}
    logs = spark.read.format("git_log").option("repos", json.dumps(repos)).option("since", json.dumps(since)).option("every", str(every).lower()).load()
    found = commits_of(logs).dropDuplicates(["repo", "hash"])
    before = table.read()
    new = found.join(before.select("repo", "hash"), ["repo", "hash"], "left_anti")
    n = new.count()
    if n:
        table.append(new)
    return n
