"""Growing JSONL files as a stream that resumes at bytes (S5, T2): a Python data source.

    spark.dataSource.register(TranscriptTail)
    spark.readStream.format("transcript_tail").option("path", folder).load()

An offset holds, for each file, the end of its last whole line, its time and the checksum of its first line.  A file that has
become shorter, or begins with another line, is read anew and its rows say so (`restart`); a half line waits for its end.
Offsets are only ever compared in pairs, so a restarted query needs nothing but its checkpoint.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of one file that a task reads; bytes that are looked at from a file's end for the last line's end at a time.
PIECE, BLOCK = 32 << 20, 64 << 10
SCHEMA = "path string, mtime long, restart boolean, offset long, line string"


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def line_end(f, size: int) -> int:
    """The place after the last newline of an open file, 0 where there is none."""
    at = size
    while at > 0:
        start = max(0, at - BLOCK)
        f.seek(start)
        found = f.read(at - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        at = start
    return 0


def first_line(f, end: int) -> int:
    """The checksum of the first line of an open file that has one."""
    f.seek(0)
    crc, left = 0, end
    while left > 0:
        part = f.read(min(BLOCK, left))
        cut = part.find(b"\n")
        crc = zlib.crc32(part if cut < 0 else part[:cut], crc)
        if cut >= 0 or not part:
            break
        left -= len(part)
    return crc


@dataclass
class Piece(InputPartition):
    """The lines of a file that begin from `start` on and before `stop`."""

    path: str
    mtime: int
    restart: bool
    start: int
    stop: int
    aligned: bool


def pieces(start: dict, end: dict, size: int = PIECE) -> list[Piece]:
    """What lies between two offsets: the whole of new, shortened and replaced files, what has been added to others."""
    out = []
    for path, now in sorted(end.items()):
        was = start.get(path)
        again = was is not None and (now["byte"] < was["byte"] or was["byte"] > 0 and now["head"] != was["head"])
        at = 0 if was is None or again else was["byte"]
        if again and now["byte"] == 0:  # nothing is left: one empty piece tells that it was read anew
            out.append(Piece(path, now["mtime"], True, 0, 0, True))
        out += [Piece(path, now["mtime"], again, a, min(a + size, now["byte"]), a == at) for a in range(at, now["byte"], size)]
    return out


def read_piece(p: Piece) -> Iterator[tuple]:
    files, path = _files(p.path)
    if p.stop == 0 and p.restart:
        yield p.path, p.mtime, True, -1, None
        return
    with files.open_input_file(path) as f:
        at = p.start
        f.seek(at - (0 if p.aligned else 1))
        rest = b""
        if not p.aligned:  # a line that began before is another piece's
            while b"\n" not in rest:
                part = f.read(BLOCK)
                if not part:
                    return
                rest = part if b"\n" in part else b""
                at = f.tell() - len(rest)
            cut = rest.index(b"\n") + 1
            rest, at = rest[cut:], at + cut
        while at < p.stop:
            held = [rest]
            while b"\n" not in held[-1]:
                part = f.read(BLOCK)
                if not part:
                    return
                held.append(part)
            rest = b"".join(held)
            *lines, rest = rest.split(b"\n")
            for x in lines:
                if at >= p.stop:
                    return
                yield p.path, p.mtime, p.restart, at, x.removesuffix(b"\r").decode("utf-8", "replace")
                at += len(x) + 1


class _Offsets:
    def __init__(self, options):
        self.path, self.pattern = options["path"], re.compile(options.get("pattern", r"\.jsonl$"))

    def latest(self) -> dict:
        from pyarrow import fs

        files, base = _files(self.path)
        out = {}
        prefix = self.path[: len(self.path) - len(base)] if self.path.endswith(base) else ""
        for i in files.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
            if i.is_file and self.pattern.search(i.path):
                with files.open_input_file(i.path) as f:
                    end = line_end(f, i.size)
                    out[prefix + i.path] = {"byte": end, "mtime": -(-i.mtime_ns // 1_000_000), "head": first_line(f, end)}
        return out


class TranscriptTail(DataSource):
    """Options: path (a folder), pattern (of file names)."""

    @classmethod
    def name(cls) -> str:
        return "transcript_tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TailReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailStreamReader(self.options)


class TailReader(DataSourceReader):
    """All whole lines at once."""

    def __init__(self, options):
        self.offsets = _Offsets(options)

    def partitions(self):
        return pieces({}, self.offsets.latest())

    def read(self, partition):
        return read_piece(partition)


class TailStreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.offsets = _Offsets(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.offsets.latest()

    def partitions(self, start: dict, end: dict):
        return pieces(start, end)

    def read(self, partition):
        return read_piece(partition)


def lines_written(table, stream: str):
    """A foreachBatch function that keeps `table` (sinks.Snapshots of path, offset, line by path) equal to the files' whole lines.

    Of a file that was read anew the lines from before go; a batch that comes again changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            again = new.where("restart").select("path").distinct()
            return old.join(again, "path", "left_anti").unionByName(new.where(F.col("offset") >= 0).select("path", "offset", "line"))

        table.change(batch, merge, stream, number)

    return write
