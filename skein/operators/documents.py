"""Markdown documents: fence-aware chunks, summaries, frontmatter, replacement."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of one chunk; a longer single line stays whole.
CHUNK_CHARS = 1500
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
_HEADING = re.compile(r"^(#{1,3})\s+(.*?)\s*#*\s*$")


def chunk(text: str, cap: int = CHUNK_CHARS) -> list[tuple[int, int, int, str, str]]:
    """(index, first line, last line, trail, content) of a markdown text.

    Headings of the second and third level open sections, one of the first level only roots the trail; headings within
    fences are text; a fence closes with its own marker, at least as long, and nothing after it.  Sections over the cap
    are packed by paragraphs, paragraphs over it by lines.
    """
    lines = text.split("\n")
    sections: list[tuple[int, int, str]] = []
    trail = ["", "", ""]
    start, fence, name = 0, "", ""
    for k, line in enumerate(lines):
        m = _FENCE.match(line)
        if m:
            mark, rest = m.groups()
            if not fence:
                if mark[0] == "~" or "`" not in rest:  # what follows backticks holds none
                    fence = mark
            elif mark[0] == fence[0] and len(mark) >= len(fence) and not rest.strip():
                fence = ""
            continue
        h = None if fence else _HEADING.match(line)
        if not h:
            continue
        level = len(h[1])
        if level == 1:
            trail = [h[2], "", ""]
            if k == start:
                name = h[2]
            continue
        if k > start:
            sections.append((start, k, name))
        trail = trail[: level - 1] + [h[2]] + [""] * (3 - level)
        start, name = k, " > ".join(t for t in trail if t)
    sections.append((start, len(lines), name))
    out: list[tuple[int, int, int, str, str]] = []
    for a, b, name in sections:
        for i, j in _packed(lines, a, b, cap):
            content = "\n".join(lines[i:j]).strip("\n")
            if content.strip():
                out.append((len(out), i + 1, j, name, content))
    return out


def _packed(lines: list[str], a: int, b: int, cap: int) -> list[tuple[int, int]]:
    size = lambda i, j: sum(len(x) + 1 for x in lines[i:j]) - 1
    if size(a, b) <= cap:
        return [(a, b)]
    pieces, i = [], a
    for j in range(a, b + 1):
        if j == b or not lines[j].strip():
            end = min(j + 1, b)
            if end > i:
                pieces.append((i, end))
            i = end
    units = []
    for i, j in pieces:
        units += [(i, j)] if size(i, j) <= cap else [(k, k + 1) for k in range(i, j)]
    out: list[tuple[int, int]] = []
    for i, j in units:
        if out and size(out[-1][0], j) <= cap:
            out[-1] = (out[-1][0], j)
        else:
            out.append((i, j))
    return out


def chunks(docs: DataFrame, keys: list[str], text: str = "text", cap: int = CHUNK_CHARS) -> DataFrame:
    """(keys, chunk_index, start_line, end_line, heading_trail, content, content_hash) of each document."""
    kinds = dict(docs.dtypes)
    n = len(keys)

    def run(batches):
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            rows = [(*(c[r] for c in cols[:n]), *x, hashlib.sha256(x[4].encode()).hexdigest()) for r in range(b.num_rows) for x in chunk(cols[n][r] or "", cap)]
            types = [b.schema.field(k).type for k in range(n)] + [pa.int32()] * 3 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [*keys, "chunk_index", "start_line", "end_line", "heading_trail", "content", "content_hash"])

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "chunk_index int, start_line int, end_line int, heading_trail string, content string, content_hash string"])
    return docs.select(*keys, text).mapInArrow(run, schema)


def rechunked(old: DataFrame, docs: DataFrame, keys: list[str], cap: int = CHUNK_CHARS) -> DataFrame:
    """Chunks after a sweep (W12): documents whose hash has not changed keep theirs.  old has doc_sha; docs(keys, text)."""
    hashed = docs.withColumn("doc_sha", F.sha2("text", 256))
    same = hashed.join(old.select(*keys, "doc_sha").distinct(), [*keys, "doc_sha"], "left_semi").select(*keys)
    fresh = chunks(hashed.join(same, keys, "left_anti"), [*keys, "doc_sha"], cap=cap)
    kept = old.join(same, keys, "left_semi")
    return kept.select(*old.columns).unionByName(fresh.select(*old.columns))


def summary(text: Column) -> Column:
    """What follows a TL;DR mark, to the end of its paragraph."""
    return F.nullif(F.trim(F.regexp_extract(text, r"(?is)(?:^|\n)[#*>\s]*TL;?DR[:*\s]*(.*?)(?:\n\s*\n|\s*$)", 1)), F.lit(""))


def frontmatter(text: Column, field: str) -> Column:
    """A field of the block between the first two --- lines; null without it."""
    block = F.regexp_extract(text, r"^---\r?\n([\s\S]*?)\r?\n---", 1)
    return F.nullif(F.trim(F.regexp_extract(block, rf"(?m)^{field}:[ \t]*(.*)$", 1)), F.lit(""))


def framed(kind: Column, symbol: Column, language: Column, body: Column, size: int = 2400) -> tuple[Column, Column]:
    """A symbol's document for embedding, and its fingerprint."""
    doc = F.left(F.concat_ws("\n", F.concat(F.lit("Kind: "), kind), F.concat(F.lit("Symbol: "), symbol), F.concat(F.lit("Language: "), F.coalesce(language, F.lit("unknown"))), body), F.lit(size))
    return doc, F.sha2(doc, 256)
