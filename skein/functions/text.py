"""Text expressions: trigram similarity, token scores, normalisers.  All but word_similarity stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions and the language each stands for; any other is "other".
LANGUAGES = {
    ".ts": "typescript",
    ".tsx": "typescript",
    ".js": "javascript",
    ".jsx": "javascript",
    ".gd": "gdscript",
    ".py": "python",
    ".rs": "rust",
    ".go": "go",
    ".java": "java",
    ".kt": "kotlin",
    ".swift": "swift",
    ".c": "c",
    ".cpp": "cpp",
    ".h": "c-header",
    ".hpp": "cpp-header",
    ".md": "markdown",
    ".sql": "sql",
    ".sh": "bash",
    ".json": "json",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".toml": "toml",
    ".tres": "godot-resource",
    ".tscn": "godot-scene",
    ".gdshader": "godot-shader",
}
#: Words that say nothing about a task.
STOPWORDS = (
    "the and for with this that from into your you our its "
    "was are has had not but all any can out via per off "
    "add use fix get set new run let how why when make need "
    "want should would could then than also only just work flow"
).split()
#: Whole numbers that a double holds exactly end here.
SAFE = (1 << 53) - 1


def trigrams(text: Column) -> Column:
    """Distinct trigrams of a text's words, lower-cased; each word stands between two blanks and one."""
    words = F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), lambda w: F.length(w) > 0)
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; two empty sets: 0."""
    both = F.size(F.array_intersect(a, b))
    whole = F.size(a) + F.size(b) - both
    return F.when(whole > 0, both / whole).otherwise(F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """Trigram similarity of two texts."""
    return jaccard(trigrams(a), trigrams(b))


def _grams(text: str) -> list[str]:
    words = re.findall(r"[^\W_]+", text.lower())
    of = {w: [p[i : i + 3] for i in range(len(p) - 2)] for w in set(words) for p in [f"  {w} "]}
    return [g for w in words for g in of[w]]


def extent_similarity(query: str, text: str, least: float = 0.0) -> float:
    """The best trigram similarity of a query to any continuous extent of a text's trigrams; what is below `least` may come out as 0.

    An extent starts where a run of the query's trigrams starts, since more of a run costs nothing; it grows to the right and keeps the best
    share of shared over all distinct trigrams.  It stops where all of its first run has come again, since the extent from the next run on is
    as good, so a text is gone over at most once for each of the query's trigrams.
    """
    want, have = set(_grams(query)), _grams(text)
    most, best, again = len(want), 0.0, {}
    hits = [k for k, g in enumerate(have) if g in want]
    if len({have[k] for k in hits}) < least * most - 1e-9:
        return 0.0
    end = len(have)
    for n in range(len(hits) - 1, -1, -1):
        start = hits[n]
        if n and hits[n - 1] == start - 1:
            continue
        stop, k = 0, n
        while k < len(hits) and hits[k] - k == start - n:
            stop = max(stop, again.get(have[hits[k]], end))
            k += 1
        for p in range(k - 1, n - 1, -1):
            again[have[hits[p]]] = hits[p]
        seen: set[str] = set()
        shared = extra = 0
        # beyond so many others, all the rest of the query could not lift it
        room = most / max(best, least - 1e-9, 1e-9) - most
        for k in range(start, stop):
            g = have[k]
            if g in seen:
                continue
            seen.add(g)
            if g in want:
                shared += 1
                if shared > best * (most + extra):
                    best = shared / (most + extra)
                    room = most / max(best, least - 1e-9) - most
                if shared == most:
                    break
            else:
                extra += 1
                if extra > room:
                    break
    return best


def word_similarity(query: str, least: float = 0.0):
    """A column function: extent_similarity of a fixed query to each text; what is below `least` may come out as 0."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: extent_similarity(query, t or "", least)).astype("float64")

    return run


def tokens(text: Column, least: int = 3) -> Column:
    """Distinct lower-case alphanumeric tokens of at least so many characters, in order."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= least))


def task_tokens(text: Column, most: int = 10) -> Column:
    """The first distinct tokens of a task (letters a to z and digits) that are no stopwords."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)
    return F.slice(F.array_except(words, F.array(*map(F.lit, STOPWORDS))), 1, most)


def token_fraction(query: Column, text: Column) -> Column:
    """The share of a query's distinct tokens that a text contains; no tokens: 0."""
    q = tokens(query)
    return F.when(F.size(q) > 0, F.size(F.filter(q, lambda w: F.contains(F.lower(text), w))) / F.size(q)).otherwise(F.lit(0.0))


def contains_literal(text: Column, part: Column) -> Column:
    """Case-blind containment in which % and _ mean themselves."""
    return F.instr(F.lower(text), F.lower(part)) > 0


def excerpt(text: Column, size: int = 160) -> Column:
    """One line of at most `size` characters, with an ellipsis where it was cut."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > size, F.concat(F.rtrim(F.substring(flat, 1, size - 1)), F.lit("…"))).otherwise(flat)


def first_sentence(text: Column) -> Column:
    """Up to the first full stop, exclamation or question mark before a blank; else the whole."""
    hit = F.regexp_extract(text, r"^([\s\S]*?[.!?])(\s|$)", 1)
    return F.when(hit == "", text).otherwise(hit)


def middle_trim(items: Column, most: int) -> Column:
    """Head and tail of an array of too many items; the head has the odd one."""
    head = -(-most // 2)
    return F.when(F.size(items) <= most, items).otherwise(F.concat(F.slice(items, 1, head), F.slice(items, F.size(items) - (most - head) + 1, most - head)))


def language_of(path: Column) -> Column:
    """Language by extension, what follows the last dot of a file's name unless that is its first character; unknown: other."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    ext = F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))
    return F.coalesce(F.try_element_at(table, ext), F.lit("other"))


def commit_type(message: Column) -> tuple[Column, Column]:
    """Type and scope of a conventional commit's subject; null where it is none."""
    pattern = r"^(\w+)(?:\(([^)]+)\))?:"
    return tuple(F.nullif(F.regexp_extract(message, pattern, k), F.lit("")) for k in (1, 2))


def route(path: Column) -> Column:
    """A route with its parameters as {} and its rests as {**}."""
    step = lambda s: (
        F.when(s.rlike(r"^\[\.\.\..+\]$") | s.rlike(r"^<path:.+>$"), "{**}")
        .when(s.rlike(r"^:.+") | s.rlike(r"^\{.+\}$") | s.rlike(r"^\[.+\]$") | s.rlike(r"^<.+>$"), "{}")
        .otherwise(s)
    )
    return F.array_join(F.transform(F.split(path, "/"), step), "/")


def alias(name: Column) -> Column:
    """A service name as lower-case alphanumeric runs with hyphens."""
    return F.array_join(F.regexp_extract_all(F.lower(name), F.lit("([a-z0-9]+)"), 1), "-")


def host(url: Column) -> Column:
    """Lower-case host of a url."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def short_count(n: Column) -> Column:
    """A count for display: a million and more as such, what is no count as ?."""
    return F.when(n.isNull() | (n < 0) | (n > SAFE) | (n != F.floor(n)), "?").when(n >= 1_000_000, "≥1M").otherwise(n.cast("long").cast("string"))


def minute(at: Column) -> Column:
    """A moment to the minute, in UTC."""
    return F.date_format(at, "yyyy-MM-dd HH:mm")


def duration_minutes(start: Column, end: Column) -> Column:
    """Whole minutes of a span, one at least."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.greatest(F.lit(1), F.floor(micros / 60_000_000 + 0.5)).cast("long")
