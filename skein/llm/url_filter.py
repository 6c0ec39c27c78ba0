"""URL verdicts from rules and link-graph propagation.

Rules judge by host and path.  Every other url gets its host's verdict: trust starts at hosts by the share of
their pages that rules allow and follows links forward (personalised PageRank); distrust starts by the share that
rules block and follows links backward, so who links to blocked hosts is distrusted.  A host is blocked when its
distrust exceeds its trust by more than the threshold.

Links are resolved as browsers do: against the page's own host, or that of its base element.  Those within a host say
nothing about it and are left out.

All steps are DataFrame operations.  State and edges are stored tables, each round is an equi-join and an
aggregate with map-side partial sums, so hub hosts are not gathered in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored

#: (verdict, rule), host and path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DAMPING = 0.85
#: A host is blocked from more than this share of its own pages, net of trust; links count DAMPING times theirs.
THRESHOLD = 0.5
#: Scores are exact to TOLERANCE; more than ROUNDS rounds mean an error (each leaves DAMPING of what is still to move).
TOLERANCE, ROUNDS = 1e-7, 400
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*["']?\s*([^"'\s>]+)"""
_BASE = r"""(?is)<base\s(?:[^>]*?\s)?href\s*=\s*["']?\s*([^"'\s>]+)"""
_ABSOLUTE, _SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]+)", r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; null or no "://": both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    empty = url.isNull() | (at == 0)
    return F.when(empty, "").otherwise(F.translate(host, _UPPER, _LOWER)), F.when(empty, "").otherwise(path)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): pages of host src that link to host dst, from pages(host, html).

    A relative link leads to the host of the page, or of its base element; fragments and links of schemes without a
    host (mailto, javascript) lead nowhere.
    """
    host_in = lambda x: F.translate(F.regexp_extract(x, _ABSOLUTE, 1), _UPPER, _LOWER)
    base = host_in(F.regexp_extract("html", _BASE, 1))
    own = pages.where("host <> ''").select("host", F.when(base == "", F.col("host")).otherwise(base).alias("base"), F.regexp_extract_all("html", F.lit(_HREF), 1).alias("links"))
    to = lambda x: F.when(x.rlike(_ABSOLUTE), host_in(x)).when(x.rlike(_SCHEME) | x.startswith("#"), F.lit("")).otherwise(F.col("base"))
    found = own.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform("links", to))).alias("dst"))
    return found.where("dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) from seeds(host, trust, distrust) and edges(src, dst, n).

    Scores are unnormalised PageRank sums, the fixed point of (1 - damping) x seed + damping x what neighbours pass on
    in shares of their links.  Rounds end when what is left to move, over all hosts together, is at most
    the tolerance (a geometric series bounds it); if that is not so after `rounds` rounds, an error is raised.
    """
    edges = stored(edges)
    give = lambda by: edges.groupBy(by).agg(F.sum("n").alias("total"))
    forward = edges.join(give("src"), "src").select("src", "dst", (F.col("n") / F.col("total")).alias("w"), F.lit(True).alias("ahead"))
    back = edges.join(give("dst"), "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("n") / F.col("total")).alias("w"), F.lit(False).alias("ahead"))
    moves = stored(forward.unionByName(back))
    nodes = edges.select(F.col("src").alias("host")).unionByName(edges.select(F.col("dst").alias("host"))).distinct()
    start = stored(seeds.join(nodes, "host", "full").select("host", *[(F.coalesce(c, F.lit(0.0)) * (1 - damping)).alias(c) for c in ("trust", "distrust")]))
    state = start
    if edges.isEmpty():
        return state
    for _ in range(rounds):
        passed = state.join(moves, F.col("host") == F.col("src")).select(F.col("dst").alias("host"), F.when(F.col("ahead"), F.col("trust") * F.col("w")).alias("t"), F.when(~F.col("ahead"), F.col("distrust") * F.col("w")).alias("d"))
        got = passed.groupBy("host").agg(F.coalesce(F.sum("t"), F.lit(0.0)).alias("t"), F.coalesce(F.sum("d"), F.lit(0.0)).alias("d"))
        new = start.join(got, "host", "left").select("host", *[(F.col(c) + damping * F.coalesce(g, F.lit(0.0))).alias(c) for c, g in (("trust", "t"), ("distrust", "d"))])
        new = stored(new)
        moved = new.alias("a").join(state.alias("b"), "host").agg(F.sum(F.abs(F.col("a.trust") - F.col("b.trust")) + F.abs(F.col("a.distrust") - F.col("b.distrust")))).first()[0]
        if state is not start:
            dropped(state)
        state = new
        if (moved or 0.0) * damping <= tolerance * (1 - damping):
            return state
    raise RuntimeError("host scores did not settle")


def judge(pages: DataFrame, rules=RULES, damping: float = DAMPING, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of pages(page_id, url, html).

    Urls that are null or lack "://" have an empty host and path, no rule, no links, and are allowed.  Null html has no
    links.  Repeated rows are judged as often as they come; an empty table gives no rows; other columns are ignored.
    A host at the threshold, to within the tolerance of its scores, is allowed.
    """
    host, path = host_and_path(F.col("url"))
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.col("html"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    known = known.withColumns({"rule": rule, "by_rule": verdict})
    hosts = known.where("host <> ''").groupBy("host").agg(F.avg(F.when(F.col("by_rule") == "allow", 1.0).otherwise(0.0)).alias("trust"), F.avg(F.when(F.col("by_rule") == "block", 1.0).otherwise(0.0)).alias("distrust"))
    scores = propagate(hosts, host_edges(known), damping)
    out = known.drop("html").join(scores, "host", "left")
    method = F.when(F.coalesce(F.col("distrust") - F.col("trust"), F.lit(0.0)) > threshold * (1 - damping) + 10 * TOLERANCE, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
