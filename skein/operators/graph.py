"""Property-graph operators over nodes(id, kind, name, ...) and edges(id, from_node, to_node, relation, confidence, weight).

Traversals are loops of equi-joins from a frontier; visited nodes are taken out by anti-joins, never by OR
conditions, which would become nested loops.  Every cut has a total order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import similarity
from ..storage import settled
from .evidence import longest_prefix

#: The baseline of an edge's strength by its confidence.
BASELINE = {"EXTRACTED": 3.0, "INFERRED": 2.0, "LIMITED": 1.0}
#: Kinds and relations at the boundary of a system.
BOUNDARY_KINDS = ("endpoint", "table", "policy", "scheduled_job", "mcp_server", "event_channel")
BOUNDARY_RELATIONS = ("serves_route", "references_table", "fk_to", "secured_by", "scheduled_by", "http_calls", "emits", "listens_on")
#: What a relation says of its target.
ROLES = {
    "use": ("imports", "calls", "references_table", "reads_env", "invokes", "inherits", "depends_on", "reads_option", "writes_option", "http_calls", "emits"),
    "ownership": ("exports", "defines"),
    "root": ("scheduled_by", "serves_route", "secured_by", "fires", "listens_to", "listens_on"),
    "context": ("co_changed_with", "fk_to"),
}
#: Kinds that a system is entered by; nothing that one of them reaches is unused.
ROOT_KINDS = ("endpoint", "hook", "scheduled_job", "mcp_server", "shortcode", "capability", "event_channel")
#: Kinds of each extractor whose uses are found in part; all others are not judged.
COVERED = {
    "php": ("function", "class"),
    "cpp": ("function", "class"),
    "swift": ("function", "class"),
    "kotlin": ("function", "class"),
    "python": ("function",),
    "tier2-go": ("function",),
    "tier2-rust": ("function",),
    "tier2-java": ("function",),
    "tier2-csharp": ("function",),
}


def role(relation: Column) -> Column:
    """What a relation says of its target (G10): use, ownership, root or context; null for relations that are not known."""
    out = F.lit(None).cast("string")
    for name, relations in ROLES.items():
        out = F.when(relation.isin(*relations), name).otherwise(out)
    return out


def coverage(extractor: Column, kind: Column) -> Column:
    """How far an extractor finds the uses of a kind (G10): partial, or null where nothing may be said of it."""
    known = F.lit(False)
    for name, kinds in COVERED.items():
        known = known | ((extractor == name) & kind.isin(*kinds))
    return F.when(known, "partial")


def both_ways(edges: DataFrame) -> DataFrame:
    """(id, relation, here, there) for each edge from either end."""
    a = edges.select("id", "relation", F.col("from_node").alias("here"), F.col("to_node").alias("there"))
    b = edges.select("id", "relation", F.col("to_node").alias("here"), F.col("from_node").alias("there"))
    return a.unionByName(b)


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree) of nodes with edges (A13); a loop counts once."""
    ends = edges.select(F.explode(F.array_distinct(F.array("from_node", "to_node"))).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def reach(edges: DataFrame, seeds: DataFrame, hops: int, direction: str = "both", relation: str | None = None, limit: int | None = None) -> DataFrame:
    """(id, hop, via): nodes within so many hops of seeds(id), each at its first hop.

    direction: out, in or both.  via: the smallest edge of the level before by (relation, here, there, id).  limit: nodes kept per
    level in that order; without it nothing is cut.  Each level is stored, so that none is computed twice.
    """
    if relation is not None:
        edges = edges.where(F.col("relation") == relation)
    ends = ("from_node", "to_node") if direction == "out" else ("to_node", "from_node")
    edges = settled(edges.select("id", "relation", "from_node", "to_node"))  # what makes the edges is computed once, not for each level
    steps = both_ways(edges) if direction == "both" else edges.select("id", "relation", F.col(ends[0]).alias("here"), F.col(ends[1]).alias("there"))
    seen = seeds.select("id").distinct().select("id", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("via"))
    front = seen
    for hop in range(1, hops + 1):
        found = steps.join(front.select(F.col("id").alias("here")), "here").join(seen.select(F.col("id").alias("there")), "there", "left_anti")
        new = found.groupBy(F.col("there").alias("id")).agg(F.min(F.struct("relation", "here", "there", "id")).alias("m"))
        if limit is not None:
            new = new.orderBy("m").limit(limit)
        front = settled(new.select("id", F.lit(hop).alias("hop"), F.col("m.id").alias("via")))
        seen = seen.unionByName(front)
    return seen


def shortest_path(edges: DataFrame, start: str, end: str, hops: int = 10) -> DataFrame:
    """(step, node, edge) along a shortest undirected path, or no rows (G3); ties go to the smallest parent.

    Each level is one join and one aggregate; parents are kept per node, so only the path itself is followed on the driver.
    """
    spark = edges.sparkSession
    steps = both_ways(settled(edges.select("id", "relation", "from_node", "to_node")))  # computed and stored once, not for each hop or way
    seen = spark.createDataFrame([(start, None, None, 0)], "id string, parent string, edge string, hop int")
    found = start == end
    hop = 0
    front = seen
    while not found and hop < hops:
        hop += 1
        near = steps.join(front.select(F.col("id").alias("here")), "here").join(seen.select(F.col("id").alias("there")), "there", "left_anti")
        front = near.groupBy(F.col("there").alias("id")).agg(F.min(F.struct("here", F.col("id").alias("edge"))).alias("m")).select("id", F.col("m.here").alias("parent"), F.col("m.edge").alias("edge"), F.lit(hop).alias("hop"))
        front = settled(front)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        found = not front.where(F.col("id") == end).isEmpty()
    path = []
    at = end if found else None
    while at is not None:  # one lookup per hop
        row = seen.where(F.col("id") == at).first()
        path.append((row["hop"], at, row["edge"]))
        at = row["parent"]
    return spark.createDataFrame(sorted(path), "step int, node string, edge string")


@dataclass(frozen=True)
class Step:
    """One step of a traversal; no kinds: any."""

    direction: str
    relations: tuple[str, ...]
    kinds: tuple[str, ...] = ()

    def __post_init__(self):
        if self.direction not in ("in", "out", "both") or not self.relations:
            raise ValueError("a step has a direction and relations")


def traverse(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, steps: list[Step], allowance: int | None = 100) -> tuple[DataFrame, DataFrame]:
    """Ordered typed traversal (G6): (nodes found with their step, edges kept).

    Each step takes edges from the last step's nodes by (relation, from, to, id); an allowance over all steps is charged
    for every edge before duplicates go, and ends the traversal when it is spent; nodes found once are not expanded again; edges
    stay only between returned nodes.  Taken in both directions (G7), an edge leads to its end that is not in the frontier, or
    to its to_node if both are, and is charged once.  Without an allowance nothing is cut and nothing is counted.  Levels are stored.
    """
    if not 1 <= len(steps) <= 3:
        raise ValueError("one to three steps")
    seen = seeds.select("id", F.lit(0).alias("step"))
    front, kept, left = seeds.select("id"), None, allowance
    for n, step in enumerate(steps, 1):
        if left is not None and left <= 0:
            break
        own = edges.where(F.col("relation").isin(*step.relations))
        near = front.select("id", F.lit(True).alias("_in"))
        if step.direction == "both":
            ends = [near.select(F.col("id").alias(end), F.col("_in").alias(f"_{end}")) for end in ("from_node", "to_node")]
            # an edge with one end in the frontier is found from there; the other end is looked up
            a = own.join(ends[0], "from_node").withColumn("there", F.col("to_node"))
            b = own.join(ends[1], "to_node").join(front.select(F.col("id").alias("from_node")), "from_node", "left_anti").withColumn("there", F.col("from_node"))
            cand = a.select(*edges.columns, "there").unionByName(b.select(*edges.columns, "there"))
        else:
            here, there = ("from_node", "to_node") if step.direction == "out" else ("to_node", "from_node")
            cand = own.join(front.select(F.col("id").alias(here)), here, "left_semi").withColumn("there", F.col(there))
        if step.kinds:
            cand = cand.join(nodes.where(F.col("kind").isin(*step.kinds)).select(F.col("id").alias("there")), "there", "left_semi")
        cand = cand.select(*edges.columns, "there")
        if left is not None:
            cand = cand.orderBy("relation", "from_node", "to_node", "id").limit(left)
        cand = settled(cand)
        if left is not None:
            left -= cand.count()
        new = settled(cand.select(F.col("there").alias("id")).distinct().join(seen, "id", "left_anti"))
        seen = seen.unionByName(new.select("id", F.lit(n).alias("step")))
        kept = cand if kept is None else kept.unionByName(cand)
        front = new
    if kept is None:  # nothing was allowed
        return seen, edges.limit(0)
    kept = kept.select(*edges.columns).dropDuplicates(["id"])
    ends = seen.select("id")
    kept = kept.join(ends.select(F.col("id").alias("from_node")), "from_node", "left_semi").join(ends.select(F.col("id").alias("to_node")), "to_node", "left_semi")
    return seen, kept


def unused(nodes: DataFrame, edges: DataFrame, kinds: list[str], uses: list[str], exports: list[str] = (), reasoned: DataFrame | None = None) -> DataFrame:
    """Nodes of the given kinds that nothing uses (G9): no incoming use, no export at either end, no record attached."""
    out = nodes.where(F.col("kind").isin(*kinds) & F.col("file_path").isNotNull())
    out = out.join(edges.where(F.col("relation").isin(*uses)).select(F.col("to_node").alias("id")), "id", "left_anti")
    if exports:
        ends = edges.where(F.col("relation").isin(*exports)).select(F.explode(F.array("from_node", "to_node")).alias("id"))
        out = out.join(ends, "id", "left_anti")
    if reasoned is not None:
        out = out.join(reasoned.select("id"), "id", "left_anti")
    return out


def strength(edges: DataFrame, signals: DataFrame) -> DataFrame:
    """edges with a strength (A16): a positive co-change weight, else a baseline by confidence plus the signals(id, n) of both ends."""
    base = F.lit(1.0)
    for k, v in BASELINE.items():
        base = F.when(F.col("confidence") == k, v).otherwise(base)
    side = lambda end: signals.select(F.col("id").alias(end), F.col("n").alias(f"_{end}"))
    both = edges.join(side("from_node"), "from_node", "left").join(side("to_node"), "to_node", "left")
    plain = base + F.coalesce(F.col("_from_node"), F.lit(0)) + F.coalesce(F.col("_to_node"), F.lit(0))
    value = F.when((F.col("relation") == "co_changed_with") & (F.col("weight") > 0), F.col("weight").cast("double")).otherwise(plain.cast("double"))
    return both.withColumn("strength", value).drop("_from_node", "_to_node")


def modules(nodes: DataFrame, edges: DataFrame, module: Column) -> tuple[DataFrame, DataFrame]:
    """Module roll-up (A15): (module, kind, n) and (module_a, module_b, n) over edges between different modules."""
    placed = nodes.select("id", "kind", module.alias("module"))
    kinds = placed.groupBy("module", "kind").agg(F.count(F.lit(1)).alias("n"))
    side = lambda end, to: placed.select(F.col("id").alias(end), F.col("module").alias(to))
    ends = edges.join(side("from_node", "_a"), "from_node").join(side("to_node", "_b"), "to_node").where("_a <> _b")
    links = ends.groupBy(F.least("_a", "_b").alias("module_a"), F.greatest("_a", "_b").alias("module_b")).agg(F.count(F.lit(1)).alias("n"))
    return kinds, links


def risk(boundary: Column, relations: Column, repos: Column, dependents: Column, reasoning: Column, soft: Column, capped: Column) -> Column:
    """Risk class of a change (G5).  boundary: a kind at the boundary of a system is affected; soft: an edge is not certain, or the graph itself is not."""
    high = capped | boundary | F.arrays_overlap(relations, F.array(*map(F.lit, BOUNDARY_RELATIONS))) | (repos > 1) | (dependents >= 20)
    medium = (dependents >= 5) | (F.size(F.array_distinct(relations)) >= 2) | reasoning | soft
    return F.when(high, "HIGH").when(medium, "MEDIUM").otherwise("LOW")


def risk_reasons(kinds: Column, relations: Column, repos: Column, dependents: Column, reasoning: Column, soft: Column, capped: Column, cap: int, stale: Column, unresolved: Column, schema: Column | None = None) -> Column:
    """Why a change has its risk class (G5), in one fixed order, joined by semicolons."""
    # The wording of the reasons.
    boundary = F.filter(F.array_distinct(kinds), lambda k: k.isin(*BOUNDARY_KINDS))
    crossed = F.filter(F.array_distinct(relations), lambda r: r.isin(*BOUNDARY_RELATIONS))
    text = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in x])
    several = F.size(F.array_distinct(relations))
    parts = [
        F.when(capped, text("traversal capped at ", F.lit(cap), " edges")),
        F.when(F.size(boundary) > 0, text("public boundary affected: ", F.array_join(boundary, ", "))),
        F.when(F.size(crossed) > 0, text("boundary relation traversed: ", F.array_join(crossed, ", "))),
        F.when(repos > 1, text("spans ", repos, " configured repositories")),
        F.when(dependents >= 20, text(dependents, " dependents (>= 20)")).when(dependents >= 5, text(dependents, " dependents (>= 5)")),
        F.when(several >= 2, text(several, " distinct dependency relations (>= 2)")),
        F.when(reasoning > 0, text(reasoning, " linked decisions/lessons")),
        F.when(F.size(soft) > 0, text("non-extracted edge confidence: ", F.array_join(soft, ", "))),
        F.when(stale, F.lit("a returned code node is stale or unattributed")),
        F.when(unresolved, F.lit("repository HEAD could not be established")),
        F.when(schema if schema is not None else F.lit(False), F.lit("participating DB schema is stale or never introspected")),
    ]
    said = F.array_compact(F.array(*parts))
    return F.when(F.size(said) == 0, "no boundary, cap, reasoning or staleness signal").otherwise(F.array_join(said, "; "))


def dependents(edges: DataFrame, seeds: DataFrame, hops: int = 2, cap: int | None = 100) -> tuple[DataFrame, DataFrame]:
    """(seed, id, hop) of what depends on each of seeds(id), and (seed, edge columns, hop) of the edges found, for all seeds at once.

    Each hop takes the edges into the last hop's nodes by (relation, from_node, to_node, id); of all hops together a seed gets `cap`
    edges at most, so a node counts as a dependent only where one of these edges leads to it.
    """
    found = settled(seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("hop")).distinct())
    front, kept = found, None
    for hop in range(1, hops + 1):
        near = edges.join(front.select("seed", F.col("id").alias("to_node")), "to_node").select("seed", *edges.columns)
        if kept is not None:
            near = near.join(kept.select("seed", "id"), ["seed", "id"], "left_anti")
        if cap is not None:
            order = Window.partitionBy("seed").orderBy("relation", "from_node", "to_node", "id")
            near = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap)
            if kept is not None:
                near = near.join(kept.groupBy("seed").agg(F.count(F.lit(1)).alias("_k")), "seed", "left").where(F.col("_n") <= cap - F.coalesce("_k", F.lit(0))).drop("_k")
            near = near.drop("_n")
        near = settled(near.withColumn("hop", F.lit(hop)))
        kept = near if kept is None else kept.unionByName(near)
        front = settled(near.select("seed", F.col("from_node").alias("id")).distinct().join(found.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("hop", F.lit(hop)))
        found = found.unionByName(front)
    return found, kept


def impact(
    nodes: DataFrame, edges: DataFrame, seeds: DataFrame, decisions: DataFrame, lessons: DataFrame, roots: DataFrame | None = None, project: str = "", hops: int = 2, cap: int | None = 100,
    stale: DataFrame | None = None, unresolved: bool = False, schema_stale: bool = False, most: int = 20,
) -> DataFrame:
    """(id, dependents, edges, capped, relations, repos, decisions, lessons, risk, confidence, reasons): what a change of each of seeds(id) reaches.

    decisions(node, project, description, source, at, valid) count where they are the project's and valid, the newest `most`;
    lessons(node, project, rule, valid) also where they are of no project, the first `most` by rule; both as arrays, the former as
    structs (at, description, source).  roots(root): the repositories that paths belong to, by the longest that holds them.  stale(id): nodes whose
    source has changed; unresolved: a repository's head is not known; schema_stale counts where a table, column or policy is affected.
    """
    found, kept = dependents(edges, seeds, hops, cap)
    of_edges = kept.groupBy("seed").agg(F.count(F.lit(1)).alias("edges"), F.array_sort(F.collect_set("relation")).alias("relations"), F.array_sort(F.collect_set(F.when(F.col("confidence") != "EXTRACTED", F.col("confidence")))).alias("soft"))
    placed = settled(found.join(nodes.select("id", "kind", *(["file_path"] if roots is not None else [])), "id"))
    of_nodes = placed.groupBy("seed").agg(F.sum(F.when(F.col("hop") > 0, 1).otherwise(0)).alias("dependents"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    if roots is not None:
        paths = longest_prefix(placed.where("file_path is not null").select("file_path").distinct(), "file_path", roots, "root")
        of_repos = placed.join(paths, "file_path").groupBy("seed").agg(F.count_distinct("root").alias("repos"))
    else:
        of_repos = of_nodes.select("seed", F.lit(1).cast("long").alias("repos"))
    own = decisions.where("valid").where(F.col("project") == project).select(F.col("node").alias("id"), "at", "description", "source")
    d = found.join(own, "id").select("seed", "at", "description", "source").distinct()
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("at"), "description", "source"))).where(F.col("_n") <= most)
    d = d.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("_n", "at", "description", "source"))).alias("d")).select("seed", F.transform("d", lambda x: F.struct(x["at"].alias("at"), x["description"].alias("description"), x["source"].alias("source"))).alias("decisions"))
    rules = lessons.where("valid").where((F.col("project") == project) | F.col("project").isNull()).select(F.col("node").alias("id"), "rule")
    r = found.join(rules, "id").select("seed", "rule").distinct()
    r = r.withColumn("_n", F.row_number().over(Window.partitionBy("seed").orderBy("rule"))).where(F.col("_n") <= most).groupBy("seed").agg(F.array_sort(F.collect_list("rule")).alias("lessons"))
    old = found.join(stale.select("id"), "id", "left_semi").select("seed").distinct().withColumn("old", F.lit(True)) if stale is not None else of_nodes.select("seed", F.lit(False).alias("old"))
    out = of_nodes
    for part in (of_edges, of_repos, d, r, old):
        out = out.join(part, "seed", "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({"edges": F.coalesce("edges", F.lit(0)), "relations": F.coalesce("relations", none), "soft": F.coalesce("soft", none), "repos": F.coalesce("repos", F.lit(0)), "lessons": F.coalesce("lessons", none), "decisions": F.coalesce("decisions", F.filter("decisions", lambda _: F.lit(False)), F.array().cast(dict(d.dtypes)["decisions"])), "old": F.coalesce("old", F.lit(False))})
    capped = F.lit(False) if cap is None else F.col("edges") >= cap
    reasoning = F.size("decisions") + F.size("lessons")
    schema = F.lit(schema_stale) & F.exists("kinds", lambda k: k.isin("table", "column", "policy"))
    limited = F.col("old") | F.lit(unresolved) | schema
    boundary = F.exists("kinds", lambda k: k.isin(*BOUNDARY_KINDS))
    out = out.withColumns({"capped": capped, "reasoning": reasoning, "limited": limited, "schema": schema})
    return out.select(
        F.col("seed").alias("id"), "dependents", "edges", "capped", "relations", "repos", "decisions", "lessons",
        risk(boundary, F.col("relations"), F.col("repos"), F.col("dependents"), F.col("reasoning") > 0, (F.size("soft") > 0) | F.col("limited"), F.col("capped")).alias("risk"),
        F.when(F.col("limited"), "LIMITED").otherwise("SUFFICIENT").alias("confidence"),
        risk_reasons(F.col("kinds"), F.col("relations"), F.col("repos"), F.col("dependents"), F.col("reasoning"), F.col("soft"), F.col("capped"), cap or 0, F.col("old"), F.lit(unresolved), F.col("schema")).alias("reasons"),
    )


def named_seeds(nodes: DataFrame, text: str, kinds: tuple[str, ...] = (), path_prefix: str | None = None, most: int = 20) -> tuple[DataFrame, bool]:
    """(seeds, capped): nodes that a query starts at (G8): that of the id alone, else all whose name or qualified name holds the text.

    Letters' case does not count and no character is a wildcard.  Those that are the text come first, then by the greater
    trigram similarity of the two names, kind, qualified name and id; kinds and a path prefix narrow what is looked at.  capped: there are more.
    seeds have id, exact, score and place.
    """
    by_id = nodes.where(F.col("id") == text).select("id", F.lit(True).alias("exact"), F.lit(1.0).alias("score"), F.lit(1).alias("place"))
    if not by_id.isEmpty():
        return by_id, False
    want = text.lower()
    name, qualified = F.col("name"), F.coalesce("qualified_name", F.lit("")) if "qualified_name" in nodes.columns else F.lit("")
    hit = nodes.where((F.instr(F.lower(name), F.lit(want)) > 0) | (F.instr(F.lower(qualified), F.lit(want)) > 0))
    if kinds:
        hit = hit.where(F.col("kind").isin(*kinds))
    if path_prefix is not None:
        hit = hit.where(F.startswith("file_path", F.lit(path_prefix)))
    exact = (F.lower(name) == want) | (F.lower(qualified) == want)
    score = F.greatest(similarity(name, F.lit(text)), similarity(qualified, F.lit(text)))
    ranked = hit.select("id", exact.alias("exact"), score.alias("score"), "kind", F.when(qualified != "", qualified).otherwise(name).alias("_q"))
    order = [F.desc("exact"), F.desc("score"), "kind", "_q", "id"]
    top = settled(ranked.orderBy(*order).limit(most + 1).withColumn("place", F.row_number().over(Window.orderBy(*order))).select("id", "exact", "score", "place"))
    return top.where(F.col("place") <= most), top.count() > most


def linked_tables(nodes: DataFrame, prefix: DataFrame) -> DataFrame:
    """(from_node, to_node): logical tables and the physical ones of the configured prefix (G20, J13, J14): prefix(p) is one row."""
    logical = nodes.where("kind = 'wp_table'").crossJoin(F.broadcast(prefix.limit(1))).select(F.col("id").alias("from_node"), F.concat("p", "name").alias("name"))
    return logical.join(nodes.where("kind = 'table'").select(F.col("id").alias("to_node"), "name"), "name").select("from_node", "to_node")


def export(nodes: DataFrame, edges: DataFrame, most_nodes: int = 25_000, most_edges: int = 60_000) -> tuple[DataFrame, DataFrame]:
    """The largest part of a graph that may be drawn (G12): nodes by degree, then id; edges between them by id."""
    top = nodes.join(degree(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).orderBy(F.desc("degree"), "id").limit(most_nodes)
    ids = top.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "from_node"), "from_node", "left_semi").join(ids.withColumnRenamed("id", "to_node"), "to_node", "left_semi")
    return top, kept.orderBy("id").limit(most_edges)


def mermaid(nodes: list[tuple[str, str]], edges: list[tuple[str, str, str]]) -> str:
    """A flow chart of a few nodes (id, label) and edges (from, to, relation)."""
    names = {i: f"n{k}" for k, (i, _) in enumerate(nodes)}
    clean = lambda s: "".join(c if c.isalnum() or c in " ._/-" else " " for c in s)[:60]
    lines = ["graph LR", *(f'  {names[i]}["{clean(label)}"]' for i, label in nodes)]
    return "\n".join(lines + [f"  {names[a]} -->|{clean(r)}| {names[b]}" for a, b, r in edges if a in names and b in names])
