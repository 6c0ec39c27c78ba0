"""Two-pass code extraction, second pass: names of calls and bases meet declarations, by joins.

The first pass (sources.facts) reads each file alone and leaves facts, one row each:

    repo, path, fact, scope, outer, klass, name, kind, receiver, target, candidates, arity, line

* declares: `name` of `kind` in `scope` (A::B, empty at the top), whose kind is `outer`;
* imports: `name` stands for `target` (empty: the module itself, *: all its names) of the first file of `candidates`;
* calls: `receiver`.`name`(...) in `scope`, within the class `klass` (each may be empty); arity is that of the function around it;
* inherits: `scope` is a class with the base `receiver`.`name`.

Imports meet files; exported names spread over the import graph, and methods over bases, each until nothing changes; a name that
means more than one thing is counted, never guessed.  Every step is an equi-join on (repo, path or name), sides with many rows
a name are aggregated before they meet, and what a round has found is stored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import settled

#: Rounds after which imports or bases that still change are an error.
ROUNDS = 64
#: What stands for the class around a call, and for that class's bases.
SUPERS = ("super", "parent")
SELVES = ("self", "cls", "this", "$this", "static", *SUPERS)
_CALL = ["repo", "path", "scope", "outer", "klass", "receiver", "name"]


def joined(*parts: Column) -> Column:
    """Scope parts with :: between those that are not empty."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "::")


def declared(facts: DataFrame, shared: bool = False) -> DataFrame:
    """(repo, path, scope, outer, name, kind, id, line): one row a declaration and file.

    The id is path::scope::name.  shared: a declaration and its definition may stand in different files, so the id is
    repo#scope::name, and functions of other arities get /1, /2 and so on in the order of path and line.
    """
    d = facts.where("fact = 'declares'")
    key = joined(F.col("scope"), F.col("name"))
    if not shared:
        first = d.groupBy("repo", "path", "scope", "outer", "name").agg(F.min(F.struct("line", "kind")).alias("m"))
        return first.select("repo", "path", "scope", "outer", "name", F.col("m.kind").alias("kind"), F.concat_ws("::", "path", key).alias("id"), F.col("m.line").alias("line"))
    d = d.withColumn("_arity", F.when(F.col("kind") == "function", F.coalesce("arity", F.lit(-1))).otherwise(-1))
    what = ["repo", "scope", "name", "kind", "_arity"]
    first = d.groupBy(*what).agg(F.min(F.struct("path", "line")).alias("m"))
    place = F.row_number().over(Window.partitionBy("repo", "scope", "name", "kind").orderBy("m", "_arity")) - 1
    ids = first.select(*what, F.concat(F.col("repo"), F.lit("#"), key, F.when(place > 0, F.concat(F.lit("/"), place.cast("string"))).otherwise("")).alias("id"))
    at = d.groupBy("path", "outer", *what).agg(F.min("line").alias("line"))
    return at.join(ids, what).select("repo", "path", "scope", "outer", "name", "kind", "id", "line", F.col("_arity").alias("arity"))


def import_targets(facts: DataFrame, files: DataFrame) -> DataFrame:
    """imports with `file`: the first candidate that is a file of the repository, or for kind `suffix` the only file that ends with it.

    Null where there is none, or where several files end alike.
    """
    key = ["repo", "path", "name", "target", "receiver", "line"]
    rows = facts.where("fact = 'imports'").select(*key, "kind", "candidates").distinct()
    paths = files.select("repo", F.col("path").alias("file")).distinct()
    exact = rows.where("kind = 'path'").select(*key, F.posexplode("candidates").alias("_k", "file")).join(paths, ["repo", "file"])
    exact = exact.groupBy(*key).agg(F.min_by("file", "_k").alias("file"))
    parts = F.split("file", "/")
    ends = paths.select("repo", "file", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))).alias("_end"))
    only = ends.groupBy("repo", "_end").agg(F.count(F.lit(1)).alias("_n"), F.min("file").alias("file")).where("_n = 1").drop("_n")
    loose = rows.where("kind = 'suffix'").select(*key, F.explode("candidates").alias("_end")).join(only, ["repo", "_end"])
    loose = loose.groupBy(*key).agg(F.min("file").alias("file"))
    return rows.join(exact.unionByName(loose), key, "left")


def visible(decls: DataFrame, imports: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(repo, path, name, n, id, kind): what a top-level name of a file means; n: 1, or 2 for several things, of which id is the smallest.

    imports are those of import_targets.  A name keeps the two smallest things that it may mean.  One that is imported once, in a file without
    star imports, also has a jump along its chain of imports, which doubles each round as it joins the jumps; so the rounds are as many as
    the logarithm of the chain is, and one for each name with several sources and each star import on the way.  Circles end when nothing changes.
    """
    node = ["repo", "path", "name"]
    own = decls.where("scope = ''").select(*node, F.struct("id", "kind").alias("one"))
    modules = imports.where("target = '' and file is not null").select(*node, F.struct(F.col("file").alias("id"), F.lit("file").alias("kind")).alias("one"))
    two = lambda lists: F.slice(F.array_sort(F.array_distinct(lists)), 1, 2)
    known = settled(own.unionByName(modules).groupBy(*node).agg(two(F.collect_set("one")).alias("means")))
    asks = imports.where("target <> '' and file is not null and file <> path").select(*node, "target", "file").distinct()
    stars = settled(asks.where("target = '*'").select("repo", "path", "file").distinct())
    named = asks.where("target <> '*'").join(stars.select("repo", "path", F.lit(True).alias("_star")).distinct(), ["repo", "path"], "left")
    named = settled(named.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*node))).withColumn("_single", F.expr("_n = 1 and _star is null")).select(*node, "target", "file", "_single"))
    jumps, several = named.where("_single").drop("_single"), named.where("not _single").drop("_single")
    for _ in range(rounds):
        there = known.select("repo", F.col("path").alias("file"), F.col("name").alias("target"), "means")
        one = jumps.unionByName(several).join(there, ["repo", "file", "target"]).select(*node, "means")
        every = stars.join(there.where(~F.col("target").startswith("_")), ["repo", "file"]).select("repo", "path", F.col("target").alias("name"), "means")
        rows = known.select(*node, "means", F.col("means").alias("_was")).unionByName(one.unionByName(every), allowMissingColumns=True)
        known = settled(rows.groupBy(*node).agg(two(F.flatten(F.collect_set("means"))).alias("means"), F.max("_was").alias("_was")))
        if known.where("_was is null or means <> _was").isEmpty():
            break
        ahead = jumps.select("repo", F.col("path").alias("file"), F.col("name").alias("target"), F.col("file").alias("_file"), F.col("target").alias("_target"))
        far = jumps.join(ahead, ["repo", "file", "target"], "left")
        jumps = settled(far.select(*node, F.coalesce("_target", "target").alias("target"), F.coalesce("_file", "file").alias("file")))
    else:
        raise RuntimeError("imports did not settle")
    return settled(known.select(*node, F.size("means").cast("long").alias("n"), F.col("means")[0]["id"].alias("id"), F.col("means")[0]["kind"].alias("kind")))


def _outward(scope: Column) -> Column:
    """The scopes around and including a scope, itself first."""
    parts = F.split(scope, "::")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "::"))


def looked_up(asked: DataFrame, decls: DataFrame, names: DataFrame, class_scopes: bool = False) -> DataFrame:
    """asked(repo, path, scope, receiver, name, ...) with (n, id, kind): what a name means where it stands; n 0: nothing known.

    A bare name is looked for in the scopes around it, from the inside (those of classes only if class_scopes), then among the
    file's names; receiver.name among the names of the module, or the members of the class, that the receiver stands for.
    """
    ask = ["repo", "path", "scope", "receiver", "name"]
    rows = settled(asked.select(*ask).distinct())
    inner = decls.where("scope <> ''" if class_scopes else "scope <> '' and outer <> 'class'").select("repo", "path", F.col("scope").alias("_in"), "name", "id", "kind")
    near = rows.where("receiver = '' and scope <> ''").select(*ask, F.posexplode(_outward(F.col("scope"))).alias("_k", "_in")).join(inner, ["repo", "path", "_in", "name"])
    near = settled(near.groupBy(*ask).agg(F.min(F.struct("_k", "id", "kind")).alias("m")).select(*ask, F.lit(1).cast("long").alias("n"), "m.id", "m.kind"))
    rest = rows.where("receiver = ''").join(near.select(*ask), ask, "left_anti")
    top = rest.join(names, ["repo", "path", "name"]).select(*ask, "n", "id", "kind")
    of = names.select("repo", "path", F.col("name").alias("receiver"), F.col("n").alias("_n"), F.col("id").alias("_of"), F.col("kind").alias("_what"))
    at = rows.where("receiver <> ''").join(of, ["repo", "path", "receiver"])
    there = names.select("repo", F.col("path").alias("_of"), "name", "n", "id", "kind")
    module = at.where("_what = 'file'").join(there, ["repo", "_of", "name"]).select(*ask, F.greatest("n", "_n").alias("n"), "id", "kind")
    owned = decls.where("outer = 'class'").select("repo", F.concat_ws("::", "path", "scope").alias("_of"), "name", "id", "kind").distinct()
    member = at.where("_what = 'class'").join(owned, ["repo", "_of", "name"]).select(*ask, F.col("_n").alias("n"), "id", "kind")
    found = near.unionByName(top).unionByName(module).unionByName(member)
    return asked.join(found, ask, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def inherited(facts: DataFrame, decls: DataFrame, names: DataFrame) -> DataFrame:
    """(repo, path, class, base, n): bases of classes; base is null where the name is unknown (n 0) or means several things (n > 1)."""
    asked = facts.where("fact = 'inherits'").select("repo", "path", F.concat_ws("::", "path", "scope").alias("class"), F.lit("").alias("scope"), "receiver", "name").distinct()
    out = looked_up(asked, decls, names)
    return out.select("repo", "path", "class", F.when((F.col("n") == 1) & (F.col("kind") == "class"), F.col("id")).alias("base"), F.when(F.col("kind") == "class", F.col("n")).otherwise(F.lit(0)).alias("n"))


def methods(asked: DataFrame, decls: DataFrame, bases: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """asked(repo, class, name) with (n, id): the method in the class, else in the nearest bases; n > 1: several as near, n 0: none.

    Each round goes one base further up, for all classes at once; a class met again is not gone over twice.
    """
    owned = settled(decls.where("outer = 'class'").select("repo", F.concat_ws("::", "path", "scope").alias("at"), "name", "id").distinct())
    up = settled(bases.where("base is not null").select("repo", F.col("class").alias("at"), "base").distinct())
    asked = settled(asked.select("repo", "class", "name").distinct())
    front = asked.withColumn("at", F.col("class"))
    seen, done = front, None
    for _ in range(rounds):
        hit = settled(front.join(owned, ["repo", "at", "name"]).groupBy("repo", "class", "name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")))
        done = hit if done is None else done.unionByName(hit)
        open_ = front.join(hit.select("repo", "class", "name"), ["repo", "class", "name"], "left_anti")
        front = settled(open_.join(up, ["repo", "at"]).select("repo", "class", "name", F.col("base").alias("at")).distinct().join(seen, ["repo", "class", "name", "at"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    else:
        raise RuntimeError("bases did not settle")
    return asked.join(done, ["repo", "class", "name"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@dataclass
class Resolved:
    """edges (repo, from_id, relation, to_id, confidence, n) and tally (repo, path, relation, status, n)."""

    edges: DataFrame
    tally: DataFrame


def _caller() -> Column:
    return F.when(F.col("scope") == "", F.col("path")).otherwise(F.concat_ws("::", "path", "scope")).alias("from_id")


def _counted(rows: DataFrame, relation: str, target: Column) -> Resolved:
    """rows(repo, path, from_id, n, id, times): links where n is 1."""
    status = F.when(target.isNull() & (F.col("n") <= 1), "external").when(F.col("n") > 1, "ambiguous").otherwise("resolved")
    rows = settled(rows.select("repo", "path", "from_id", F.when(F.col("n") == 1, target).alias("to_id"), status.alias("status"), "times"))
    edges = rows.where("status = 'resolved' and to_id <> from_id").groupBy("repo", "from_id", "to_id").agg(F.sum("times").alias("n"))
    tally = rows.groupBy("repo", "path", "status").agg(F.sum("times").alias("n"))
    named = F.lit(relation).alias("relation")
    return Resolved(edges.select("repo", "from_id", named, "to_id", F.lit("EXTRACTED").alias("confidence"), "n"), tally.select("repo", "path", named, "status", "n"))


def _both(a: Resolved, b: Resolved) -> Resolved:
    return Resolved(a.edges.unionByName(b.edges), a.tally.unionByName(b.tally))


def by_scope(facts: DataFrame, files: DataFrame, class_scopes: bool = False) -> Resolved:
    """calls and inherits of languages whose names are bound by scopes and imports.

    self, this and cls stand for the class around the call; super for its bases.  Files are (repo, path).
    """
    decls = settled(declared(facts))
    names = visible(decls, import_targets(facts, files))
    bases = settled(inherited(facts, decls, names))
    calls = settled(facts.where("fact = 'calls'").groupBy(*_CALL).agg(F.count(F.lit(1)).alias("times")))
    own = F.col("receiver").isin(*SELVES) & (F.col("klass") != "")
    plain = settled(looked_up(calls.where(~own), decls, names, class_scopes))
    unknown = (F.col("n") == 0) & (F.col("receiver") != "")
    # a call through a class that has no such member goes on to the class's bases
    classes = names.where("kind = 'class' and n = 1").select("repo", "path", F.col("name").alias("receiver"), F.col("id").alias("class"))
    through = plain.where(unknown).join(classes, ["repo", "path", "receiver"]).select(*_CALL, "class")
    mine = calls.where(own).select(*_CALL, F.concat_ws("::", "path", "klass").alias("class"))
    up = bases.where("base is not null").select("repo", "class", "base").distinct()
    above = mine.where(F.col("receiver").isin(*SUPERS)).join(up, ["repo", "class"]).select(*_CALL, F.col("base").alias("class"))
    through = settled(through.unionByName(mine.where(~F.col("receiver").isin(*SUPERS))).unionByName(above))
    found = through.join(methods(through, decls, bases), ["repo", "class", "name"]).groupBy(*_CALL).agg(F.sum("n").alias("n"), F.min("id").alias("id"))
    found = found.unionByName(plain.where(~unknown).select(*_CALL, "n", "id"))
    rows = calls.join(found, _CALL, "left").select("repo", "path", _caller(), F.coalesce("n", F.lit(0)).alias("n"), "id", "times")
    heirs = bases.select("repo", "path", F.col("class").alias("from_id"), "n", F.col("base").alias("id"), F.lit(1).cast("long").alias("times"))
    return _both(_counted(rows, "calls", F.col("id")), _counted(heirs, "inherits", F.col("id")))


def by_name(facts: DataFrame, files: DataFrame, ambiguous: str = "count") -> Resolved:
    """calls, inherits and imports of languages whose names are looked for in the whole repository by their last part.

    ambiguous: count (no edge for a name with several functions) or fan (an INFERRED edge to each of them).  Includes end
    in one file or are external; bases that several classes could be are counted.
    """
    if ambiguous not in ("count", "fan"):
        raise ValueError("ambiguous is count or fan")
    decls = settled(declared(facts, shared=True))
    known = decls.select("repo", "name", "kind", "id").distinct()
    meaning = settled(known.groupBy("repo", "name", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")))
    of = lambda kind: meaning.where(F.col("kind") == kind).drop("kind")
    # a caller is the function that the call stands in, by the scope that it opens
    here = decls.where("kind = 'function'").groupBy("repo", "path", joined(F.col("scope"), F.col("name")).alias("scope"), "arity").agg(F.min("id").alias("_id"))
    calls = facts.where("fact = 'calls'").groupBy("repo", "path", "scope", F.coalesce("arity", F.lit(-1)).alias("arity"), "name").agg(F.count(F.lit(1)).alias("times")).join(here, ["repo", "path", "scope", "arity"], "left").withColumn("from_id", F.coalesce("_id", "path"))
    rows = settled(calls.join(of("function"), ["repo", "name"], "left").withColumn("n", F.coalesce("n", F.lit(0))))
    out = _counted(rows, "calls", F.col("id"))
    if ambiguous == "fan":
        several = rows.where("n > 1").select("repo", "name", "from_id", "times").groupBy("repo", "name", "from_id").agg(F.sum("times").alias("n"))
        fan = several.join(known.where("kind = 'function'").select("repo", "name", F.col("id").alias("to_id")), ["repo", "name"]).where("to_id <> from_id")
        fan = fan.select("repo", "from_id", F.lit("calls").alias("relation"), "to_id", F.lit("INFERRED").alias("confidence"), "n")
        out = Resolved(out.edges.unionByName(fan), out.tally)
    heirs = facts.where("fact = 'inherits'").select("repo", "path", "scope", "name").distinct().join(of("class"), ["repo", "name"], "left")
    heirs = heirs.select("repo", "path", F.concat("repo", F.lit("#"), "scope").alias("from_id"), F.coalesce("n", F.lit(0)).alias("n"), "id", F.lit(1).cast("long").alias("times"))
    asked = import_targets(facts, files)
    asked = asked.select("repo", "path", F.col("path").alias("from_id"), F.col("file").isNotNull().cast("long").alias("n"), F.col("file").alias("id"), F.lit(1).cast("long").alias("times"))
    return _both(_both(out, _counted(heirs, "inherits", F.col("id"))), _counted(asked, "imports", F.col("id")))


#: Languages whose names are bound by scopes and imports; in all others the last part of a name decides.
SCOPED = ("python", "ts")


def code_graph(facts: DataFrame, files: DataFrame, language: str, ambiguous: str = "count") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, tally) of files(repo, path) from their facts.

    Nodes (repo, kind, id, name, path, line): files, functions, classes, and what is registered by name (endpoints, hooks,
    options, channels).  Edges (repo, from_id, relation, to_id, confidence, n): defines, imports, calls, inherits and the relations to
    what is registered.  tally (repo, path, relation, status, n) counts what was resolved, ambiguous and external.
    """
    scoped = language in SCOPED
    decls = settled(declared(facts, shared=not scoped))
    found = by_scope(facts, files, class_scopes=language != "python") if scoped else by_name(facts, files, ambiguous)
    one, extracted = F.lit(1).cast("long").alias("n"), F.lit("EXTRACTED").alias("confidence")
    named = facts.where("fact = 'registers'")
    nodes = files.select("repo", F.lit("file").alias("kind"), F.col("path").alias("id"), F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.lit(1).alias("line")).distinct()
    nodes = nodes.unionByName(decls.groupBy("repo", "kind", "id").agg(F.min(F.struct("path", "line", "name")).alias("m")).select("repo", "kind", "id", "m.name", "m.path", "m.line"))
    nodes = nodes.unionByName(named.groupBy("repo", "kind", "name").agg(F.min(F.struct("path", "line")).alias("m")).select("repo", "kind", F.concat_ws(":", "kind", "name").alias("id"), "name", "m.path", "m.line"))
    owners = decls.where("kind = 'class'").select("repo", joined(F.col("scope"), F.col("name")).alias("scope"), *([F.col("path")] if scoped else []), F.col("id").alias("_of")).distinct()
    owned = decls.join(owners, ["repo", "scope", *(["path"] if scoped else [])], "left")
    defines = owned.select("repo", F.coalesce("_of", "path").alias("from_id"), F.lit("defines").alias("relation"), F.col("id").alias("to_id"), extracted, one).distinct()
    edges = found.edges.unionByName(defines)
    if scoped:
        asked = import_targets(facts, files).where("file is not null and file <> path")
        edges = edges.unionByName(asked.select("repo", F.col("path").alias("from_id"), F.lit("imports").alias("relation"), F.col("file").alias("to_id"), extracted, one).distinct())
    here = decls.where("kind = 'function'").groupBy("repo", "path", joined(F.col("scope"), F.col("name")).alias("scope")).agg(F.min("id").alias("_id"))
    users = named.join(here, ["repo", "path", "scope"], "left").select("repo", F.coalesce("_id", "path").alias("from_id"), F.col("target").alias("relation"), F.concat_ws(":", "kind", "name").alias("to_id"))
    edges = edges.unionByName(users.groupBy("repo", "from_id", "relation", "to_id").agg(F.count(F.lit(1)).alias("n")).select("repo", "from_id", "relation", "to_id", extracted, "n"))
    return nodes, edges, found.tally
