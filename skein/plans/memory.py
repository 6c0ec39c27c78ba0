"""Named queries over records, reads and linkers, each with the SQL it is held against (see catalog)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import budget, evidence, graph, linkers, relational, retrieval, services, writes
from .catalog import _B, _E, _GRAMS, _N, NOW, _edges, _nodes, _vector, query

_PATH = "'src/' || p_brand || '/' || p_name || '.py'"


def _path():
    return F.concat(F.lit("src/"), "p_brand", F.lit("/"), "p_name", F.lit(".py"))


def _sid(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


# ---- scans, joins, sets ---------------------------------------------------------------------------------------


@query("""SELECT p_partkey, p_name FROM part WHERE p_partkey = 7""")
def point_lookup(t):
    """One row by its id; the filter reaches the scan."""
    return t.part.where("p_partkey = 7").select("p_partkey", "p_name")


@query("""SELECT total, o_orderkey, o_totalprice FROM (SELECT count(*) AS total FROM orders) LEFT JOIN (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 1) ON true""")
def total_with_latest(t):
    """A total that stays even where there is no latest row."""
    total = t.orders.agg(F.count(F.lit(1)).alias("total"))
    latest = t.orders.where("o_orderstatus = 'F'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(1).select("o_orderkey", "o_totalprice")
    return total.join(F.broadcast(latest), F.lit(True), "left")


@query("""SELECT 'w:' || a.p_partkey AS from_node, 't:' || b.p_partkey AS to_node FROM part a JOIN part b ON (SELECT n_name FROM nation WHERE n_nationkey = 3) || a.p_brand || a.p_name = 'NATION_' || b.p_size % 25 || b.p_brand || b.p_name""")
def table_links(t):
    """Logical tables linked to the physical ones of a configured prefix, here a nation's name."""
    brand = t.part.select("p_partkey", "p_brand", "p_name", "p_size")
    logical = brand.select(_sid("w:", "p_partkey").alias("id"), F.lit("wp_table").alias("kind"), F.concat("p_brand", "p_name").alias("name"))
    physical = brand.select(_sid("t:", "p_partkey").alias("id"), F.lit("table").alias("kind"), F.concat(F.lit("NATION_"), (F.col("p_size") % 25).cast("string"), "p_brand", "p_name").alias("name"))
    prefix = t.nation.where("n_nationkey = 3").agg(F.coalesce(F.min("n_name"), F.lit("wp_")).alias("p"))
    return graph.linked_tables(logical.unionByName(physical), prefix)


@query("""SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0""")
def union_distinct(t):
    """§2.11: a union without repeats."""
    return t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")).union(t.customer.where("c_acctbal < 0").select("c_custkey")).distinct()


@query("""SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal < 0""")
def intersect_distinct(t):
    """§2.11: what two tables share."""
    return t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")).intersect(t.customer.where("c_acctbal < 0").select("c_custkey"))


@query("""SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def except_distinct(t):
    """§2.11: what only the first table holds."""
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(t.orders.where("o_orderstatus = 'P'").select("o_custkey"))


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def vanished_rows(t):
    """§2.11: the difference by key, with all columns."""
    return relational.without(t.customer.select("c_custkey", "c_name"), t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("""SELECT p_partkey, p_size FROM part WHERE p_brand = 'Brand#11' OR p_size IS NULL OR p_size < 3""")
def own_or_global(t):
    """Rows of one project and those of none; P20: a limit within its bounds."""
    rows = t.part.withColumn("project", F.when(F.col("p_size") >= 3, F.col("p_brand")))
    return relational.scoped(rows, "Brand#11", globals_too=True).select("p_partkey", "p_size").limit(relational.clamp(10**9, 1, 10**8, 20))


@query("""SELECT o_custkey, o_orderkey, k <= 64 AS shown FROM (SELECT o_custkey, o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders WHERE o_orderpriority = '1-URGENT')  WHERE k <= 64""")
def first_flagged(t):
    """The first 64 of the flagged rows."""
    top = t.orders.where("o_orderpriority = '1-URGENT'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(64)
    return top.select("o_custkey", "o_orderkey", F.lit(True).alias("shown"))


@query("""SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS r FROM orders) WHERE r = 1""")
def latest_pass(t):
    """All rows of the latest pass of each plan."""
    w = t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("o_orderdate"))
    return t.orders.join(w, ["o_custkey", "o_orderdate"]).select("o_custkey", "o_orderkey")


# ---- graph ----------------------------------------------------------------------------------------------------


@query(f"""WITH p AS (SELECT p_partkey, {_PATH} AS path FROM part), d AS (SELECT o_orderkey, 'src/' || p_brand || '/' || p_name || '.py' AS f FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part) + 1 WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, p_name || '.py' FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part) + 1 WHERE o_orderstatus <> 'P')
SELECT DISTINCT o_orderkey AS decision, p_partkey AS node FROM d JOIN p ON p.path = d.f OR ends_with(p.path, '/' || d.f) WHERE o_orderkey % 7 <> 0""")
def decision_file_links(t):
    """Decisions that hold linked to the files they name, by path or its end, but for links that are there."""
    files = t.part.select(F.col("p_partkey").alias("node"), _path().alias("path"))
    n = t.part.count()
    named = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("decision"), (F.col("o_orderkey") % n + 1).alias("p_partkey")).join(t.part, "p_partkey")
    named = named.select("decision", F.explode(F.array(_path(), F.concat("p_name", F.lit(".py")))).alias("named"))
    return linkers.decision_files(named, files, t.orders.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("decision")))


@query(f"""WITH n AS (SELECT p_partkey AS id, 'r/' || p_brand AS root, {_PATH} AS rel FROM part WHERE p_size % 2 = 0), c AS (SELECT o_orderkey, 'r/Brand#' || (10 * (o_orderkey % 5 + 1) + o_custkey % 5 + 1) AS root, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate END, TIMESTAMP '2020-01-01') AS at FROM orders WHERE o_orderkey % 11 <> 0)
SELECT n.id, epoch_us(max(c.at)) AS last_touched FROM n JOIN (SELECT DISTINCT l_orderkey, {_PATH} AS path FROM lineitem JOIN part ON p_partkey = l_partkey) f ON f.path = n.rel JOIN c ON c.o_orderkey = f.l_orderkey AND c.root = n.root GROUP BY 1""")
def last_touched_by_owner(t):
    """When commits of a file's own repository, found by the longest root, last touched it; pruned commits do not count."""
    files = t.part.where("p_size % 2 = 0").select(F.col("p_partkey").alias("id"), F.concat(F.lit("r/"), "p_brand", F.lit("/"), _path()).alias("file_path"))
    roots = t.part.select(F.concat(F.lit("r/"), "p_brand").alias("root")).distinct()
    touched = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(t.part, "p_partkey").select(F.col("l_orderkey").alias("commit"), _path().alias("path"))
    commits = t.orders.select(F.col("o_orderkey").alias("commit"), F.concat(F.lit("r/Brand#"), (10 * (F.col("o_orderkey") % 5 + 1) + F.col("o_custkey") % 5 + 1).cast("string")).alias("root"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate")).alias("committed_at"))
    pruned = t.orders.where("o_orderkey % 11 = 0").select(F.col("o_orderkey").alias("commit"))
    own = commits.join(pruned, "commit", "left_anti").withColumn("at", F.coalesce("committed_at", F.lit("2020-01-01").cast("timestamp_ntz")))
    return linkers.last_touched(files, roots, touched, own).select("id", F.unix_micros(F.col("at").cast("timestamp")).alias("last_touched"))


@query("""SELECT l_partkey AS id, max(o_totalprice) AS confidence FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' AND l_returnflag <> 'R' GROUP BY 1""")
def node_confidence(t):
    """The greatest confidence of the decisions that hold and affect a node."""
    valid = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("decision"), F.col("o_totalprice").alias("confidence"))
    return linkers.node_confidence(t.lineitem.where("l_returnflag <> 'R'").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("decision")), valid)


@query("""SELECT p_brand AS subsystem, count(*) AS total, count(*) FILTER (WHERE p_size % 5 = 0 OR p_size % 7 = 0) AS stale FROM part GROUP BY 1""")
def repo_staleness(t):
    """Nodes of each subsystem, and those whose source has changed or is gone."""
    nodes = t.part.select(F.col("p_partkey").alias("id"), "p_brand", F.md5("p_name").alias("content_hash"))
    source = t.part.where("p_size % 7 <> 0").select(F.col("p_partkey").alias("id"), F.md5(F.when(F.col("p_size") % 5 == 0, F.upper("p_name")).otherwise(F.col("p_name"))).alias("content_hash"))
    return linkers.subsystem_staleness(linkers.staleness(nodes, source), "p_brand")


_REASONS = """concat_ws('; ', CASE WHEN edges >= 100 THEN 'traversal capped at 100 edges' END, CASE WHEN tables THEN 'public boundary affected: table' END, CASE WHEN repos > 1 THEN 'spans ' || repos || ' configured repositories' END,
 CASE WHEN dependents >= 20 THEN dependents || ' dependents (>= 20)' WHEN dependents >= 5 THEN dependents || ' dependents (>= 5)' END, CASE WHEN len(relations) >= 2 THEN len(relations) || ' distinct dependency relations (>= 2)' END,
 CASE WHEN reasoning > 0 THEN reasoning || ' linked decisions/lessons' END, CASE WHEN len(soft) > 0 THEN 'non-extracted edge confidence: ' || array_to_string(soft, ', ') END, CASE WHEN stale THEN 'a returned code node is stale or unattributed' END, CASE WHEN tables THEN 'participating DB schema is stale or never introspected' END)"""


@query(f"""WITH {_E}, {_N}, m AS (SELECT id, CASE kind WHEN 'supplier' THEN 'table' ELSE kind END AS kind, CASE WHEN length(name) % 2 = 0 THEN 'a/' ELSE 'a/b/' END AS root FROM n WHERE kind <> 'part' UNION ALL SELECT id, kind, NULL FROM n WHERE kind = 'part'),
h1 AS (SELECT * FROM (SELECT to_node AS seed, e.*, row_number() OVER (PARTITION BY to_node ORDER BY relation, from_node, to_node, id) AS r FROM e WHERE to_node IN (SELECT id FROM m)) WHERE r <= 100), k AS (SELECT seed, count(*) AS k FROM h1 GROUP BY 1), f1 AS (SELECT DISTINCT seed, from_node AS id FROM h1 WHERE from_node <> seed),
h2 AS (SELECT x.* FROM (SELECT f1.seed, e.*, row_number() OVER (PARTITION BY f1.seed ORDER BY e.relation, e.from_node, e.to_node, e.id) AS r FROM f1 JOIN e ON e.to_node = f1.id WHERE NOT EXISTS (SELECT 1 FROM h1 WHERE h1.seed = f1.seed AND h1.id = e.id)) x JOIN k ON k.seed = x.seed WHERE r <= 100 - k),
h AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2), found AS (SELECT id AS seed, id FROM m UNION SELECT seed, from_node FROM h), o AS (SELECT seed, count(*) AS edges, list_sort(list_distinct(list(relation))) AS relations, list_sort(list_distinct(list(confidence) FILTER (WHERE confidence <> 'EXTRACTED'))) AS soft FROM h GROUP BY 1),
p AS (SELECT seed, count(*) FILTER (WHERE m.id <> seed) AS dependents, bool_or(kind = 'table') AS tables, count(DISTINCT root) AS repos, bool_or(kind = 'part' AND substr(m.id, 3) IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size = 1)) AS stale FROM found JOIN m ON m.id = found.id GROUP BY 1),
d AS (SELECT seed, list(c_name ORDER BY c_custkey DESC) AS names FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY c_custkey DESC) AS r FROM found JOIN customer ON id = 'c:' || c_custkey WHERE c_acctbal < 0 AND c_custkey % 3 <> 0) WHERE r <= 20 GROUP BY 1),
l AS (SELECT seed, list_sort(list(rule)) AS rules FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY rule) AS r FROM (SELECT DISTINCT seed, 'rule ' || s_suppkey % 47 AS rule FROM found JOIN supplier ON id = 's:' || s_suppkey WHERE s_acctbal > 0 AND s_suppkey % 2 = 0)) WHERE r <= 20 GROUP BY 1),
g AS (SELECT p.*, coalesce(edges, 0) AS edges, coalesce(relations, []) AS relations, coalesce(soft, []) AS soft, coalesce(names, []) AS names, coalesce(rules, []) AS rules, len(coalesce(names, [])) + len(coalesce(rules, [])) AS reasoning FROM p LEFT JOIN o USING (seed) LEFT JOIN d USING (seed) LEFT JOIN l USING (seed))
SELECT seed AS id, dependents, edges, edges >= 100 AS capped, array_to_string(relations, ',') AS relations, repos, array_to_string(names, ',') AS decisions, array_to_string(rules, ',') AS lessons, CASE WHEN edges >= 100 OR tables OR repos > 1 OR dependents >= 20 THEN 'HIGH' WHEN dependents >= 5 OR len(relations) >= 2 OR reasoning > 0 OR len(soft) > 0 OR stale THEN 'MEDIUM' ELSE 'LOW' END AS risk,
CASE WHEN stale OR tables THEN 'LIMITED' ELSE 'SUFFICIENT' END AS confidence, coalesce(nullif({_REASONS}, ''), 'no boundary, cap, reasoning or staleness signal') AS reasons FROM g""")
def impact_report(t):
    """For every node what depends on it within two hops, at most 100 edges, over two repositories; the decisions and lessons on all that, and the risk of a change with its reasons."""
    e, nodes = _edges(t), _nodes(t)
    path = F.when(F.col("kind") != "part", F.concat(F.when(F.length("name") % 2 == 0, "a/").otherwise("a/b/"), F.col("name")))
    nodes = nodes.select("id", F.when(F.col("kind") == "supplier", "table").otherwise(F.col("kind")).alias("kind"), path.alias("file_path"))
    decisions = t.customer.select(_sid("c:", "c_custkey").alias("node"), F.when(F.col("c_custkey") % 3 == 0, "q").otherwise("p").alias("project"), F.col("c_name").alias("description"), F.col("c_mktsegment").alias("source"), F.col("c_custkey").alias("at"), (F.col("c_acctbal") < 0).alias("valid"))
    lessons = t.supplier.select(_sid("s:", "s_suppkey").alias("node"), F.when(F.col("s_suppkey") % 2 == 1, "q").alias("project"), F.concat(F.lit("rule "), (F.col("s_suppkey") % 47).cast("string")).alias("rule"), (F.col("s_acctbal") > 0).alias("valid"))
    roots = e.sparkSession.createDataFrame([("a",), ("a/b",)], "root string")
    stale = t.part.where("p_size = 1").select(_sid("p:", "p_partkey").alias("id"))
    out = graph.impact(nodes, e, nodes.select("id"), decisions, lessons, roots, "p", stale=stale, schema_stale=True)
    return out.select("id", "dependents", "edges", "capped", F.array_join("relations", ",").alias("relations"), "repos", F.array_join(F.transform("decisions", lambda x: x["description"]), ",").alias("decisions"), F.array_join("lessons", ",").alias("lessons"), "risk", "confidence", "reasons")


_TEXT = "nation_1"


@query(f"""WITH {_E}, {_N}, q AS (SELECT *, kind || '/' || name AS qn FROM n), hit AS (SELECT id, kind, qn, lower(name) = '{_TEXT}' OR lower(qn) = '{_TEXT}' AS exact, {_GRAMS.format("name")} AS a, {_GRAMS.format("qn")} AS b, {_GRAMS.format(f"'{_TEXT}'")} AS g FROM q WHERE contains(lower(name), '{_TEXT}') OR contains(lower(qn), '{_TEXT}')),
ranked AS (SELECT id, row_number() OVER (ORDER BY exact DESC, greatest(len(list_intersect(a, g)) / (len(a) + len(g) - len(list_intersect(a, g))), len(list_intersect(b, g)) / (len(b) + len(g) - len(list_intersect(b, g)))) DESC, kind, qn, id) AS place FROM hit), s AS (SELECT * FROM ranked WHERE place <= 7),
a AS (SELECT from_node FROM e JOIN n ON n.id = from_node WHERE relation = 'belongs_to' AND kind IN ('customer', 'supplier') AND to_node IN (SELECT id FROM s) ORDER BY relation, from_node, to_node, e.id LIMIT 100)
SELECT id, 0 AS step, CAST(place AS INTEGER) AS place FROM s UNION ALL SELECT DISTINCT from_node, 1, NULL FROM a""")
def graph_query_text(t):
    """A query that starts at all that a text names, the first seven of them: the one of that very name, then the most similar."""
    e, nodes = _edges(t), _nodes(t).withColumn("qualified_name", F.concat_ws("/", "kind", "name"))
    seeds, _ = graph.named_seeds(nodes, _TEXT, most=7)
    found = graph.traverse(nodes, e, seeds, [graph.Step("in", ("belongs_to",), ("customer", "supplier"))], 100)[0]
    return found.join(seeds.select("id", "place"), "id", "left").select("id", "step", "place")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' AND o_custkey % 5 <> 0 AND o_orderkey % 2 = 0 THEN 'head' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'old' ELSE 'head' END END AS commit_sha FROM orders""")
def restamped_nodes(t):
    """Commit stamps of one repository's nodes raised where they differ, those of nested ones not."""
    nodes = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "old").otherwise("head").alias("commit_sha"), (F.col("o_orderstatus") == "F").alias("ours"), (F.col("o_custkey") % 5 == 0).alias("nested"))
    return writes.restamped(nodes, "head", F.col("ours") & ~F.col("nested")).select("id", "commit_sha")


@query("""SELECT o.relation, role, CASE WHEN x IN ('php:class', 'tier2-go:function') THEN 'partial' END AS coverage, count(*) AS n FROM (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'emits' WHEN 1 THEN 'exports' WHEN 2 THEN 'scheduled_by' WHEN 3 THEN 'fk_to' ELSE 'mentions' END AS relation, CASE o_custkey % 4 WHEN 0 THEN 'php:class' WHEN 1 THEN 'tier2-go:class' WHEN 2 THEN 'tier2-go:function' ELSE 'ts:function' END AS x FROM orders) o LEFT JOIN (VALUES ('emits', 'use'), ('exports', 'ownership'), ('scheduled_by', 'root'), ('fk_to', 'context')) v(relation, role) ON v.relation = o.relation GROUP BY ALL""")
def relation_roles(t):
    """What relations say of their targets, and whether an extractor's silence on a kind counts."""
    k, j = F.col("o_orderkey") % 5, F.col("o_custkey") % 4
    rows = t.orders.select(
        F.when(k == 0, "emits").when(k == 1, "exports").when(k == 2, "scheduled_by").when(k == 3, "fk_to").otherwise("mentions").alias("relation"),
        F.when(j == 0, "php").when(j == 3, "ts").otherwise("tier2-go").alias("extractor"),
        F.when(j < 2, "class").otherwise("function").alias("kind"),
    )
    rows = rows.withColumns({"role": graph.role(F.col("relation")), "coverage": graph.coverage(F.col("extractor"), F.col("kind"))})
    return rows.groupBy("relation", "role", "coverage").agg(F.count(F.lit(1)).alias("n"))


# ---- writes ---------------------------------------------------------------------------------------------------


@query("""SELECT o_orderpriority AS relation, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1""")
def vocabulary_check(t):
    """Words outside a vocabulary."""
    return writes.unknown_words(t.orders.select(F.col("o_orderpriority").alias("relation")), "relation", ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query("""WITH o AS (SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'a' ELSE 'b' END AS extracted_by, CASE WHEN p_size % 2 = 0 THEN 'endpoint' ELSE 'file' END AS kind, p_name AS name FROM part), n AS (SELECT id, 'a' AS extracted_by, 'file' AS kind, upper(name) AS name FROM o WHERE id % 4 = 0), s AS (SELECT * FROM o WHERE extracted_by <> 'a' OR kind = 'endpoint')
SELECT id, coalesce(n.extracted_by, s.extracted_by) AS extracted_by, coalesce(n.kind, s.kind) AS kind, coalesce(n.name, s.name) AS name FROM s FULL JOIN n USING (id)""")
def extractor_splice(t):
    """One extractor's rows replaced, but for shared kinds."""
    old = t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 == 0, "a").otherwise("b").alias("extracted_by"), F.when(F.col("p_size") % 2 == 0, "endpoint").otherwise("file").alias("kind"), F.col("p_name").alias("name"))
    new = old.where("id % 4 = 0").select("id", F.lit("a").alias("extracted_by"), F.lit("file").alias("kind"), F.upper("name").alias("name"))
    return writes.splice(old, new, "a", ["id"], ["endpoint"])


@query("""WITH o AS (SELECT p_partkey AS id, p_brand AS file_path, p_name AS name FROM part WHERE p_brand <> 'Brand#12'), n AS (SELECT p_partkey AS id, p_brand AS file_path, upper(p_name) AS name FROM part WHERE p_brand = 'Brand#11' AND p_size % 2 = 0), s AS (SELECT * FROM o WHERE file_path <> 'Brand#11' OR id IN (SELECT id FROM n))
SELECT id, coalesce(n.file_path, s.file_path) AS file_path, coalesce(n.name, s.name) AS name FROM s FULL JOIN n USING (id)""")
def file_splice(t):
    """Rows of changed and deleted files replaced."""
    old = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("file_path"), F.col("p_name").alias("name"))
    new = old.where("file_path = 'Brand#11'").join(t.part.where("p_size % 2 = 0").select(F.col("p_partkey").alias("id")), "id", "left_semi").select("id", "file_path", F.upper("name").alias("name"))
    name = lambda b: old.sparkSession.createDataFrame([(b,)], "file_path string")
    return writes.splice_files(old, new, name("Brand#11"), name("Brand#12"), ["id"])


@query("""WITH f AS (SELECT p_brand, min(p_partkey) AS k FROM part GROUP BY 1) SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 AND NOT (p_partkey = k) THEN md5('own' || p_partkey) ELSE md5(p.p_brand) END AS content_hash FROM part p JOIN f USING (p_brand)""")
def hash_backfill(t):
    """Nodes without a content hash take their file's."""
    first = t.part.groupBy("p_brand").agg(F.min("p_partkey").alias("k"))
    is_file = F.col("p_partkey") == F.col("k")
    nodes = t.part.join(first, "p_brand").select(F.col("p_partkey").alias("id"), F.when(is_file, "file").otherwise("symbol").alias("kind"), F.col("p_brand").alias("file_path"), F.when(is_file, F.md5("p_brand")).when(F.col("p_partkey") % 3 == 0, F.md5(_sid("own", "p_partkey"))).alias("content_hash"))
    return writes.filled_hashes(nodes).select("id", "content_hash")


@query("""SELECT 'c' || o_custkey AS from_node, 'o' || o_orderkey AS to_node FROM orders JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 WHERE o_orderkey % 5 <> 0""")
def edge_resolution(t):
    """Ends named by kind and name become ids; those that nothing has are dropped."""
    names = t.customer.where("c_acctbal > 0").select(F.lit("customer").alias("kind"), F.col("c_name").alias("qualified_name"), _sid("c", "c_custkey").alias("id"))
    names = names.unionByName(t.orders.where("o_orderkey % 5 <> 0").select(F.lit("order").alias("kind"), _sid("order ", "o_orderkey").alias("qualified_name"), _sid("o", "o_orderkey").alias("id")))
    edges = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.lit("customer").alias("from_kind"), F.col("c_name").alias("from_name"), F.lit("order").alias("to_kind"), _sid("order ", "o_orderkey").alias("to_name"), F.lit("placed").alias("relation"))
    return writes.resolved(edges, names)[0].select("from_node", "to_node")


@query("""SELECT 'e' || p_partkey AS id FROM part WHERE p_size % 2 = 0 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) UNION ALL SELECT 't' || p_partkey FROM part WHERE p_size % 2 = 1 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 5)""")
def orphan_sweep(t):
    """Endpoints that no route serves, and other shared nodes without any edge."""
    even = F.col("p_size") % 2 == 0
    nodes = t.part.select(F.concat(F.when(even, "e").otherwise("t"), F.col("p_partkey").cast("string")).alias("id"), F.when(even, "endpoint").otherwise("table").alias("kind"))
    edge = lambda where, rel, to: t.lineitem.where(where).select(F.lit(rel).alias("relation"), F.lit("f").alias("from_node"), _sid(to, "l_partkey").alias("to_node"))
    edges = edge("l_quantity > 45", "serves_route", "e").unionByName(edge("l_quantity > 10", "mentions", "e")).unionByName(edge("l_quantity < 5", "references_table", "t"))
    return writes.orphans(nodes, edges, ["endpoint", "table"]).select("id")


@query("""SELECT c_custkey AS id, 'a' AS project, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS name FROM customer""")
def guarded_upsert(t):
    """An upsert that refuses rows of another project."""
    old = t.customer.select(F.col("c_custkey").alias("id"), F.lit("a").alias("project"), F.col("c_name").alias("name"))
    return writes.upsert_guarded(old, old.where("id % 2 = 0").withColumn("name", F.upper("name")), ["id"])


@query("""WITH o AS (SELECT o_custkey AS a, o_orderkey AS b, CASE WHEN o_orderkey % 2 = 0 THEN 'old' END AS note FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_custkey AS a, o_orderkey AS b, CASE WHEN o_orderkey % 5 = 0 THEN 'new' END AS note FROM orders WHERE o_orderkey % 4 < 2)
SELECT a AS from_id, b AS to_id, coalesce(n.note, o.note) AS note FROM o FULL JOIN n USING (a, b)""")
def edge_additions(t):
    """Links added; one that is there keeps its note unless a new one is given."""
    link = lambda d, note: d.select(F.lit("customer").alias("from_kind"), F.col("o_custkey").alias("from_id"), F.lit("order").alias("to_kind"), F.col("o_orderkey").alias("to_id"), F.lit("placed").alias("relation"), note.alias("note"))
    old = link(t.orders.where("o_orderkey % 3 <> 0"), F.when(F.col("o_orderkey") % 2 == 0, "old"))
    new = link(t.orders.where("o_orderkey % 4 < 2"), F.when(F.col("o_orderkey") % 5 == 0, "new"))
    known = t.orders.select(F.lit("customer").alias("kind"), F.col("o_custkey").alias("id")).distinct().unionByName(t.orders.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id")))
    return writes.add_edges(old, new, known).select("from_id", "to_id", "note")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'c' || o_custkey END AS superseded_by, o_orderkey % 4 = 1 AS retired, CASE WHEN o_orderkey % 4 = 2 THEN NULL ELSE 'p' || o_custkey % 7 END AS project FROM orders""")
def lesson_states(t):
    """Lessons superseded, retired or made global."""
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("p"), (F.col("o_custkey") % 7).cast("string")).alias("project"), F.lit(None).cast("string").alias("superseded_by"), F.lit(None).cast("timestamp_ntz").alias("retired_at"))
    from ..operators import records

    by = t.orders.where("o_orderkey % 4 in (0, 1)").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 == 0, _sid("c", "o_custkey")).alias("successor"))
    out = records.superseded(records.globalized(rows, t.orders.where("o_orderkey % 4 = 2").select(F.col("o_orderkey").alias("id"))), by, NOW)
    return out.select("id", "superseded_by", F.col("retired_at").isNotNull().alias("retired"), "project")


@query("""SELECT o_orderkey AS share_id, o_custkey AS project, CASE WHEN o_orderkey % 3 = 0 THEN 'revoked' ELSE 'granted' END AS state, 1 + CAST(o_orderkey % 3 = 0 AS INTEGER) AS events FROM orders""")
def share_grants(t):
    """Shares granted and revoked, with one event for each change."""
    from ..operators import records

    granted = t.orders.select(F.col("o_orderkey").alias("share_id"), F.col("o_custkey").alias("project"), F.lit("granted").alias("action"), F.lit(1).alias("at"))
    revoked = granted.where("share_id % 3 = 0").withColumns({"action": F.lit("revoked"), "at": F.lit(2)})
    again = revoked.where("share_id % 2 = 0").withColumn("at", F.lit(3))
    return records.share_states(granted.unionByName(revoked).unionByName(again))


@query("""SELECT o_custkey AS plan, o_orderkey AS review, CAST(p AS INTEGER) AS pass, n AS findings, r AS recurring FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders) JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def review_posts(t):
    """Reviews with their pass, findings, and those that recur."""
    from ..operators import records

    reviews = t.orders.select(F.col("o_custkey").alias("plan"), F.col("o_orderkey").alias("review"), F.col("o_orderdate").alias("at"))
    findings = t.lineitem.select(F.col("l_orderkey").alias("review"), (F.col("l_returnflag") == "R").alias("recurs"))
    return records.posted_reviews(reviews, findings)


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'p' || c_nationkey END AS project, c_custkey % 5 = 0 AS retracted FROM customer WHERE c_custkey % 4 <> 0 OR c_custkey % 3 = 0""")
def fact_changes(t):
    """Facts added once, promoted to all projects, retracted."""
    from ..operators import records

    facts = t.customer.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("id"), _sid("p", "c_nationkey").alias("project"), F.lit(False).alias("retracted"))
    added = t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), _sid("p", "c_nationkey").alias("project"), F.lit(False).alias("retracted"))
    promote, retract = (t.customer.where(f"c_custkey % {k} = 0").select(F.col("c_custkey").alias("id")) for k in (3, 5))
    return records.changed_facts(facts, added, promote, retract)


@query("""SELECT md5(string_agg(p_brand || ':' || n, '|' ORDER BY p_brand)) AS state FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)""")
def schema_state(t):
    """One hash of ordered identities."""
    rows = t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).select("p_brand", F.concat_ws(":", "p_brand", F.col("n").cast("string")).alias("s"))
    return rows.agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_brand", "s"))), lambda x: x["s"]), "|")).alias("state"))


# ---- retrieval ------------------------------------------------------------------------------------------------

_SIM = "len(list_intersect({0}, {1})) / (len({0}) + len({1}) - len(list_intersect({0}, {1})))"


def _lessons(t):
    rows = t.part.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" "), "p_type").alias("rule"), F.array((F.col("p_size") % 3 + 1).cast("double"), F.lit(1.0)).alias("embedding"), F.when(F.col("p_partkey") % 2 == 0, "m").otherwise("old").alias("embedding_model"))
    new = t.part.where("p_partkey % 40 = 0").select(F.col("p_partkey").alias("new_id"), F.concat("p_name", F.lit(" "), "p_type").alias("rule"), F.when(F.col("p_partkey") % 80 == 0, F.array(F.lit(1.0), F.lit(-0.5))).otherwise(F.array(F.lit(1.0), F.lit(1.0))).alias("vector"))
    return rows, new


_COS2 = "((CAST(p_size % 3 + 1 AS DOUBLE) * vx + vy) / (sqrt(CAST(p_size % 3 + 1 AS DOUBLE) * CAST(p_size % 3 + 1 AS DOUBLE) + 1) * sqrt(vx * vx + vy * vy)))"


@query(f"""WITH l AS (SELECT p_partkey AS id, p_size, p_partkey % 2 = 0 AS cur, {_GRAMS.format("(p_name || ' ' || p_type)")} AS g FROM part), q AS (SELECT id AS new_id, g AS h, 1.0::DOUBLE AS vx, CASE WHEN id % 80 = 0 THEN -0.5 ELSE 1.0 END::DOUBLE AS vy FROM l WHERE id % 40 = 0),
s AS (SELECT new_id, id, cur, {_SIM.format("g", "h")} AS s, {_COS2} AS cs FROM q, l), c AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY s DESC, id) AS k FROM s WHERE s >= 0.5), b AS (SELECT * FROM c WHERE k <= 5),
sem AS (SELECT new_id, max_by(id, (cs, -k)) AS id FROM b WHERE cur AND cs >= 0.66 GROUP BY 1), st AS (SELECT new_id, min_by(id, k) AS id, min_by(s, k) AS s FROM b WHERE NOT cur GROUP BY 1)
SELECT new_id, id, 'cosine' AS "by" FROM sem UNION ALL SELECT new_id, id, 'trigram' FROM st WHERE s >= 0.8 AND new_id NOT IN (SELECT new_id FROM sem)""")
def lesson_dedup_match(t):
    """Which lesson each new one repeats, by the closed matrix of current, stale and rejected rows."""
    rows, new = _lessons(t)
    return writes.dedup_match(rows, new, "m")


@query(f"""WITH a AS (SELECT 'plan' AS source, p_partkey AS id, p_name AS txt FROM part WHERE p_size > 10 UNION ALL SELECT 'code', c_custkey, c_name FROM customer WHERE c_acctbal > 0) SELECT source, id, round(s, 6) AS score FROM (SELECT source, id, {_SIM.format(_GRAMS.format("txt"), _GRAMS.format("'small ring customer'"))} AS s FROM a) WHERE s >= 0.15 ORDER BY s DESC, source, id LIMIT 30""")
def finding_recall(t):
    """Findings of plans and of code by similarity, as one list."""
    plan = t.part.where("p_size > 10").select(F.lit("plan").alias("source"), F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    code = t.customer.where("c_acctbal > 0").select(F.lit("code").alias("source"), F.col("c_custkey").alias("id"), F.col("c_name").alias("text"))
    score = tx.similarity(F.col("text"), F.lit("small ring customer"))
    return plan.unionByName(code).withColumn("s", score).where("s >= 0.15").orderBy(F.desc("s"), "source", "id").limit(30).select("source", "id", F.round("s", 6).alias("score"))


@query("""SELECT c_custkey AS id, c_acctbal AS score FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') ORDER BY c_acctbal DESC, c_custkey LIMIT 25""")
def retain_current(t):
    """The best whose source is current."""
    return retrieval.current_first(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score")), t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")), 25)


@query(f"""WITH l AS (SELECT p_partkey, {_GRAMS.format("p_name")} AS g FROM part), q AS (SELECT s_suppkey, {_GRAMS.format("('small ring number ' || s_suppkey)")} AS h FROM supplier) SELECT s_suppkey, p_partkey, CAST(k AS INTEGER) AS place FROM (SELECT s_suppkey, p_partkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY s DESC, p_partkey) AS k FROM (SELECT s_suppkey, p_partkey, {_SIM.format("g", "h")} AS s FROM q, l) WHERE s >= 0.25) WHERE k <= 3""")
def write_preview(t):
    """The three records most like each thing about to be written."""
    new = t.supplier.select("s_suppkey", F.concat(F.lit("small ring number "), F.col("s_suppkey").cast("string")).alias("text"))
    near = retrieval.most_similar(new, t.part.select("p_partkey", "p_name"), 0.25, 3, "s_suppkey", "text", "p_partkey", "p_name")
    return near.select("s_suppkey", "p_partkey", F.col("rank").alias("place"))


@query("""WITH a AS (SELECT 'part' AS kind, p_partkey AS id, row_number() OVER (ORDER BY p_partkey DESC) AS k FROM part WHERE p_name ILIKE '%ring%'), b AS (SELECT 'customer' AS kind, c_custkey AS id, row_number() OVER (ORDER BY c_custkey DESC) AS k FROM customer WHERE c_mktsegment ILIKE '%build%') SELECT kind, id FROM a WHERE k <= 20 UNION ALL SELECT kind, id FROM b WHERE k <= 20""")
def share_candidates(t):
    """The newest twenty of each kind that hold a text."""
    pick = lambda df, kind, key, text, like: df.where(F.col(text).ilike(f"%{like}%")).orderBy(F.desc(key)).limit(20).select(F.lit(kind).alias("kind"), F.col(key).alias("id"))
    return pick(t.part, "part", "p_partkey", "p_name", "ring").unionByName(pick(t.customer, "customer", "c_custkey", "c_mktsegment", "build"))


@query(f"""WITH p AS (SELECT p_partkey AS id, {_SIM.format(_GRAMS.format("p_name"), _GRAMS.format("'small ring'"))} AS s, contains(lower(p_name), 'small ring') AS lit FROM part) SELECT id, round(s, 6) AS score FROM p WHERE s >= 0.15 OR lit ORDER BY s DESC, id LIMIT 40""")
def lexical_code_search(t):
    """Names like a text, or that hold it."""
    rows = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    return retrieval.by_trigrams(rows, "small ring", 0.15, 40, literal=True).select("id", F.round("score", 6).alias("score"))


@query("""SELECT c_custkey AS claim, p_partkey AS file FROM customer JOIN part ON p_brand || '/' || p_name = c_mktsegment OR starts_with(p_brand || '/' || p_name, 'Brand#' || (c_custkey % 60) || '/') WHERE c_acctbal > 0 AND c_custkey % 24 < 8""")
def claim_matches(t):
    """Claims that are active, of a fresh heartbeat, and hold a file by a path prefix."""
    claims = t.customer.where("c_acctbal > 0 and c_custkey % 24 < 8").select(F.col("c_custkey").alias("claim"), F.concat(F.lit("Brand#"), (F.col("c_custkey") % 60).cast("string")).alias("root"))
    files = t.part.select(F.col("p_partkey").alias("file"), "p_brand", "p_name")
    return linkers.claimed_files(claims, files, F.concat("p_brand", F.lit("/"), "p_name"))


@query("""SELECT event_id, CASE WHEN v IS NULL OR v < 0 THEN '?' WHEN v >= 1000000 THEN '≥1M' ELSE CAST(v AS VARCHAR) END AS shown FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN -1 WHEN 1 THEN event_id WHEN 2 THEN 999999 WHEN 3 THEN 1000000 + event_id END AS v FROM events)""")
def display_counts(t):
    """Counts for display."""
    m = F.col("event_id") % 5
    v = F.when(m == 0, F.lit(-1)).when(m == 1, F.col("event_id")).when(m == 2, F.lit(999_999)).when(m == 3, F.col("event_id") + 1_000_000)
    return t.events.select("event_id", tx.short_count(v).alias("shown"))


@query("""SELECT doc_id, CASE WHEN len(w) <= 7 THEN array_to_string(w, ' ') ELSE array_to_string(list_concat(w[1:4], w[len(w) - 2:]), ' ') END AS words FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""")
def middle_trimmed(t):
    """Head and tail of long lists, the odd place to the head."""
    return t.documents.select("doc_id", F.array_join(tx.middle_trim(F.split("text", " "), 7), " ").alias("words"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS minute, greatest(1, CAST(floor((o_orderkey % 7200) * 1000 / 60000.0 + 0.5) AS BIGINT)) AS minutes FROM orders""")
def moments(t):
    """§2.14: moments to the minute, and spans in whole minutes."""
    end = F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_orderkey") % 7200)
    return t.orders.select("o_orderkey", tx.minute(F.col("o_orderdate")).alias("minute"), tx.duration_minutes(F.col("o_orderdate"), end).alias("minutes"))


# ---- reads ----------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '2-HIGH' AND list_has_any(['s' || o_orderstatus, 'c' || (o_custkey % 10)], ['sF', 'c3']) ORDER BY o_orderdate DESC, o_orderkey LIMIT 30""")
def decisions_by_tags(t):
    """§2.15: decisions of a type that carry one of the tags, newest first."""
    tags = F.array(F.concat(F.lit("s"), "o_orderstatus"), F.concat(F.lit("c"), (F.col("o_custkey") % 10).cast("string")))
    rows = retrieval.by_keywords(relational.optional(t.orders, o_orderpriority="2-HIGH").withColumn("keywords", tags), ["sF", "c3"], False)
    return rows.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(30).select("o_orderkey", "o_orderpriority")


@query("""SELECT user_id, n, minutes FROM (SELECT user_id, count(*) AS n, greatest(1, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0 + 0.5) AS BIGINT)) AS minutes, min(ts) AS started FROM events GROUP BY 1) ORDER BY started DESC, user_id LIMIT 20""")
def recent_sessions(t):
    """§2.15, A24: the newest sessions with their size and length."""
    s = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended"))
    return s.orderBy(F.desc("started"), "user_id").limit(20).select("user_id", "n", tx.duration_minutes(F.col("started"), F.col("ended")).alias("minutes"))


@query("""SELECT band, id, CAST(place AS INTEGER) AS place, total FROM (SELECT c_mktsegment AS band, c_custkey AS id, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS place, count(*) OVER (PARTITION BY c_mktsegment) AS total FROM customer WHERE c_nationkey <> 3) WHERE place <= 10""")
def ideas_board(t):
    """§2.15: the first ten ideas of each band, and how many there are."""
    rows = t.customer.where("c_nationkey <> 3").select(F.col("c_mktsegment").alias("band"), F.col("c_custkey").alias("id"), "c_acctbal")
    top = relational.top_of(rows, ["band"], [F.desc("c_acctbal"), F.col("id")], 10, "place")
    return top.join(rows.groupBy("band").agg(F.count(F.lit(1)).alias("total")), "band").select("band", "id", "place", "total")


@query("""SELECT c_custkey AS id, c_nationkey IS NULL OR c_nationkey % 5 = 0 AS global FROM customer WHERE (c_nationkey = 7 OR c_nationkey % 5 = 0) AND c_acctbal >= 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 50""")
def facts_list(t):
    """§2.15: facts of a project and of all, without those retracted."""
    rows = t.customer.where("c_acctbal >= 0").withColumn("project", F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey").cast("string")))
    return relational.scoped(rows, "7", globals_too=True).orderBy(F.desc("c_acctbal"), "c_custkey").limit(50).select(F.col("c_custkey").alias("id"), F.col("project").isNull().alias("global"))


@query("""SELECT l_orderkey AS plan, l_linenumber AS number, l_returnflag AS severity FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linestatus = 'O' AND l_returnflag = 'N' AND o_custkey % 4 = 1 ORDER BY l_orderkey, l_linenumber LIMIT 60""")
def findings_query(t):
    """§2.15: open findings of a severity in a project's plans."""
    plans = t.orders.where("o_custkey % 4 = 1").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = relational.optional(t.lineitem, l_linestatus="O", l_returnflag="N").join(plans, "l_orderkey", "left_semi")
    return rows.orderBy("l_orderkey", "l_linenumber").limit(60).select(F.col("l_orderkey").alias("plan"), F.col("l_linenumber").alias("number"), F.col("l_returnflag").alias("severity"))


@query("""SELECT o_custkey AS plan, o_orderkey AS review, o_orderstatus AS verdict, CAST(p AS INTEGER) AS pass FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders)""")
def plan_reviews(t):
    """§2.15: reviews of each plan by pass."""
    out = relational.numbered(t.orders, [F.col("o_orderdate"), F.col("o_orderkey")], "pass", ["o_custkey"])
    return out.select(F.col("o_custkey").alias("plan"), F.col("o_orderkey").alias("review"), F.col("o_orderstatus").alias("verdict"), "pass")


@query("""SELECT DISTINCT a.l_orderkey AS id, b.l_orderkey AS earlier FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND b.l_shipdate < a.l_shipdate WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'R' AND a.l_orderkey <> b.l_orderkey""")
def recurrence_links(t):
    """§2.15: findings that say the same as earlier ones, each with all of these."""
    return linkers.earlier_ones(t.lineitem.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey", "l_orderkey", "l_shipdate"), ["l_partkey", "l_suppkey"], "l_orderkey", "l_shipdate")


@query("""SELECT event_id AS id, user_id AS thread FROM events WHERE event_type = 'view' AND user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING max(ts) >= TIMESTAMP '2024-01-20') ORDER BY ts DESC, event_id LIMIT 40""")
def board_read(t):
    """§2.15: the newest notes of threads that are still alive."""
    alive = t.events.groupBy("user_id").agg(F.max("ts").alias("last")).where(F.col("last") >= F.lit("2024-01-20").cast("timestamp_ntz")).select("user_id")
    rows = t.events.where("event_type = 'view'").join(alive, "user_id", "left_semi")
    return rows.orderBy(F.desc("ts"), "event_id").limit(40).select(F.col("event_id").alias("id"), F.col("user_id").alias("thread"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 24 >= 8 THEN 'expired' ELSE 'active' END AS state FROM customer WHERE c_acctbal > 0""")
def claims_list(t):
    """§2.15, W32: claims that were not released, by whether their heartbeat is fresh."""
    beat = F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(hours=(F.col("c_custkey") % 24).cast("int"))
    rows = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), beat.alias("heartbeat_at"))
    return linkers.fresh_claims(rows, F.lit(NOW).cast("timestamp_ntz")).select("id", "state")


@query("""SELECT s_nationkey AS project, string_agg('- ' || s_name, chr(10) ORDER BY s_acctbal DESC, s_suppkey) AS rules FROM supplier WHERE s_acctbal > 0 GROUP BY 1""")
def graduated_rules(t):
    """§2.15: the rules of each project as one text, the surest first."""
    rows = t.supplier.where("s_acctbal > 0").select("s_nationkey", F.struct((-F.col("s_acctbal")).alias("a"), "s_suppkey", F.concat(F.lit("- "), "s_name").alias("line")).alias("r"))
    return rows.groupBy(F.col("s_nationkey").alias("project")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n").alias("rules"))


@query("""WITH s AS (SELECT 'a' AS section, 0 AS place, o_orderkey AS ord, CAST(o_orderkey AS VARCHAR) AS txt FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5) UNION ALL SELECT 'b', 1, c_custkey, c_name FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 30) UNION ALL SELECT 'c', 2, p_partkey, p_name FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20)) SELECT section, CAST(place AS INTEGER) AS place, ord, txt AS text FROM s""")
def prime_sections(t):
    """§2.15: the start of a session: several reads as sections of one answer."""
    a = t.orders.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(5).select(F.col("o_orderkey").alias("ord"), F.col("o_orderkey").cast("string").alias("text"))
    b = t.customer.orderBy(F.desc("c_acctbal"), "c_custkey").limit(30).select(F.col("c_custkey").alias("ord"), F.col("c_name").alias("text"))
    c = t.part.orderBy(F.desc("p_retailprice"), "p_partkey").limit(20).select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("text"))
    return budget.sections([("a", a), ("b", b), ("c", c)], "text", "ord").select("section", "place", "ord", "text")


@query("""SELECT event_type AS tool, count(*) AS calls, CAST(sum(length(props)) AS BIGINT) AS chars FROM events GROUP BY 1""")
def shadow_totals(t):
    """What each tool has cost."""
    return t.events.groupBy(F.col("event_type").alias("tool")).agg(F.count(F.lit(1)).alias("calls"), F.sum(F.length("props")).alias("chars"))


@query("""SELECT coalesce(c.event_type, 'unknown') AS tool, count(*) AS results, CAST(sum(length(r.props)) AS BIGINT) AS chars FROM events r LEFT JOIN (SELECT event_id, event_type FROM events WHERE event_type <> 'error') c ON c.event_id = r.event_id - 1 WHERE r.event_id % 2 = 1 GROUP BY 1""")
def tool_result_chars(t):
    """Characters of tool results by the call they answer; those that answer none are unknown."""
    calls = t.events.where("event_type <> 'error'").select((F.col("event_id") + 1).alias("event_id"), F.col("event_type").alias("call"))
    rows = t.events.where("event_id % 2 = 1").select("event_id", "props").join(calls, "event_id", "left")
    return rows.groupBy(F.coalesce("call", F.lit("unknown")).alias("tool")).agg(F.count(F.lit(1)).alias("results"), F.sum(F.length("props")).alias("chars"))


@query("""WITH o AS (SELECT user_id, event_id, ts, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value FROM events), d AS (SELECT *, lag(k) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM o) SELECT user_id, CASE WHEN count(*) FILTER (WHERE value IS NULL) = 0 THEN CAST(count(*) AS BIGINT) END AS requests, round(sum(value), 4) AS total FROM d WHERE before IS NULL OR before <> k GROUP BY 1""")
def cumulative_usage(t):
    """Usage in which a cumulative key that repeats the one before it is dropped."""
    from ..operators import curation

    rows = t.events.select("user_id", "event_id", "ts", F.get_json_object("props", "$.k").cast("int").alias("k"), "value")
    return curation.without_repeats(rows, "user_id", ["ts", "event_id"], "k").groupBy("user_id").agg(F.when(F.count_if(F.col("value").isNull()) == 0, F.count(F.lit(1))).alias("requests"), F.round(F.sum("value"), 4).alias("total"))
