"""Named queries over code facts, claims, tool calls, pages and rewritten history, each with the SQL it is held against (see catalog)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import budget, evidence, resolution, writes
from ..streaming import claims, pairing
from .catalog import NOW, query

# ---- two-pass extraction --------------------------------------------------------------------------------------

_FACTS = """d AS (SELECT source AS repo, 'd' || doc_id AS path, doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[A-Za-z]')) AS lines, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS before FROM documents),
l AS (SELECT repo, path, before, unnest(lines) AS line FROM d), w AS (SELECT *, lower(regexp_extract(line, '[A-Za-z]+')) AS head, lower(regexp_extract(line, '([A-Za-z]+)[^A-Za-z]*$', 1)) AS tail FROM l)"""


def _lines(t):
    rows = t.documents.select(F.col("source").alias("repo"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike("[A-Za-z]"))
    return rows.select("repo", "path", "doc_id", F.lower(F.regexp_extract("line", "[A-Za-z]+", 0)).alias("head"), F.lower(F.regexp_extract("line", "([A-Za-z]+)[^A-Za-z]*$", 1)).alias("tail"))


def _facts(t):
    """Documents as files: a line's first word is declared, its last is called; each file takes the words that it calls from the file before it in its source."""
    from pyspark.sql import Window

    lines = _lines(t)
    before = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.lag("doc_id").over(Window.partitionBy("source").orderBy("doc_id")).alias("before"))
    text, none = lambda x: F.lit(x).alias, F.array().cast("array<string>")
    common = [F.lit("").alias("scope"), F.lit("file").alias("outer"), F.lit("").alias("klass")]
    rest = [none.alias("candidates"), F.lit(None).cast("int").alias("arity"), F.lit(1).alias("line")]
    declares = lines.select("repo", "path", text("declares")("fact"), *common, F.col("head").alias("name"), text("function")("kind"), text("")("receiver"), text("")("target"), *rest)
    calls = lines.select("repo", "path", text("calls")("fact"), *common, F.col("tail").alias("name"), text("")("kind"), text("")("receiver"), text("")("target"), *rest)
    words = lines.select("repo", "path", "tail").distinct().join(before.where("before is not null"), "path")
    imports = words.select("repo", "path", text("imports")("fact"), *common, F.col("tail").alias("name"), text("path")("kind"), text("")("receiver"), F.col("tail").alias("target"), F.array(F.concat(F.lit("d"), F.col("before").cast("string"))).alias("candidates"), *rest[1:])
    return declares.unionByName(calls).unionByName(imports)


@query(f"""WITH RECURSIVE {_FACTS}, own AS (SELECT DISTINCT repo, path, head AS name, path || '::' || head AS id FROM w), asks AS (SELECT DISTINCT repo, path, tail AS name, 'd' || before AS file FROM w WHERE before IS NOT NULL),
known AS (SELECT * FROM own UNION SELECT a.repo, a.path, a.name, k.id FROM known k JOIN asks a ON a.repo = k.repo AND a.file = k.path AND a.name = k.name), means AS (SELECT repo, path, name, count(*) AS n, min(id) AS id FROM known GROUP BY ALL),
c AS (SELECT repo, path, tail AS name, count(*) AS times FROM w GROUP BY ALL), r AS (SELECT c.path, times, CASE WHEN m.n > 1 THEN 'ambiguous' WHEN m.n = 1 THEN 'resolved' ELSE 'external' END AS status FROM c LEFT JOIN means m ON m.repo = c.repo AND m.path = c.path AND m.name = c.name)
SELECT path, status, CAST(sum(times) AS BIGINT) AS n FROM r GROUP BY ALL""")
def call_resolution(t):
    """Calls of documents as files: what of them is resolved, over chains of imports, ambiguous or external."""
    files = t.documents.select(F.col("source").alias("repo"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"))
    found = resolution.by_scope(_facts(t), files)
    return found.tally.where("relation = 'calls'").select("path", "status", "n")


@query(f"""WITH {_FACTS}, k AS (SELECT repo, name, count(*) AS n, min(id) AS id FROM (SELECT DISTINCT repo, head AS name, repo || '#' || head AS id FROM w) GROUP BY ALL), c AS (SELECT repo, path, tail AS name, count(*) AS times FROM w GROUP BY ALL)
SELECT path AS from_id, id AS to_id, times AS n FROM c JOIN k USING (repo, name) WHERE k.n = 1 AND id <> path""")
def shared_names(t):
    """Calls that are resolved by name in the whole repository, where a declaration may stand in any file."""
    files = t.documents.select(F.col("source").alias("repo"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"))
    found = resolution.by_name(_facts(t).where("fact <> 'imports'"), files)
    return found.edges.where("relation = 'calls'").select("from_id", "to_id", "n")


# ---- claims and tool calls ------------------------------------------------------------------------------------

_HOURS = 12


def _claim_events(t):
    action = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type").isin("view", "click"), "beat").when(F.col("event_type") == "purchase", "release")
    rows = t.events.select(F.concat(F.lit("r"), (F.col("user_id") % 7).cast("string")).alias("repo"), F.col("ts").cast("timestamp").alias("at"), action.alias("action"), F.when(action == "create", F.concat(F.lit("c"), F.col("event_id").cast("string"))).alias("claim"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session"))
    return rows.where("action is not null")


@query(f"""WITH e AS (SELECT 'r' || user_id % 7 AS repo, ts AS tm, CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'release' ELSE 'beat' END AS action, event_id, user_id FROM events WHERE event_type <> 'error' AND ts <= TIMESTAMP '{NOW}'),
s AS (SELECT c.repo, 'c' || c.event_id AS claim, c.user_id, c.tm AS created_at, x.tm, x.action FROM e c JOIN e x ON x.user_id = c.user_id AND x.tm >= c.tm AND (x.action <> 'create' OR x.event_id = c.event_id) WHERE c.action = 'create'),
g AS (SELECT *, lag(tm) OVER (PARTITION BY claim ORDER BY tm, action DESC) AS before FROM s), x AS (SELECT *, coalesce(tm > before + INTERVAL {_HOURS} HOUR, false) AS gap FROM g), y AS (SELECT *, CASE WHEN gap THEN before + INTERVAL {_HOURS} HOUR WHEN action = 'release' THEN tm END AS stop FROM x),
z AS (SELECT *, min(stop) OVER (PARTITION BY claim) AS first FROM y), k AS (SELECT claim, any_value(repo) AS repo, any_value(user_id) AS user_id, any_value(created_at) AS created_at, any_value(first) AS first, bool_or(gap AND stop = first) AS late, max(CASE WHEN gap THEN before ELSE tm END) FILTER (WHERE gap OR action <> 'release') AS beat_at FROM z WHERE first IS NULL OR tm <= first OR stop = first GROUP BY claim)
SELECT repo, claim, 's' || user_id AS session, CASE WHEN first IS NULL AND beat_at + INTERVAL {_HOURS} HOUR < TIMESTAMP '{NOW}' THEN 'expired' WHEN first IS NULL THEN 'active' WHEN late THEN 'expired' ELSE 'released' END AS status, epoch_us(beat_at) AS beat_us,
epoch_us(CASE WHEN first IS NULL AND beat_at + INTERVAL {_HOURS} HOUR < TIMESTAMP '{NOW}' THEN beat_at + INTERVAL {_HOURS} HOUR ELSE first END) AS ended_us FROM k""")
def claims_at(t):
    """How each claim stands at a moment, after creations, refreshes, releases and the time that has passed."""
    out = claims.claim_states(_claim_events(t), NOW, _HOURS)
    return out.select("repo", "claim", "session", "status", F.unix_micros("beat_at").alias("beat_us"), F.unix_micros("ended_at").alias("ended_us"))


@query("""WITH c AS (SELECT user_id, event_id // 2 AS k, min(ts) AS at FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY ALL), r AS (SELECT user_id, (event_id + 1) // 2 AS k, min(ts) AS at FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY ALL),
j AS (SELECT c.user_id AS cu, c.k AS ck, c.at AS ca, r.user_id AS ru, r.k AS rk, r.at AS ra FROM c FULL JOIN r ON c.user_id = r.user_id AND c.k = r.k AND r.at BETWEEN c.at AND c.at + INTERVAL 1 HOUR)
SELECT 't' || coalesce(cu, ru) AS transcript, CAST(coalesce(ck, rk) AS VARCHAR) AS id, epoch_us(ca) AS called_us, epoch_us(ra) AS answered_us, CASE WHEN cu IS NULL THEN 'stray' WHEN ru IS NULL THEN 'lost' ELSE 'answered' END AS status FROM j""")
def paired_calls(t):
    """T4: calls with their results, lost calls and stray results."""
    one = lambda kinds, k: t.events.where(F.col("event_type").isin(*kinds)).select(F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("transcript"), F.expr(f"cast({k} as string)").alias("id"), F.col("event_type").alias("tool"), F.col("event_type").alias("output"), F.col("ts").cast("timestamp").alias("at"))
    out = pairing.paired(one(("click", "view", "error"), "event_id div 2"), one(("purchase", "signup"), "(event_id + 1) div 2"))
    return out.select("transcript", "id", F.unix_micros("called_at").alias("called_us"), F.unix_micros("answered_at").alias("answered_us"), "status")


# ---- pages and budgets ----------------------------------------------------------------------------------------

@query("""WITH RECURSIVE b AS (SELECT doc_id, source || ' in ' || lang AS prefix, text FROM documents), f AS (SELECT doc_id, 1 AS total, 0 AS size, 0 AS i FROM b
UNION ALL SELECT doc_id, CASE WHEN t = total THEN total ELSE t END, CASE WHEN t = total THEN room ELSE 0 END, i + 1 FROM (SELECT f.doc_id, total, i, 1200 - length(prefix) - 4 - 41 - 24 - length('_Finding part ' || total || '/' || total || '; next: read document part ' || total || '._') AS room, CAST(greatest(1, ceil(length(text) / (1200 - length(prefix) - 4 - 41 - 24 - length('_Finding part ' || total || '/' || total || '; next: read document part ' || total || '._')))) AS INTEGER) AS t FROM f JOIN b ON b.doc_id = f.doc_id WHERE size = 0 AND i < 32)),
p AS (SELECT b.*, total, size, unnest(range(1, total + 1)) AS part FROM b JOIN f ON f.doc_id = b.doc_id WHERE size > 0), q AS (SELECT *, substr(text, (part - 1) * size + 1, size) AS piece FROM p)
SELECT doc_id, CAST(part AS INTEGER) AS part, total AS total_parts, md5(prefix || chr(10) || chr(10) || '-- finding-body chars=' || lpad(CAST(length(piece) AS VARCHAR), 10, '0') || ' --' || chr(10) || piece || chr(10) || '-- end finding-body --' || chr(10) || chr(10) || '_Finding part ' || part || '/' || total || '; ' || CASE WHEN part < total THEN 'next: read document part ' || (part + 1) ELSE 'complete' END || '._') AS page FROM q""".replace("41", str(len("-- finding-body chars=0000000000 --\n"))).replace("- 24 -", f"- {len(chr(10) + '-- end finding-body --')} -"))
def body_pages(t):
    """Every document in pages of at most 1,200 characters, each of which names the next."""
    out = budget.pages(t.documents, ["doc_id"], F.concat("source", F.lit(" in "), "lang"), "text", "finding", 1200, lambda part: F.concat(F.lit("read document part "), part.cast("string")))
    return out.select("doc_id", "part", "total_parts", F.md5("text").alias("page"))


@query("""WITH r AS (SELECT o_custkey, 'order ' || o_orderkey || ' of ' || o_orderdate AS line, o_orderkey AS k, 'full text of order ' || o_orderkey || ' ' || repeat('x', o_orderkey % 40) AS body FROM orders), s AS (SELECT o_custkey, count(*) AS total, CAST(sum(length(body) + 1) - 1 AS BIGINT) AS chars FROM r GROUP BY 1),
u AS (SELECT r.*, total, chars, row_number() OVER (PARTITION BY o_custkey ORDER BY k) AS n, length('# Orders') + sum(length(line) + 1) OVER (PARTITION BY o_custkey ORDER BY k) AS used FROM r JOIN s USING (o_custkey)), v AS (SELECT *, '_' || n || '/' || total || ' order headline' || CASE WHEN total = 1 THEN '' ELSE 's' END || ' shown; complete render ' || chars || ' chars. To read omitted headlines or bodies, ask for one._' AS pointer, total <= 3 AND chars <= 500 AS whole FROM u),
m AS (SELECT o_custkey, min(n) AS stop FROM v WHERE NOT whole AND used + 2 + length(pointer) > 500 GROUP BY 1), k AS (SELECT v.* FROM v LEFT JOIN m USING (o_custkey) WHERE whole OR stop IS NULL OR n < stop)
SELECT o_custkey, total, count(*) AS shown, CASE WHEN bool_or(whole) THEN string_agg(body, chr(10) ORDER BY n) ELSE '# Orders' || chr(10) || string_agg(line, chr(10) ORDER BY n) || chr(10) || chr(10) || max_by(pointer, n) END AS text FROM k GROUP BY 1, 2""")
def headline_budget(t):
    """Each customer's orders within 500 characters: in full, or as headlines with a pointer to the rest."""
    rows = t.orders.select("o_custkey", "o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" of "), F.col("o_orderdate").cast("string")).alias("line"), F.concat(F.lit("full text of order "), F.col("o_orderkey").cast("string"), F.lit(" "), F.repeat(F.lit("x"), (F.col("o_orderkey") % 40).cast("int"))).alias("body"))
    return budget.headlines_shown(rows, ["o_custkey"], [F.col("o_orderkey")], "body", "line", F.lit("# Orders"), "order", "ask for one", 500)


# ---- rewritten history ----------------------------------------------------------------------------------------

_OLD = "left(sha256('k' || o_orderkey // 4), 7) || left(sha256('o' || o_orderkey), 33)"
_MAP = f"""c AS (SELECT o_orderkey AS id, {_OLD} AS commit_hash FROM orders), m AS (SELECT {_OLD} AS old_hash, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 50 = 1 THEN left(sha256('k' || (o_orderkey + 32) // 4), 7) || left(sha256('o' || (o_orderkey + 32)), 33) ELSE left(sha256('n' || o_orderkey), 40) END AS new_hash FROM orders WHERE o_orderkey % 5 <> 0),
f AS (SELECT o_orderkey AS id, 'base_sha' AS field, CASE WHEN o_orderkey % 6 = 0 THEN upper(left({_OLD}, 7)) WHEN o_orderkey % 6 = 1 THEN 'no hash' ELSE left({_OLD}, CAST(8 + o_orderkey % 30 AS INTEGER)) END AS value FROM orders)"""


def _history(t):
    def old(k):
        return F.concat(F.substring(F.sha2(F.concat(F.lit("k"), F.floor(k / 4).cast("string")), 256), 1, 7), F.substring(F.sha2(F.concat(F.lit("o"), k.cast("string")), 256), 1, 33))

    k = F.col("o_orderkey")
    commits = t.orders.select(k.alias("id"), old(k).alias("commit_hash"))
    rewrites = t.orders.where(k % 5 != 0).select(old(k).alias("old_hash"), F.when(k % 3 == 0, None).when(k % 50 == 1, old(k + 32)).otherwise(F.substring(F.sha2(F.concat(F.lit("n"), k.cast("string")), 256), 1, 40)).alias("new_hash"))
    value = F.when(k % 6 == 0, F.upper(F.substring(old(k), 1, 7))).when(k % 6 == 1, "no hash").otherwise(F.substr(old(k), F.lit(1), (8 + k % 30).cast("int")))
    findings = t.orders.select(k.alias("id"), F.lit("base_sha").alias("field"), value.alias("value"))
    prior = commits.limit(0).select(F.col("commit_hash").alias("old_hash"), F.col("id").alias("commit_id"))
    return commits, rewrites, findings, prior


@query(f"""WITH {_MAP} SELECT 'ambiguous' AS problem, id, field, value, count(*) AS n FROM f JOIN m ON starts_with(old_hash, lower(value)) WHERE regexp_full_match(value, '[0-9a-fA-F]{{7,40}}') GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'collision', s.id, 'commit_hash', new_hash, 1 FROM m JOIN c s ON s.commit_hash = old_hash JOIN c t ON t.commit_hash = new_hash WHERE new_hash <> old_hash AND t.id <> s.id""")
def remap_refusals(t):
    """Why a rewrite of history is refused: short hashes that it makes ambiguous, new hashes that are taken."""
    return evidence.remap_problems(*_history(t))


@query(f"""WITH {_MAP.replace("WHEN o_orderkey % 6 = 0 THEN upper(left(" + _OLD + ", 7)) ", "").replace("8 + o_orderkey % 30", "20 + o_orderkey % 20").replace("WHEN o_orderkey % 50 = 1 THEN left(sha256('k' || (o_orderkey + 32) // 4), 7) || left(sha256('o' || (o_orderkey + 32)), 33) ", "")}
SELECT 'commit' AS what, id, coalesce(new_hash, commit_hash) AS value FROM c LEFT JOIN m ON old_hash = commit_hash UNION ALL SELECT 'finding', id, coalesce(CASE WHEN regexp_full_match(value, '[0-9a-fA-F]{{7,40}}') THEN new_hash END, value) FROM f LEFT JOIN m ON starts_with(old_hash, value)
UNION ALL SELECT 'rewrite', c.id, old_hash || ' ' || coalesce(new_hash, '-') FROM m JOIN c ON commit_hash = old_hash""")
def remapped_history(t):
    """Commits, findings and the record of rewrites after one that is taken over."""
    commits, _, _, prior = _history(t)
    fresh = F.substring(F.sha2(F.concat(F.lit("n"), F.col("id").cast("string")), 256), 1, 40)
    rewrites = commits.where("id % 5 <> 0").select(F.col("commit_hash").alias("old_hash"), F.when(F.col("id") % 3 != 0, fresh).alias("new_hash"))
    findings = commits.select("id", F.lit("base_sha").alias("field"), F.when(F.col("id") % 6 == 1, "no hash").otherwise(F.substr("commit_hash", F.lit(1), (20 + F.col("id") % 20).cast("int"))).alias("value"))
    c, f, p = evidence.remap_history(commits, rewrites, findings, prior)
    out = c.select(F.lit("commit").alias("what"), "id", F.col("commit_hash").alias("value")).unionByName(f.select(F.lit("finding").alias("what"), "id", "value"))
    return out.unionByName(p.select(F.lit("rewrite").alias("what"), F.col("commit_id").alias("id"), F.concat("old_hash", F.lit(" "), F.coalesce("new_hash", F.lit("-"))).alias("value")))


# ---- navigation -----------------------------------------------------------------------------------------------


@query()
def navigation(t):
    """What is found for every region and nation, named with its parts, within eight steps from its own node."""
    from ..functions.text import similarity
    from ..operators.navigation import navigate
    from .catalog import _edges, _nodes

    nodes = _nodes(t).select("id", F.concat_ws(" ", "kind", "name").alias("text"))
    asked = nodes.where("id like 'r:%' or id like 'n:%'").select(F.col("id").alias("question"), F.concat(F.lit("which customer or supplier of "), "text").alias("text"))
    found = navigate(nodes, _edges(t), asked, asked.select("question", F.col("question").alias("id")), similarity)
    return found.evidence.join(found.stops, "question").select("question", "place", "id", F.round("score", 6).alias("score"), "protected", "round", "stop")


# ---- audited confidence ---------------------------------------------------------------------------------------


@query("""WITH RECURSIVE c AS (SELECT l_suppkey AS id, l_orderkey, l_linenumber, (CAST(l_quantity AS DOUBLE) - 25) / 100 AS delta, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity) AS place FROM lineitem WHERE l_returnflag = 'R'), s AS (SELECT s_suppkey AS id, (s_suppkey % 100) / 100.0::DOUBLE AS score FROM supplier WHERE s_suppkey % 3 <> 1),
f AS (SELECT c.id, c.l_orderkey, c.l_linenumber, c.place, s.score AS before, greatest(0, least(1, s.score + c.delta)) AS now FROM c JOIN s ON s.id = c.id WHERE c.place = 1 UNION ALL SELECT c.id, c.l_orderkey, c.l_linenumber, c.place, f.now, greatest(0, least(1, f.now + c.delta)) FROM f JOIN c ON c.id = f.id AND c.place = f.place + 1)
SELECT id, l_orderkey, l_linenumber, CAST(place AS INTEGER) AS place, round(before, 6) AS score_from, round(now, 6) AS score_to FROM f""")
def audited_confidence(t):
    """Every change of a score with what it was and became, one after another."""
    records = t.supplier.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 1, "q").when(F.col("s_suppkey") % 3 == 2, "p").alias("project"), ((F.col("s_suppkey") % 100) / 100.0).alias("score"))
    changes = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("id"), "l_orderkey", "l_linenumber", "l_quantity", ((F.col("l_quantity").cast("double") - 25) / 100).alias("delta"), F.col("l_linestatus").alias("reason"))
    _, audit = writes.audited(records, changes, ["l_orderkey", "l_linenumber", "l_quantity"], "p")
    return audit.select("id", "l_orderkey", "l_linenumber", "place", F.round("from", 6).alias("score_from"), F.round("to", 6).alias("score_to"))
