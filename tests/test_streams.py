import random
from datetime import datetime, timedelta

import pytest

from skein.streaming import claims, pairing

T0 = datetime(2024, 1, 1)
EVENTS = "repo string, at timestamp, seq long, action string, claim string, session string, globs array<string>, intent string"


@pytest.fixture()
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def streamed(spark, tmp_path, batches, schema, query, name):
    """What a query writes over batches that come one after another, restarted from its checkpoint each time."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}-in")
        q = query(spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}-in")).writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-ck").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(f"{tmp_path}/{name}")


def simulated(events, hours=8):
    """Event by event, with all claims in one list."""
    limit, active, seen, log = timedelta(hours=hours), {}, {}, []
    for repo, at, _, action, claim, session, globs, intent in sorted(events, key=lambda e: (e[1], e[2])):
        for c, v in sorted(active.items()):
            if v["beat"] + limit < at:
                log.append((v["repo"], v["beat"] + limit, c, v["session"], "expired", None))
                del active[c]
        others = {c: v for c, v in active.items() if v["repo"] == repo and v["session"] != session}
        mine = {c: v for c, v in active.items() if v["repo"] == repo and v["session"] == session}
        hit = lambda a, b: any(x.split("*")[0].startswith(y.split("*")[0]) or y.split("*")[0].startswith(x.split("*")[0]) for x in a for y in b)
        if action == "create":
            same = [c for c, v in mine.items() if (v["globs"], v["intent"]) == (sorted(set(globs)), intent)]
            if same:
                active[same[0]]["beat"] = at
                log.append((repo, at, same[0], session, "refreshed", None))
            else:
                log.append((repo, at, claim, session, "created", None))
                log += [(repo, at, claim, session, "overlaps", c) for c, v in others.items() if hit(globs, v["globs"])]
                active[claim] = {"repo": repo, "session": session, "globs": sorted(set(globs)), "intent": intent, "created": at, "beat": at}
        elif action == "beat":
            for c in mine:
                active[c]["beat"] = at
                log.append((repo, at, c, session, "refreshed", None))
            fresh = {c: v for c, v in others.items() if v["created"] > seen.get((repo, session), datetime.min)}
            if fresh:
                seen[repo, session] = max(v["created"] for v in fresh.values())
            log += [(repo, at, None, session, "overlaps", c) for c, v in fresh.items() if hit([g for m in mine.values() for g in m["globs"]], v["globs"])]
        else:
            gone = [c for c in mine if claim in (None, c)]
            log += [(repo, at, c, session, "released", None) for c in gone] or [(repo, at, claim, session, "refused", None)]
            for c in gone:
                del active[c]
    return log


def made_events(rng, n):
    out, at = [], T0
    for k in range(n):
        at += timedelta(minutes=rng.choice((1, 5, 30, 200, 300)))
        repo, session = rng.choice("xy"), rng.choice(("s1", "s2", "s3"))
        action = rng.choice(("create", "create", "beat", "beat", "release"))
        claim = f"c{k}" if action == "create" else None if action == "beat" else rng.choice((None, f"c{rng.randrange(max(0, k - 6), k + 1)}"))
        globs = [rng.choice(("src/*", "src/a/*.py", "docs/**", "src/b.py", "tests/x")) for _ in range(rng.choice((1, 2)))] if action == "create" else None
        out.append((repo, at, k, action, claim, session, globs, rng.choice(("i", "j")) if action == "create" else None))
    return out


def test_claims_as_time_passes(spark, tmp_path, rocksdb):
    events = made_events(random.Random(4), 90)
    end = events[-1][1] + timedelta(days=3)
    later = [("z", end, 0, "beat", None, "s", None, None)]
    got = streamed(spark, tmp_path, [events[:20], events[20:60], events[60:], later, later], EVENTS, claims.claim_log, "claims")
    want = simulated([*events, ("z", end, 99, "beat", None, "s", None, None)])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert {r[4] for r in want} == {"created", "refreshed", "released", "expired", "refused", "overlaps"}


@pytest.mark.parametrize("hours", [3, 40, 1000])
def test_states_at_a_moment_agree_with_the_log(spark, hours):
    events = [e if e[3] != "create" else (*e[:7], f"own {e[2]}") for e in made_events(random.Random(hours), 50)]
    moment = T0 + timedelta(hours=hours)
    state = {}
    for _, at, claim, session, what, _ in simulated([e for e in events if e[1] <= moment] + [("z", moment, 99, "beat", None, "s", None, None)]):
        if what == "created":
            state[claim] = [session, at, at, None, "active"]
        elif what == "refreshed":
            state[claim][2] = at
        elif what in ("released", "expired"):
            state[claim][3:] = [at, what]
    got = claims.claim_states(spark.createDataFrame(events, EVENTS), str(moment))
    assert {r["claim"]: list(r[2:]) for r in got.collect()} == state


def test_pairs_of_two_streams(spark, tmp_path):
    m = lambda k: T0 + timedelta(minutes=k)
    calls = [[("t", "a", "read", m(0)), ("t", "a", "read", m(1)), ("t", "b", "run", m(2)), ("t", "lost", "run", m(3)), ("u", "a", "edit", m(4)), ("t", "slow", "run", m(5))], [("t", "c", "read", m(50))], [("z", "z", "z", m(900))], [("t", "dropped", "read", m(10)), ("z", "y", "z", m(1800))], [("z", "w", "z", m(2700))]]
    results = [[("t", "a", m(2), "1"), ("t", "a", m(3), "again"), ("t", "stray", m(4), "s")], [("t", "b", m(20), "2"), ("u", "a", m(55), "3"), ("t", "c", m(49), "early")], [("t", "slow", m(120), "too late"), ("z", "q", m(900), "")], [("z", "v", m(1800), "")], [("z", "o", m(2700), "")]]
    cs, rs = "transcript string, id string, tool string, at timestamp", "transcript string, id string, at timestamp, output string"
    for c, r in zip(calls, results, strict=True):
        spark.createDataFrame(c, cs).coalesce(1).write.mode("append").parquet(f"{tmp_path}/calls")
        spark.createDataFrame(r, rs).coalesce(1).write.mode("append").parquet(f"{tmp_path}/results")
        q = pairing.paired(spark.readStream.schema(cs).parquet(f"{tmp_path}/calls"), spark.readStream.schema(rs).parquet(f"{tmp_path}/results"))
        q.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["transcript"], r["id"], r["status"], r["output"]) for r in spark.read.parquet(f"{tmp_path}/out").where("transcript <> 'z'").collect())
    assert got == sorted([("t", "a", "answered", "1"), ("t", "b", "answered", "2"), ("u", "a", "answered", "3"), ("t", "lost", "lost", None), ("t", "slow", "lost", None), ("t", "c", "lost", None), ("t", "c", "stray", "early"), ("t", "stray", "stray", "s"), ("t", "slow", "stray", "too late")], key=lambda x: tuple(map(str, x))) or sorted(got, key=repr) == sorted([("t", "a", "answered", "1"), ("t", "b", "answered", "2"), ("u", "a", "answered", "3"), ("t", "lost", "lost", None), ("t", "slow", "lost", None), ("t", "c", "lost", None), ("t", "c", "stray", "early"), ("t", "stray", "stray", "s"), ("t", "slow", "stray", "too late")], key=repr)


def test_pairs_of_tables(spark):
    m = lambda k: T0 + timedelta(minutes=k)
    calls = spark.createDataFrame([("t", "a", "read", m(0)), ("t", "b", "run", m(0)), ("t", "a", "other", m(1))], "transcript string, id string, tool string, at timestamp")
    results = spark.createDataFrame([("t", "a", m(2), "1"), ("t", "a", m(3), "2"), ("t", "x", m(2), "")], "transcript string, id string, at timestamp, output string")
    got = {(r["id"], r["tool"], r["status"], r["output"]) for r in pairing.paired(calls, results).collect()}
    assert got == {("a", "read", "answered", "1"), ("b", "run", "lost", None), ("x", None, "stray", "")}
