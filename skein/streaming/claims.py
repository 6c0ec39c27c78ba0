"""Claims on paths, from their creation to their end.

Events (repo, at, action, claim, session, globs, intent):

* create: a claim; one that its session already holds with the same globs and intent counts as a refresh of that one;
* beat: all active claims of a session are refreshed;
* release: the session's own claim, or with no claim named all of them; others' claims and ended ones are refused.

An active claim that is not refreshed for a time ends as expired.  Overlaps are advice: a new claim is told of the other sessions'
active claims that it overlaps, and a beat of the claims that others have made since the session's last look.

claim_log() says what happens, event by event, as a stream whose state is one repository's active claims and whose clock
is event time; claim_states() says in batch how each claim stands at a moment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Hours without a refresh after which a claim has expired.
EXPIRES = 8
LOG = "repo string, at timestamp, claim string, session string, what string, other string"
_WILD = re.compile(r"[*?\[{]")


def overlap(a: str, b: str) -> bool:
    """Whether two globs can hold a path alike, judged by what stands before their first wildcards."""
    x, y = _WILD.split(a, maxsplit=1)[0], _WILD.split(b, maxsplit=1)[0]
    return x.startswith(y) or y.startswith(x)


def _overlapping(a: list[str], b: list[str]) -> bool:
    return any(overlap(x, y) for x in a for y in b)


class Claims(StatefulProcessor):
    """One repository's active claims and what each session has seen of them."""

    def __init__(self, hours: float = EXPIRES):
        self.limit = int(hours * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.active = handle.getMapState("active", "claim string", "session string, globs array<string>, intent string, created long, beat long")
        self.seen = handle.getMapState("seen", "session string", "until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        self.now = {k[0]: tuple(v) for k, v in self.active.iterator()}
        before, log = dict(self.now), []
        for e in events.itertuples():
            at = int(pd.Timestamp(e.at).tz_localize("UTC").timestamp() * 1000) if pd.Timestamp(e.at).tzinfo is None else int(pd.Timestamp(e.at).timestamp() * 1000)
            log += self.expire(at)
            log += getattr(self, e.action, self.unknown)(at, e)
        for c in before.keys() - self.now.keys():
            self.active.removeKey((c,))
        for c, v in self.now.items():
            if before.get(c) != v:
                self.active.updateValue((c,), v)
        self.clock()
        if log:
            yield self.frame(key, log)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.now = {k[0]: tuple(v) for k, v in self.active.iterator()}
        log = self.expire(expiredTimerInfo.getExpiryTimeInMs())
        for _, c, *_ in log:
            self.active.removeKey((c,))
        self.clock()
        if log:
            yield self.frame(key, log)

    def close(self) -> None:
        pass

    # ---- what events do; a log row is (at, claim, session, what, other) ----

    def expire(self, at: int) -> list:
        out = sorted((v[4] + self.limit, c, v[0], "expired", None) for c, v in self.now.items() if v[4] + self.limit < at)
        for _, c, *_ in out:
            del self.now[c]
        return out

    def create(self, at: int, e) -> list:
        globs, own = sorted(set(e.globs)), e.session
        for c, v in sorted(self.now.items()):
            if (v[0], sorted(v[1]), v[2]) == (own, globs, e.intent) or c == e.claim:
                if v[0] != own:
                    return [(at, e.claim, own, "refused", c)]
                self.now[c] = (*v[:4], at)
                return [(at, c, own, "refreshed", None)]
        self.now[e.claim] = (own, globs, e.intent, at, at)
        return [(at, e.claim, own, "created", None)] + self.against(at, e.claim, [(c, v) for c, v in self.now.items() if v[0] != own], globs, own)

    def beat(self, at: int, e) -> list:
        mine = [(c, v) for c, v in sorted(self.now.items()) if v[0] == e.session]
        for c, v in mine:
            self.now[c] = (*v[:4], at)
        until = self.seen.getValue((e.session,))[0] if self.seen.containsKey((e.session,)) else -1
        fresh = [(c, v) for c, v in self.now.items() if v[0] != e.session and v[3] > until]
        if fresh:
            self.seen.updateValue((e.session,), (max(v[3] for _, v in fresh),))
        globs = [g for _, v in mine for g in v[1]]
        return [(at, c, e.session, "refreshed", None) for c, _ in mine] + self.against(at, None, fresh, globs, e.session)

    def release(self, at: int, e) -> list:
        named = e.claim is not None and not pd.isna(e.claim)
        mine = [c for c, v in sorted(self.now.items()) if v[0] == e.session and (not named or c == e.claim)]
        for c in mine:
            del self.now[c]
        return [(at, c, e.session, "released", None) for c in mine] or [(at, e.claim if named else None, e.session, "refused", None)]

    def unknown(self, at: int, e) -> list:
        return [(at, e.claim, e.session, "refused", None)]

    def against(self, at: int, claim: str | None, others: list, globs: list[str], session: str) -> list:
        return [(at, claim, session, "overlaps", c) for c, v in sorted(others) if _overlapping(globs, v[1])]

    # ---- the clock ----

    def clock(self) -> None:
        """One timer, at the end of the claim that ends first."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if self.now:
            self.handle.registerTimer(min(v[4] for v in self.now.values()) + self.limit + 1)

    def frame(self, key, log: list) -> pd.DataFrame:
        at = [datetime.fromtimestamp(x[0] / 1000, UTC).replace(tzinfo=None) for x in log]
        return pd.DataFrame({"repo": key[0], "at": pd.to_datetime(at), **{n: [x[k] for x in log] for k, n in enumerate(("claim", "session", "what", "other"), 1)}})


def claim_log(events: DataFrame, hours: float = EXPIRES, late: str = "1 minute") -> DataFrame:
    """What happens to claims, as a stream: events(repo, at, seq, action, claim, session, globs, intent) in the order of (at, seq).

    what: created, refreshed, released, expired, refused, or overlaps (with `other`).  Claims expire when the watermark has passed their
    time, or at the first later event, whichever comes first, stamped with the time at which they ended.  Needs the RocksDB state store.
    """
    return events.withWatermark("at", late).groupBy("repo").transformWithStateInPandas(Claims(hours), LOG, "append", "eventTime")


def claim_states(events: DataFrame, now: str, hours: float = EXPIRES) -> DataFrame:
    """(repo, claim, session, created_at, beat_at, ended_at, status) at a moment, from events of claims that are created once.

    A claim's own events and its session's beats up to the moment count; a gap of more than the hours between two of them ends it as
    expired before the second.  All by equi-joins and windows per claim, so no repository is gathered.
    """
    moment, span = F.lit(now).cast("timestamp"), F.expr(f"interval {int(hours * 3600)} seconds")
    past = events.where(F.col("at") <= moment)
    made = past.where("action = 'create'").groupBy("repo", "claim").agg(F.min(F.struct("at", "session")).alias("m")).select("repo", "claim", F.col("m.session").alias("session"), F.col("m.at").alias("created_at"))
    beats = past.where("action = 'beat'").select("repo", "session", "at", F.lit("beat").alias("action"))
    of_all = past.where("action = 'release' and claim is null").select("repo", "session", "at", "action")
    shared = made.join(beats.unionByName(of_all), ["repo", "session"]).where("at >= created_at").select("repo", "claim", "at", "action")
    own = past.where("action = 'release' and claim is not null").join(made.select("repo", "claim", "session"), ["repo", "claim", "session"]).select("repo", "claim", "at", "action")
    first = made.select("repo", "claim", F.col("created_at").alias("at"), F.lit("create").alias("action"))
    w = Window.partitionBy("repo", "claim").orderBy("at", F.desc("action"))
    steps = shared.unionByName(own).unionByName(first).withColumn("before", F.lag("at").over(w))
    gap = F.col("at") > F.col("before") + span
    ends = steps.select("repo", "claim", "at", F.when(gap, F.col("before") + span).when(F.col("action") == "release", F.col("at")).alias("end"), F.when(gap, "expired").when(F.col("action") == "release", "released").alias("how"), F.when(gap, F.col("before")).otherwise(F.col("at")).alias("beat"))
    w = Window.partitionBy("repo", "claim")
    cut = ends.withColumn("stop", F.min("end").over(w)).where("stop is null or at <= stop or end = stop")
    told = cut.groupBy("repo", "claim").agg(F.min(F.when(F.col("end") == F.col("stop"), F.struct("end", "how"))).alias("e"), F.max(F.when(F.coalesce("how", F.lit("")) != "released", F.col("beat"))).alias("beat_at"))
    late = F.col("e").isNull() & (F.col("beat_at") + span < moment)
    out = made.join(told, ["repo", "claim"])
    return out.select("repo", "claim", "session", "created_at", "beat_at", F.when(late, F.col("beat_at") + span).otherwise(F.col("e.end")).alias("ended_at"), F.when(late, "expired").otherwise(F.coalesce("e.how", F.lit("active"))).alias("status"))
