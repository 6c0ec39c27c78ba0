import hashlib
import random

import numpy as np
import pandas as pd
import pyarrow as pa

from skein.llm import suffix_dedup as op


def brute(rows, length=50):
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            first[s] = min(first.get(s, float("inf")), float("inf") if i is None else i)
    out = []
    for i, b in texts:
        cover = [False] * len(b)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < (float("inf") if i is None else i):
                cover[p : p + length] = [True] * length
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        spans = sum(c and not (k and cover[k - 1]) for k, c in enumerate(cover))
        out.append((-1 if i is None else i, len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(documents, rows, **more):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in op.deduplicate(documents(rows), **more).collect())


def corpus(words, seed=0):
    rng = random.Random(seed)
    passages = [" ".join(words(n, 90 + n)) for n in (8, 12, 20, 40, 90)] + ["a" * 120, "ab" * 70, "é" * 60]
    rows = []
    for k in range(70):
        parts = [" ".join(words(rng.randrange(1, 30))) for _ in range(3)]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 3)
            parts.insert(rng.randrange(len(parts) + 1), p[a:] if rng.random() < 0.5 else p)
        rows.append((k * 2, "".join(parts) if k % 2 else " ".join(parts)))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (1, rows[9][1]), (700, None), (701, ""), (702, "x" * 49), (703, "y" * 50), (704, "y" * 50), (705, "y" * 300)]
    near = rows[11][1]
    rows += [(800 + k, near[: k * 7 % len(near)] + "#" + near[k * 7 % len(near) :]) for k in range(20)]
    rng.shuffle(rows)
    return rows


def test_against_every_string(documents, words):
    rows = corpus(words)
    want = brute(rows)
    assert got(documents, rows) == want
    assert sum(r[2] > 0 for r in want) > 30 and any(r[3] > 2 for r in want)


def test_many_chunks_and_slices(documents, words, monkeypatch):
    rows = corpus(words, 1)
    monkeypatch.setattr(op, "CHUNK_BYTES", 900)
    monkeypatch.setattr(op, "SLICE", 130)
    assert got(documents, rows) == brute(rows)


def test_hot_buckets_are_dealt_by_string(documents, words, monkeypatch):
    line = "Share this page with your friends"
    rows = [(k, f"{' '.join(words(4))} {line} {' '.join(words(4))}") for k in range(120)]
    rows += [(200 + k, rows[k * 3][1][2:]) for k in range(30)] + corpus(words, 2)[:40]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    monkeypatch.setattr(op, "CHUNK_BYTES", 1500)
    monkeypatch.setattr(op, "HOT_CHUNKS", 1)
    seen, find = [], op.hot_buckets
    monkeypatch.setattr(op, "hot_buckets", lambda chunks, length: seen.append(find(chunks, length)) or seen[0])
    assert got(documents, rows) == brute(rows)
    assert 0 < len(seen[0]) < 30 and (np.diff(seen[0].astype(float)) > 0).all()
    # the runs of a hot bucket have many routes, equal runs one
    flat = np.frombuffer("".join(t for _, t in rows[:150]).encode(), np.uint8)
    r = op.runs(flat, np.array([len(t.encode()) for _, t in rows[:150]]), 50)
    _, _, heads, by_route, route = op._classes(r, seen[0])
    hot = np.isin(r["g"][heads][by_route], seen[0])
    assert len(np.unique(route[hot])) == hot.sum() > 3 * len(seen[0]) and (np.diff(route.astype(float)) >= 0).all()


def test_kept_bytes_repeated_ids_and_nulls(documents, words):
    text = " ".join(words(60, 3))
    rows = [(1, text), (1, text), (None, text), (None, "q" + text), (2, text[:80] + "!" + text)]
    assert got(documents, rows) == brute(rows)
    kept = {(r["doc_id"], r["n_bytes"]): r["kept"] for r in op.deduplicate(documents(rows), texts="kept").collect()}
    assert kept[1, len(text)].decode() == text and kept[None, len(text)] == b"" and kept[None, len(text) + 1] == b"q" and kept[2, len(text) + 81] == b"!"


def test_empty(documents):
    assert op.deduplicate(documents([(1, "a")]).limit(0)).count() == 0


def test_runs_that_agree_in_half_their_identifiers(monkeypatch):
    # what is sent for a bucket tells apart runs that agree in the upper, or the lower, 32 bits of their identifiers
    bits = [(5 << 32) | 1, (5 << 32) | 2, (6 << 32) | 2, (6 << 32) | 2]
    ids, sizes = np.arange(4), np.array([60] * 4)
    made = {"g": np.full(4, 7, np.uint64), "c": np.array(bits, np.uint64), "doc": np.arange(4), "low": np.arange(4) * 60, "high": np.arange(4) * 60 + 10}
    part = {k: {n: x[[k]] for n, x in made.items()} | {"doc": np.zeros(1, np.int64)} for k in range(4)}
    sent = []

    class Chunks:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            self.run = run

    chunks = Chunks()
    monkeypatch.setattr(op, "_opened", lambda body: (ids[[body]], sizes[:1], np.zeros(60, np.uint8)))
    monkeypatch.setattr(op, "runs", lambda flat, sizes, length: part[now])
    op._send_runs(chunks, 1, 50, np.zeros(0, np.uint64))
    for now in range(4):
        for b in chunks.run([pa.RecordBatch.from_arrays([pa.array([now]), pa.array([now])], ["chunk", "body"])]):
            sent += b.to_pylist()

    class Sent:
        def groupBy(self, _):
            return self

        def applyInPandas(self, run, _):
            return run

    out = op._answer_runs(Sent())(pd.DataFrame(sent))
    assert [op._unpack(x)[0].tolist() for x in out["answer"]] == [[2], [2], [2], [3]]


def test_buckets_are_refined_from_later_offsets():
    flat = np.frombuffer(b"abcabcabcabxabcabc", np.uint8)
    q, full = op.buckets(flat, 3, 6)
    text = flat.tobytes()
    for n, ids in ((3, q), (6, full)):
        seen = {}
        for p, x in enumerate(ids.tolist()):
            assert seen.setdefault(text[p : p + n], x) == x
        assert len(set(seen.values())) == len(seen)
    assert (op.least_within(np.arange(9)[::-1], 4) == np.arange(6)[::-1]).all()
