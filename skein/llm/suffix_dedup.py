"""Suffix-array deduplication of repeated passages by bucket-pointer refinement.

Suffixes need to be told apart to a depth of LENGTH bytes only.  Buckets of q-grams (half that depth) are refined by the
bucket identifiers of later offsets: the bucket of LENGTH bytes at p is that of (bucket at p, bucket at p + q), and
every shorter bucket is made in the same way from its halves, so each update is reused by all deeper ones.  Bucket
identifiers are 64-bit values of the strings rather than ranks, so equal strings have equal identifiers in any task.

Refinement goes on only where it can matter:

1. Each LENGTH-byte string is filed under the least of the q-gram buckets within it, which equal strings share.
   Neighbouring positions under one bucket form a run (about 13 positions), identified by its whole string.
   A run that also stands in a document with a smaller doc_id is settled at once, and so is a bucket that holds one run.
2. Buckets that hold different runs are refined to the full depth, position by position.

Documents are packed into chunks of about CHUNK_BYTES in a table bucketed by chunk, so texts are never shuffled.
Chunks send what they hold, once for each distinct run or string with its smallest document, to shards by bucket
identifier; a shard answers every chunk with two bits or one per entry.  Copies of a passage, however many, are
one entry per chunk, and the number of shards grows with the input.

A bucket that holds many different runs (a line common to many documents, each with other neighbours) would fill one
shard.  Such hot buckets are found in a part of the chunks; their runs are dealt by bucket and string together and are
always refined, so their number bears on the work of a task only, never on the result.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .common import dropped, released, scratch_dir, small_batches, stored

LENGTH = 50
CHUNK_BYTES = 1 << 20
#: Rows of the chunk table that are read, and sent to Python, at once: a row is a few hundred kB.
ROWS_AT_ONCE = {"spark.sql.parquet.columnarReaderBatchSize": "8", "spark.sql.execution.arrow.maxRecordsPerBatch": "8"}
#: Bytes of text whose buckets are made at once.
SLICE = 1 << 18
#: Sorts a null doc_id: no document comes after it.  Which ids are null is kept beside them.
LAST = np.iinfo(np.int64).max
#: A bucket is hot from this many different runs a chunk, on average over the chunks looked at.
HOT_RUNS = 4
#: Hot buckets at most, sent to every task.
HOT_MOST = 20_000
#: One chunk in so many is looked at for hot buckets.
HOT_CHUNKS = 16
_M = 0x9E3779B97F4A7C15
_INVERSE = pow(_M, -1, 1 << 64)
_LETTERS = np.random.default_rng(50).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def buckets(flat: np.ndarray, *depths: int) -> list[np.ndarray]:
    """Bucket identifiers of each position at the given depths, refined from half depths at later offsets."""
    need, todo = {1}, list(depths)
    while todo:
        if (n := todo.pop()) not in need:
            need.add(n)
            todo += [n - n // 2, n // 2]
    have: dict[int, np.ndarray] = {}
    for n in sorted(need):
        if n == 1:
            have[1] = _LETTERS[flat]
            continue
        first = n - n // 2
        m = max(0, len(flat) - n + 1)
        have[n] = have[first][:m] + np.uint64(pow(_M, first, 1 << 64)) * have[n // 2][first : first + m]
    return [have[n] for n in depths]


def least_within(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:]) if len(x) > done else x[:0]
        done *= 2
    if rest := width - done:
        x = np.minimum(x[:-rest], x[rest:]) if len(x) > rest else x[:0]
    return x


def _slices(sizes: np.ndarray, length: int):
    """Pieces of a chunk: (first byte, last byte, document and end of document at each byte).  Long documents are cut with an overlap."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    k = 0
    while k < len(sizes):
        if sizes[k] > SLICE:
            for a in range(int(starts[k]), int(ends[k]) - length + 1, SLICE):
                yield a, min(int(ends[k]), a + SLICE + length - 1), np.array([k]), np.array([ends[k]])
            k += 1
            continue
        j = k
        while j < len(sizes) and sizes[j] <= SLICE and ends[j] - starts[k] <= SLICE:
            j += 1
        yield int(starts[k]), int(ends[j - 1]), np.arange(k, j), ends[k:j]
        k = j


def runs(flat: np.ndarray, sizes: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Runs of positions filed under one bucket: bucket g, string identifier c, document, first and last position."""
    q = length // 2
    out = []
    for a, b, docs, ends in _slices(sizes, length):
        part = flat[a:b]
        if len(part) < length:
            continue
        (grams,) = buckets(part, q)
        least = least_within(_mixed(grams), length - q + 1)
        position = np.arange(len(least))
        doc = np.searchsorted(ends - a, position, side="right")
        good = position + length <= (ends - a)[np.minimum(doc, len(ends) - 1)]
        first = good.copy()
        first[1:] &= ~good[:-1] | (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
        low = np.flatnonzero(first)
        last = good.copy()
        last[:-1] &= ~good[1:] | (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
        high = np.flatnonzero(last)
        powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(part), np.uint64(_M)))))
        sums = np.concatenate(([np.uint64(0)], np.cumsum(_LETTERS[part] * powers[:-1])))
        back = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(low) and int(low[-1]) + 1, np.uint64(_INVERSE)))))
        whole = (sums[high + length] - sums[low]) * back[low]
        # minima crowd at the low end; mixed again they are even over the shards
        out.append((_mixed(least[low] ^ np.uint64(_M)), _mixed(whole + (high - low).astype(np.uint64) * np.uint64(_M)), docs[doc[low]], low + a, high + a))
    names = ("g", "c", "doc", "low", "high")
    return {n: np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.uint64 if k < 2 else np.int64) for k, n in enumerate(names)}


def _pack(*x) -> bytes:
    return zstandard.compress(pickle.dumps(x, 5), 3)


def _unpack(b: bytes) -> tuple:
    return pickle.loads(zstandard.decompress(b))


def _opened(body: bytes):
    """Ids (rising), bytes of each document and all bytes of a chunk."""
    ids, sizes, data, _, _ = _unpack(body)
    return ids, sizes, np.frombuffer(data, np.uint8)


def _classes(r: dict[str, np.ndarray], hot: np.ndarray):
    """Runs grouped by identifier: order by group, group starts, each group's first run, the order of groups by route, and their rising routes.

    The route is the bucket, or bucket and string together where the bucket is hot.
    """
    key = r["g"] ^ (r["c"] * np.uint64(_M))
    order = np.argsort(key, kind="stable")  # documents rise within a group
    starts = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1]))) if len(order) else np.zeros(0, np.int64)
    heads = order[starts]
    route = r["g"][heads]
    if len(hot):
        route = np.where(np.isin(route, hot), _mixed(key[heads]), route)
    by_route = np.argsort(route, kind="stable")
    return order, starts, heads, by_route, route[by_route]


def _own(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the documents that entries name, and the entries' places among them."""
    used, place = np.unique(doc, return_inverse=True)
    return ids[used], place.astype(np.uint32 if len(used) > 65535 else np.uint16)


def _shard(x: np.ndarray, shards: int) -> np.ndarray:
    """Shards of rising identifiers rise too."""
    return (((x >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _cut(shard: np.ndarray, shards: int):
    cuts = np.searchsorted(shard, np.arange(shards + 1))
    return [(k, int(cuts[k]), int(cuts[k + 1])) for k in np.unique(shard).tolist()]


def chunk_table(docs: DataFrame, name: str, number: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """A table of (chunk, body), bucketed by chunk, of documents(doc_id, text) with some other columns."""

    def run(batches):
        ids, texts, more, size = [], [], [], 0

        def row():
            order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
            known = np.array([LAST if ids[k] is None else ids[k] for k in order], np.int64)
            body = _pack(known, np.array([len(texts[k]) for k in order], np.int64), b"".join([texts[k] for k in order]), [more[k] for k in order], [ids[k] is None for k in order])
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65]), pa.array([body], pa.binary())], ["chunk", "body"])

        for b in batches:
            for i, t, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids.append(i)
                texts.append(t)
                more.append(rest)
                size += len(t)
                if size >= CHUNK_BYTES:
                    yield row()
                    ids, texts, more, size = [], [], [], 0
        if ids:
            yield row()

    spark = docs.sparkSession
    small_batches(spark)
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), *carry).mapInArrow(run, "chunk long, body binary")
    path = scratch_dir(spark)
    packed.write.format("parquet").option("path", path).bucketBy(number, "chunk").saveAsTable(name)
    out = spark.table(name)
    out._skein_path = path
    return out


def hot_buckets(chunks: DataFrame, length: int) -> np.ndarray:
    """Rising identifiers of the buckets that hold HOT_RUNS different runs a chunk or more, the HOT_MOST largest; others share a shard as before."""

    def run(batches):
        for batch in batches:
            for body in batch.column(0).to_pylist():
                _, sizes, flat = _opened(body)
                r = runs(flat, sizes, length)
                _, _, heads, _, _ = _classes(r, np.zeros(0, np.uint64))
                g, n = np.unique(r["g"][heads], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g[n > 1].view(np.int64)), pa.array(n[n > 1])], ["g", "n"])

    some = chunks.where(F.pmod("chunk", F.lit(HOT_CHUNKS)) == 0)
    number = some.count()
    counted = some.select("body").mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") >= HOT_RUNS * number).orderBy(F.desc("n"), "g").limit(HOT_MOST).select("g")
    return np.sort(np.array([x.g for x in found.collect()], np.int64).view(np.uint64))


def _send_runs(chunks: DataFrame, shards: int, length: int, hot: np.ndarray) -> DataFrame:
    """(chunk, shard, part): the distinct runs of each chunk with their smallest document."""

    def run(batches):
        for batch in batches:
            for chunk, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, sizes, flat = _opened(body)
                r = runs(flat, sizes, length)
                _, _, heads, by_route, route = _classes(r, hot)
                heads = heads[by_route]
                g, c, doc = r["g"][heads], r["c"][heads], r["doc"][heads]
                cut = _cut(_shard(route, shards), shards)
                parts = [_pack(g[a:b].astype(np.uint32), c[a:b], *_own(ids, doc[a:b])) for _, a, b in cut]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(cut), pa.int64()), pa.array([k for k, _, _ in cut], pa.int32()), pa.array(parts, pa.binary())], ["chunk", "shard", "part"])

    return chunks.select("chunk", "body").mapInArrow(run, "chunk long, shard int, part binary")


def _answer_runs(sent: DataFrame) -> DataFrame:
    """(chunk, shard, answer): for each run sent, bit 1: it stands in a smaller document of another chunk; bit 2: its bucket holds other runs too."""

    def run(pdf):
        import pandas as pd

        grams, keys, docs, sizes = [], [], [], []
        for part in pdf["part"]:
            g, c, ids, doc = _unpack(part)
            grams.append(g)
            keys.append(c)
            docs.append(ids[doc])
            sizes.append(len(g))
        grams, keys, docs = np.concatenate(grams), np.concatenate(keys), np.concatenate(docs)
        # a bucket may be told by a part of its identifier, as the whole string's goes with it; that one decides and is whole
        order = np.lexsort((keys, grams))
        g, c = grams[order], keys[order]
        new_g = np.concatenate(([True], g[1:] != g[:-1]))
        new = new_g | np.concatenate(([True], c[1:] != c[:-1]))
        least = np.minimum.reduceat(docs[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        at = np.flatnonzero(new_g)
        several = (np.add.reduceat(new.astype(np.int64), at) > 1) & (np.minimum.reduceat(docs[order], at) != np.maximum.reduceat(docs[order], at))
        bits = np.empty(len(keys), np.uint8)
        bits[order] = (docs[order] > least) | (several[np.cumsum(new_g) - 1].astype(np.uint8) << 1)
        cuts = np.cumsum([0, *sizes])
        return pd.DataFrame({"chunk": pdf["chunk"], "shard": pdf["shard"], "answer": [_pack(bits[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]})

    return sent.groupBy("shard").applyInPandas(run, "chunk long, shard int, answer binary")


def _settle(chunks: DataFrame, answers: DataFrame, shards: int, length: int, hot: np.ndarray) -> DataFrame:
    """(chunk, shard, part): shard -1: what is settled and what waits; others: the strings to refine, with their smallest document."""

    def run(key, left, right):
        import pandas as pd

        rows = []
        for chunk, body in zip(left["chunk"], left["body"], strict=True):
            ids, sizes, flat = _opened(body)
            r = runs(flat, sizes, length)
            order, starts, heads, by_route, route = _classes(r, hot)
            got = dict(zip(right["shard"], right["answer"], strict=True))
            bits = np.zeros(len(heads), np.uint8)
            if len(heads):
                bits[by_route] = np.concatenate([_unpack(got[k])[0] for k, _, _ in _cut(_shard(route, shards), shards)])
                bits |= np.isin(r["g"][heads], hot).astype(np.uint8) << 1  # no one shard has seen all runs of these
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
            doc = ids[r["doc"][order]]
            gone = (bits[group] & 1).astype(bool) | (doc > ids[r["doc"][heads]][group])
            wait = ~gone & (bits[group] & 2).astype(bool)
            low, high = r["low"][order], r["high"][order]
            # the positions of waiting runs, and their strings
            count = (high - low + 1)[wait]
            position = np.repeat(low[wait] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum()) if len(count) else np.zeros(0, np.int64)
            owner = np.repeat(r["doc"][order][wait], count)
            by_doc = np.argsort(owner, kind="stable")
            position, owner = position[by_doc], owner[by_doc]
            strings, holder, _ = _distinct(flat, position, owner, length)
            small = np.int32 if len(flat) < 2**31 else np.int64
            settled = _joined(low[gone], high[gone])
            rows.append((chunk, -1, _pack(*(x.astype(small) for x in settled), np.diff(position, prepend=0).astype(small), owner.astype(np.int32))))
            for k, a, b in _cut(_shard(strings, shards), shards):
                rows.append((chunk, k, _pack(strings[a:b], *_own(ids, holder[a:b]))))
        return pd.DataFrame(rows, columns=["chunk", "shard", "part"])

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(run, "chunk long, shard int, part binary")


def _joined(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of positions with neighbours made one."""
    order = np.argsort(low, kind="stable")
    low, high = low[order], high[order]
    first = np.concatenate(([True], low[1:] > high[:-1] + 1))[: len(low)]
    return low[first], high[np.concatenate((first[1:], [True]))[: len(high)]]


def _distinct(flat: np.ndarray, position: np.ndarray, owner: np.ndarray, length: int):
    """Distinct strings at the positions (documents rising), the first document of each, and the string of each position."""
    deep = _strings(flat, position, length)
    order = np.argsort(deep, kind="stable")
    first = np.concatenate(([True], deep[order][1:] != deep[order][:-1])) if len(deep) else np.zeros(0, bool)
    index = np.empty(len(deep), np.int64)
    index[order] = np.cumsum(first) - 1
    return deep[order][first], owner[order][first], index


def _strings(flat: np.ndarray, position: np.ndarray, length: int) -> np.ndarray:
    """Full-depth bucket identifiers at the given positions: those of the two half depths together."""
    out = np.empty(len(position), np.uint64)
    step = 1 << 18
    where = np.argsort(position, kind="stable")
    p = position[where]
    got = np.empty(len(p), np.uint64)
    at = 0
    while at < len(p):
        base = int(p[at])
        end = int(np.searchsorted(p, base + step))
        (full,) = buckets(flat[base : base + step + length], length)
        got[at:end] = _mixed(full[p[at:end] - base])
        at = end
    out[where] = got
    return out


def _answer_strings(sent: DataFrame) -> DataFrame:
    """(chunk, shard, answer): whether each string stands in a smaller document of another chunk."""

    def run(pdf):
        import pandas as pd

        keys, docs, sizes = [], [], []
        for part in pdf["part"]:
            strings, ids, doc = _unpack(part)
            keys.append(strings)
            docs.append(ids[doc])
            sizes.append(len(strings))
        keys, docs = np.concatenate(keys), np.concatenate(docs)
        order = np.argsort(keys, kind="stable")
        new = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
        least = np.minimum.reduceat(docs[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        gone = np.empty(len(keys), bool)
        gone[order] = docs[order] > least
        cuts = np.cumsum([0, *sizes])
        return pd.DataFrame({"chunk": pdf["chunk"], "shard": pdf["shard"], "part": [_pack(np.packbits(gone[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]})

    return sent.where("shard >= 0").groupBy("shard").applyInPandas(run, "chunk long, shard int, part binary")


def _finish(chunks: DataFrame, found: DataFrame, shards: int, length: int, texts: str, carried: list[StructField]) -> DataFrame:
    """One row per document, with its kept text and carried columns if asked for."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *([texts] if texts else []), *(c.name for c in carried)]

    def run(key, left, right):
        import pandas as pd

        out = []
        for body in left["body"]:
            ids, sizes, flat = _opened(body)
            _, _, _, more_columns, null = _unpack(body)
            state = [p for k, p in zip(right["shard"], right["part"], strict=True) if k < 0]
            got = {k: p for k, p in zip(right["shard"], right["part"], strict=True) if k >= 0}
            low, high, steps, owner = _unpack(state[0])
            position = np.cumsum(steps, dtype=np.int64)
            strings, holder, index = _distinct(flat, position, owner, length)
            gone = np.zeros(len(strings), bool)
            for k, a, b in _cut(_shard(strings, shards), shards):
                gone[a:b] = np.unpackbits(_unpack(got[k])[0], count=b - a).astype(bool)
            more = position[gone[index] | (ids[owner] > ids[holder[index]])]
            mark = np.zeros(len(flat) + 1, np.int32)
            np.add.at(mark, low, 1)
            np.add.at(mark, high.astype(np.int64) + length, -1)
            np.add.at(mark, more, 1)
            np.add.at(mark, more + length, -1)
            cover = np.cumsum(mark[:-1]) > 0
            end = np.cumsum(sizes)
            for k in range(len(ids)):
                a, b = int(end[k] - sizes[k]), int(end[k])
                c = cover[a:b]
                removed = int(c.sum())
                kept = (flat[a:b][~c] if removed else flat[a:b]).tobytes()
                spans = int(c[:1].sum() + (c[1:] & ~c[:-1]).sum()) if removed else 0
                out.append((None if null[k] else int(ids[k]), b - a, removed, spans, hashlib.sha256(kept).hexdigest(), *([kept if texts == "kept" else kept.decode("utf-8", "ignore")] if texts else []), *more_columns[k]))
        # nullable whole numbers stay whole
        return pd.DataFrame({n: pd.array([x[k] for x in out], "Int64") if whole[k] else pd.Series([x[k] for x in out], dtype=object) for k, n in enumerate(names)})

    fixed = [StructField(n, LongType()) for n in names[:4]] + [StructField("kept_sha256", StringType())] + ([StructField(texts, BinaryType() if texts == "kept" else StringType())] if texts else [])
    schema = StructType([*fixed, *carried])
    whole = [isinstance(f.dataType, (LongType, IntegerType)) for f in schema.fields]
    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInPandas(run, schema)


def deduplicate(docs: DataFrame, length: int = LENGTH, texts: str = "", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept or kept_text][, carried columns]) of documents(doc_id, text).

    Removes each byte that a string of `length` bytes covers which also starts in a document with a smaller doc_id;
    matches stay within documents, and strings are judged on the input.  texts: also return the column
    kept, the remaining bytes, or kept_text, these as text without the stray bytes of characters cut in two;
    carry: other columns (strings and whole numbers) to return with each row.  A null text
    is empty; a null doc_id counts as larger than all others; rows of one doc_id remove nothing from each other; rows come
    back as often as they come; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    parts = max(4, docs.rdd.getNumPartitions())
    shards = 4 * parts  # a shard holds a few hundred thousand entries
    name = f"skein_{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in ROWS_AT_ONCE}
    try:
        chunks = chunk_table(docs, name, parts, carry)
        for k, v in ROWS_AT_ONCE.items():
            spark.conf.set(k, v)
        hot = hot_buckets(chunks, length)
        answers = stored(_answer_runs(_send_runs(chunks, shards, length, hot)))
        released(spark)
        settled = stored(_settle(chunks, answers, shards, length, hot))
        dropped(answers)
        released(spark)
        more = _answer_strings(settled)
        out = stored(_finish(chunks, settled.where("shard < 0").unionByName(more), shards, length, texts, [docs.schema[c] for c in carry]))
        dropped(settled)
        dropped(chunks)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        released(spark)
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return out
