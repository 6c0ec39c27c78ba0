"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over UTF-8 bytes, ORDER at a time, so an n-gram is one long.  It is fitted on the whole texts of all trusted documents (quality 1, not
toxic) but those held out for the thresholds.  Raw counts, continuation counts, context sums and interpolated probabilities
are tables sharded by n-gram, made by aggregates and equi-joins.  The finished model is packed by the executors and goes as
bytes to the tasks, which score all whole documents without a shuffle of text; it grows with the different n-grams of the trusted texts, far slower
than these, and more than MODEL_BYTES of it are an error.

A document is rejected if its perplexity exceeds its language's threshold, taken from quantiles of the log
perplexities of all of the language's trusted documents that were held out from the model, each scored whole: median + REACH x (UPPER quantile - median).  Before that, every
document is smoothed by SMOOTHING bytes at the median, as a few words say little.  Languages of
fewer than LEAST_KNOWN such documents take the quantiles of all.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import small_batches, stored

#: 5 tells better than 6: with REACH 2.5, of sf0.1, 98.5 % of the held-out clean documents are kept and 72 % of the toxic and 2.8 % of the bad ones (6: 98.6, 84 and 3.5 %).
ORDER = 5
#: Bytes of a trusted text that are counted at once; longer ones are counted a piece at a time.
TRUSTED_BYTES = 1 << 20
#: REACH: of 1, 1.25, 1.5, 1.75, 2, 2.5, 3 and 4 the least that keeps 98 % of the held-out clean documents of sf0.1, with quality 0 and toxic ones as bad.
UPPER, REACH = 0.9, 2.5
#: Bytes at the language's median that are added to each document before it is compared: short texts vary more.
SMOOTHING = 64
#: Packed bytes of the model at most.
MODEL_BYTES = 1 << 30
#: Bits (4 MB in all) that say which doc_ids may be trusted, so that few other texts move to meet those that are.
BITS = 1 << 25
#: One trusted document in so many, by the hash of doc_id, is kept from the model; the thresholds are set by all of these.
HELD_OUT = 4
#: Scored documents that a language's own quantiles need: of fewer, the upper one is that of one or two documents.
LEAST_KNOWN = 20
#: Symbols that the lowest order spreads its rest over.
SYMBOLS = 257


def packed(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-grams that end at each byte of the texts, as longs; where each text's run starts; its length.

    Before its start a text counts as zero bytes.
    """
    pad = bytes(order - 1)
    flat = np.frombuffer(pad + pad.join(texts) if texts else pad, np.uint8).astype(np.uint64)
    n = len(flat) - order + 1
    keys = np.zeros(n, np.uint64)
    for k in range(order):
        keys = (keys << np.uint64(8)) | flat[k : k + n]
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes[:-1] + order - 1))).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
    return keys.view(np.int64), starts, sizes


def _runs(keys: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which positions belong to a text rather than to the padding between texts."""
    mark = np.zeros(len(keys) + 1, np.int8)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + sizes, -1)
    return np.cumsum(mark[:-1], dtype=np.int8).astype(bool)


def counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, c): how often each n-gram of the highest order occurs in texts(text binary)."""
    most = TRUSTED_BYTES

    def counted(texts, pieces):
        # a piece sees the bytes before it; these are no ends of its n-grams
        keys, starts, sizes = packed(texts, order)
        own = _runs(keys, starts, sizes)
        if pieces:
            own[: order - 1] = False
        k, c = np.unique(keys[own], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(c.astype(np.int64))], ["key", "c"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            for text in b.column(0).to_pylist():
                held.append(text[:most])
                size += len(held[-1])
                for at in range(most, len(text), most):
                    yield counted([text[at - order + 1 : at + most]], True)
                if size >= most:
                    yield counted(held, False)
                    held, size = [], 0
        if held:
            yield counted(held, False)

    small_batches(texts.sparkSession)
    return texts.mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def _discounts(table: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the counts of counts (four sums)."""
    n = table.agg(*[F.sum((F.col("c") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (max(x or 0, 1) for x in n)
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.1), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def model(texts: DataFrame, order: int = ORDER) -> list[DataFrame]:
    """For n-grams of 1 to `order` bytes: (key, logp, rest); rest: log weight that the n-gram as a context leaves to shorter ones (null: it is no context)."""
    tables = {order: stored(counts(texts, order))}
    for k in range(order - 1, 0, -1):  # continuation counts: how many different bytes stand before
        tables[k] = stored(tables[k + 1].groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("key")).agg(F.count(F.lit(1)).alias("c")))
    shorter, out = None, []
    for k in range(1, order + 1):
        d1, d2, d3 = _discounts(tables[k])
        off = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        rows = tables[k].select("key", "c", F.shiftright("key", 8).alias("context"), off.alias("off"))
        sums = rows.groupBy("context").agg(F.sum("c").alias("total"), F.sum("off").alias("left")).select("context", "total", (F.col("left") / F.col("total")).alias("rest"))
        rows = rows.join(sums, "context")
        if shorter is None:
            p = (F.col("c") - F.col("off")) / F.col("total") + F.col("rest") / SYMBOLS
            probs = stored(rows.select("key", p.alias("p")))
            start = sums
        else:
            low = shorter.select(F.col("key").alias("suffix"), F.col("p").alias("q"))
            rows = rows.withColumn("suffix", F.col("key").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(low, "suffix")
            probs = stored(rows.select("key", ((F.col("c") - F.col("off")) / F.col("total") + F.col("rest") * F.col("q")).alias("p")))
            # a context of k - 1 bytes is an n-gram of the order below, or holds padding
            out[-1] = out[-1].join(sums.select(F.col("context").alias("key"), F.log("rest").alias("rest")), "key", "full")
        if k == 1:
            empty = start.select(F.log("rest").alias("rest"))
            out.append(empty)
        out.append(probs.select("key", F.log("p").alias("logp")))
        shorter = probs
    return out


class Table:
    """Longs to values by open addressing; lookups are whole-array."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 2.5))))
        self.shift = np.uint64(64 - bits)
        self.mask = np.int64((1 << bits) - 1)
        self.at = np.full(1 << bits, -1, np.int32)
        self.keys, self.values = keys, [np.append(v, np.nan) for v in values]  # -1, for no entry, reads as not a number
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        self.probes = 1
        while len(todo):
            free = self.at[slot] < 0
            self.at[slot[free]] = todo[free]
            lost = self.at[slot] != todo
            todo, slot = todo[lost], (slot[lost] + 1) & self.mask
            self.probes += bool(len(todo))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        slot = self._slot(keys)
        found = self.at[slot].astype(np.int64)
        wrong = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        for _ in range(self.probes):
            if not len(wrong):
                break
            slot[wrong] = (slot[wrong] + 1) & self.mask
            found[wrong] = f = self.at[slot[wrong]]
            wrong = wrong[(f >= 0) & (self.keys[f] != keys[wrong])]
        return found


class Scorer:
    """Log probabilities of byte strings under a finished model."""

    @classmethod
    def opened(cls, packed_model: list, order: int = ORDER) -> "Scorer":
        """A scorer from the packed parts of fit()."""
        tables: list = [packed_model[0]]
        for parts in packed_model[1:]:
            some = [pickle.loads(zstandard.decompress(x)) for x in parts] or [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
            tables.append((np.concatenate([np.cumsum(x[0]) for x in some]), *(np.concatenate([x[k] for x in some]) for k in (1, 2))))
        return cls(tables, order)

    def __init__(self, tables: list, order: int = ORDER):
        self.order = order
        self.rest0 = tables[0]
        self.tables = {k: Table(np.ascontiguousarray(t[0]), t[1], t[2]) for k, t in enumerate(tables[1:], 1)}

    def logp(self, keys: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(keys)), np.arange(len(keys))
        for k in range(self.order, 0, -1):
            part = keys[todo] & np.int64((1 << 8 * k) - 1) if k < 8 else keys[todo]
            found = self.tables[k].find(part)
            value = self.tables[k].values[0][found]
            known = ~np.isnan(value)
            out[todo[known]] += value[known]
            todo, part = todo[~known], part[~known]
            if not len(todo):
                return out
            if k > 1:
                rest = self.tables[k - 1].values[1][self.tables[k - 1].find(part >> np.int64(8))]
                out[todo] += np.where(np.isnan(rest), 0.0, rest)
            else:
                out[todo] += self.rest0
        out[todo] -= np.log(SYMBOLS)
        return out

    def score(self, texts: list[bytes], slice_bytes: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probability and bytes of each text."""
        sums, sizes = np.zeros(len(texts)), np.array([len(t) for t in texts], np.int64)
        at = 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (end == at or held + len(texts[end]) <= slice_bytes):
                held += len(texts[end])
                end += 1
            if held > slice_bytes:  # one long text, a piece at a time; each piece sees the bytes before it
                total, text = 0.0, texts[at]
                for i in range(0, len(text), slice_bytes):
                    before = text[max(0, i - self.order + 1) : i]
                    keys, _, _ = packed([before + text[i : i + slice_bytes]], self.order)
                    total += self.logp(keys[len(before) :]).sum()
                sums[at] = total
            else:
                keys, starts, size = packed(texts[at:end], self.order)
                p = self.logp(keys)
                total = np.concatenate(([0.0], np.cumsum(np.where(_runs(keys, starts, size), p, 0.0))))
                sums[at:end] = total[starts + size] - total[starts]
            at = end
        return sums, sizes


def _likely(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id may be one of ids(doc_id): all that are, and as many of the others as bits are set.  The bits are bounded, whatever the tables hold."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    bits = ids.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))
    met = rows.withColumns({"_bucket": F.bitmap_bucket_number(at), "_place": F.bitmap_bit_position(at)}).join(F.broadcast(bits), "_bucket")
    return met.where("shiftright(cast(conv(hex(substring(_bits, cast(_place div 8 as int) + 1, 1)), 16, 10) as int), cast(_place % 8 as int)) & 1 = 1").select(*rows.columns)


def _learnt(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text) of all trusted documents that are not held out, each different text of a doc_id once."""
    ids = stored(trusted(labels))
    rows = docs.where(F.col("text").isNotNull() & ~_held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # an inner join, as ids are distinct: a left_semi one would be pushed below the bits, and all texts would move
    once = _likely(rows, ids).join(ids, "doc_id").dropDuplicates(["doc_id", "text"])
    return once.select(F.col("text").cast("binary").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> list:
    """The finished model: [log rest of the empty context, packed parts per length] for Scorer.opened()."""
    parts = model(_learnt(docs, labels), order)
    first = parts[0].first()
    out: list = [first["rest"] if first and first["rest"] is not None else 0.0]

    def pack(batches):
        held = [[b.column(k).to_numpy(zero_copy_only=False) for k in range(3)] for b in batches]
        if held:
            keys, logp, rest = (np.concatenate([h[k] for h in held]) for k in range(3))
            by = np.argsort(keys)
            # keys rise within a part, so that their differences are small
            steps = np.diff(keys[by], prepend=np.int64(0))
            yield pa.RecordBatch.from_arrays([pa.array([zstandard.compress(pickle.dumps((steps, logp[by].astype(np.float64), rest[by].astype(np.float64)), 5), 1)], pa.binary())], ["part"])

    size = 0
    for part in parts[1:]:
        if "rest" not in part.columns:
            part = part.withColumn("rest", F.lit(None).cast("double"))
        out.append([bytes(r["part"]) for r in part.select("key", "logp", "rest").mapInArrow(pack, "part binary").collect()])
        size += sum(map(len, out[-1]))
    if size > MODEL_BYTES:
        raise RuntimeError(f"the model has {size} bytes, more than {MODEL_BYTES}")
    return out


def _held_out() -> F.Column:
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit("held out")), F.lit(HELD_OUT)) == 0


def trusted(labels: DataFrame) -> DataFrame:
    """doc_ids of labelled good documents, once each."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def perplexities(docs: DataFrame, sent, order: int = ORDER) -> DataFrame:
    """docs with n_bytes and log_perplexity (null for empty and null texts) by a broadcast model; docs has a column text, and none of these names."""
    at = docs.columns.index("text")

    def run(batches):
        scorer = Scorer.opened(sent.value, order)
        for b in batches:
            texts = [t.encode() if isinstance(t, str) else t or b"" for t in b.column(at).to_pylist()]
            sums, sizes = scorer.score(texts)
            with np.errstate(divide="ignore", invalid="ignore"):
                value = -sums / sizes
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes), pa.array(value, mask=sizes == 0)], [*b.schema.names, "n_bytes", "log_perplexity"])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("n_bytes", LongType()), StructField("log_perplexity", DoubleType())]))


def thresholds(known: DataFrame) -> DataFrame:
    """(lang, middle, threshold) on log perplexity, from scored documents that are trusted and held out; lang null: all of them.  Languages of fewer than LEAST_KNOWN have no row."""
    known = known.where("log_perplexity is not null")
    # quantile sketches of bounded size, merged after map-side partials
    q = F.percentile_approx("log_perplexity", F.array(F.lit(0.5), F.lit(UPPER)), 10_000)
    each = known.where("lang is not null").groupBy("lang").agg(q.alias("q"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_KNOWN).drop("n").unionByName(known.agg(q.alias("q")).withColumn("lang", F.lit(None).cast("string")))
    return each.select("lang", F.col("q")[0].alias("middle"), (F.col("q")[0] + REACH * (F.col("q")[1] - F.col("q")[0])).alias("threshold"))


def scored(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> DataFrame:
    """docs(doc_id, text, lang, ...) with n_bytes, log_perplexity, smoothed, limit and keep; no shuffle of text: what may be held out is scored twice."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    sent = docs.sparkSession.sparkContext.broadcast(fit(named, labels, order))
    # scored before they meet the labels, so that the join moves no text
    apart = perplexities(named.where(_held_out()), sent, order).select("doc_id", "lang", "log_perplexity")
    by = stored(thresholds(apart.join(trusted(labels), "doc_id", "left_semi")))
    general = by.where("lang is null").first()
    middle, limit = (F.lit(general[c] if general else None).cast("double") for c in ("middle", "threshold"))
    # one row a language
    own = F.broadcast(by.where("lang is not null").select(F.col("lang").alias("of"), F.col("middle").alias("own_middle"), F.col("threshold").alias("own")))
    out = perplexities(docs, sent, order)
    out = out.join(own, out["lang"] == own["of"], "left").withColumns({"middle": F.coalesce("own_middle", middle), "limit": F.coalesce("own", limit)})
    smooth = (F.col("log_perplexity") * F.col("n_bytes") + F.col("middle") * SMOOTHING) / (F.col("n_bytes") + SMOOTHING)
    return out.withColumns({"smoothed": smooth, "keep": F.coalesce(smooth <= F.col("limit"), F.lit(True))}).drop("of", "own", "own_middle", "middle")


def judge(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity, smoothed, threshold, keep) of documents(doc_id, text, lang) and labels(doc_id, quality, toxic).

    perplexity is per byte.  Null and empty texts have none and are kept, as is everything if no document is
    trusted; a null or unknown language takes the threshold of all languages; rows are judged as often as they come, null
    doc_ids too; an empty table gives no rows; other columns are ignored.
    """
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")), labels, order)
    return out.select("doc_id", "lang", "n_bytes", F.exp("log_perplexity").alias("perplexity"), F.exp("smoothed").alias("smoothed"), F.exp("limit").alias("threshold"), "keep")
