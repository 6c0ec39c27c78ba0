"""LM scoring by subword lattices: the marginal probability of a text over all segmentations of its words.

Pieces and their starting weights come from an existing SentencePiece vocabulary; the weights are then fitted to
the training documents by expectation maximisation over the lattices of all training words.  A word's
probability is the sum over all its segmentations, by a forward recursion in log space; a text's is the product over
its words and its end.  One more arc spans the whole word: a training word seen c times may also be taken as one
piece of weight (c - d) / N, with the absolute discount d, and the lattice of the vocabulary's pieces gets the weight so
left, d x V / N.  So may a word that the document has used before.  Counts are kept by language, and a document's
probability is that of a mixture of the languages; its own label is not used.  Without these arcs the vocabulary's pieces alone,
made for other text, score far below a word count; their marginal, of all segmentations into pieces and nothing else, is
returned beside the score.

Nothing is exploded per token.  A task turns about CHUNK_BYTES of text into one chunk: a dictionary of its distinct
words, dealt to buckets by hash, and its documents as sparse counts over that dictionary.  Chunks are a stored
table.  Each bucket sums its words over all chunks and answers every chunk with the corpus counts of its words; a
chunk with its answers scores its documents.  Buckets grow in number with the input, so neither side grows in a
task.  Only sums over the vocabulary's pieces reach the driver.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored
from .sentencepiece import MODEL, load

CHUNK_BYTES = 6 << 20
ROUNDS = 4
#: Words' worth of the corpus's probabilities that a document's own words are weighed against.
PRIOR = 1000.0
#: Languages with counts of their own, most frequent first; the others are one more class.
CLASSES = 8
#: What a class leaves to the lattice at once; the rest goes by way of all classes.
SHARE = 0.8
#: The chunk of rows that concern all chunks.
ALL = -1
LN10 = np.log(10.0)
_MARK = "▁".encode()
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and lengths of all lower-cased words of the texts, one after another; words in each text."""
    blob = b" ".join(texts).lower()
    flat = np.frombuffer(blob, np.uint8)
    space = _SPACE[flat]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1]))) if len(flat) else np.zeros(0, np.int64)
    ends = np.flatnonzero(~space & np.concatenate((space[1:], [True]))) + 1 if len(flat) else starts
    edges = np.cumsum([len(t) + 1 for t in texts])
    per = np.diff(np.concatenate(([0], np.searchsorted(starts, edges)))) if len(texts) else np.zeros(0, np.int64)
    return flat[~space], ends - starts, per


def binaries(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """An Arrow array of byte strings that stand one after another."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def parts_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and lengths of an Arrow array of byte strings."""
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, np.diff(offsets)


def hashes(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte string, from prefix sums of a polynomial."""
    powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(data), _ODD))))
    sums = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1])))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    back = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(data), _INVERSE))))
    h = (sums[ends] - sums[starts]) * back[starts]
    h ^= h >> np.uint64(29)
    return h * _ODD


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, 5), 1)


def _unpack(blob: bytes) -> tuple:
    return pickle.loads(zstandard.decompress(blob))


def _chunk(ids: list, held: list[bool], kinds: list[int], texts: list[bytes], buckets: int, classes: int):
    """One row of the chunk table: its documents over its dictionary, and the dictionary's words by bucket."""
    data, lengths, per = words_of(texts)
    coded = binaries(data, lengths).dictionary_encode()
    token = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    flat, sizes = parts_of(coded.dictionary)
    bucket = (hashes(flat, sizes) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    doc = np.repeat(np.arange(len(texts)), per)
    seen = ~np.asarray(held, bool)[doc]
    train = np.bincount(place[token[seen]] * classes + np.asarray(kinds, np.int64)[doc[seen]], minlength=len(order) * classes).reshape(-1, classes).astype(np.int32)
    pairs, n = np.unique(doc * max(len(order), 1) + place[token], return_counts=True)
    body = _pack(ids, held, per, np.bincount(pairs // max(len(order), 1), minlength=len(texts)), np.diff(pairs, prepend=0).astype(np.int64 if len(pairs) and pairs[-1] > 2**31 else np.int32), n.astype(np.int32), len(order))
    words = coded.dictionary.take(pa.array(order))
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    parts = []
    for k in range(buckets):
        a, b = cuts[k], cuts[k + 1]
        parts.append(_pack(*parts_of(words.slice(a, b - a)), train[a:b]) if b > a else None)
    return body, parts


def chunk_table(docs: DataFrame, buckets: int, classes: list[str]) -> DataFrame:
    """(chunk, body, parts) of documents(doc_id, text, lang); classes: the languages that have a class of their own."""
    number = {name: k for k, name in enumerate(classes)}

    def run(batches):
        import uuid

        ids, held, kinds, texts, size = [], [], [], [], 0
        schema = pa.schema([("chunk", pa.int64()), ("body", pa.binary()), ("parts", pa.list_(pa.binary()))])

        def row():
            body, parts = _chunk(ids, held, kinds, texts, buckets, len(classes) + 1)
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65]), pa.array([body], pa.binary()), pa.array([parts], pa.list_(pa.binary()))], schema=schema)

        for b in batches:
            for i, h, c, t in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                ids.append(i)
                held.append(h)
                kinds.append(number.get(c, len(classes)))
                texts.append(t)
                size += len(t)
                if size >= CHUNK_BYTES:
                    yield row()
                    ids, held, kinds, texts, size = [], [], [], [], 0
        if ids:
            yield row()

    small_batches(docs.sparkSession)
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held"), F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, "chunk long, body binary, parts array<binary>")


def count_table(chunks: DataFrame) -> DataFrame:
    """What each bucket answers: (chunk, bucket, counts) to each chunk, and one row for all of them: its training words, and by class and for all classes their tokens n, types v, and the types seen once and twice."""

    def run(pdf):
        import pandas as pd

        bucket = int(pdf["bucket"].iloc[0])
        parts = [_unpack(x) for x in pdf["part"]]
        coded = binaries(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])).dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        given = np.concatenate([p[2] for p in parts])
        total = np.stack([np.bincount(index, given[:, k], minlength=len(coded.dictionary)) for k in range(given.shape[1])], axis=1).astype(np.int64)
        cuts = np.cumsum([0] + [len(p[1]) for p in parts])
        rows = [(int(c), bucket, _pack(total[index[a:b]].astype(np.int32 if total.max(initial=0) < 2**31 else np.int64)), [], [], [], []) for c, a, b in zip(pdf["chunk"], cuts, cuts[1:], strict=False)]
        known = np.flatnonzero(total.any(axis=1))
        both = np.column_stack((total, total.sum(axis=1)))
        rows.append((ALL, bucket, _pack(*parts_of(coded.dictionary.take(pa.array(known)))), *(x.tolist() for x in (both.sum(axis=0), (both > 0).sum(axis=0), (both == 1).sum(axis=0), (both == 2).sum(axis=0)))))
        out = pd.DataFrame(rows, columns=["chunk", "bucket", "counts", "n", "v", "once", "twice"])
        return out

    return chunks.select("chunk", F.posexplode("parts").alias("bucket", "part")).where("part is not null").groupBy("bucket").applyInPandas(run, "chunk long, bucket int, counts binary, n array<long>, v array<long>, once array<long>, twice array<long>")


class Lattice:
    """Pieces as a byte trie with log weights; sums over all segmentations of many words at once."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        """pieces: their bytes, b"" for those that are never part of a word."""
        self.n = len(pieces)
        rows: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for k, piece in enumerate(pieces):
            if not piece:
                continue
            at = 0
            for byte in piece:
                if byte not in rows[at]:
                    rows[at][byte] = len(rows)
                    rows.append({})
                    ends.append([])
                at = rows[at][byte]
            ends[at].append(k)
        # bytes that no piece holds share a column that leads nowhere
        used = sorted({byte for row in rows for byte in row})
        self.column = np.full(256, len(used), np.uint8 if len(used) < 256 else np.int16)
        self.column[used] = np.arange(len(used))
        inner = [k for k, row in enumerate(rows) if row]
        # nodes with pieces below them come first, so that only they need a row
        name = np.empty(len(rows), np.int32)
        name[inner] = np.arange(len(inner))
        name[[k for k, row in enumerate(rows) if not row]] = np.arange(len(inner), len(rows))
        self.inner = len(inner)
        self.step = np.zeros((len(inner) + 1, len(used) + 1), np.int32)
        for k in inner:
            for byte, to in rows[k].items():
                self.step[name[k], self.column[byte]] = name[to]
        moved = [[] for _ in rows]
        for k, e in enumerate(ends):
            moved[name[k]] = e
        ends = moved
        del rows
        # a single character can be a piece and a byte piece: both end there
        self.first = np.array([e[0] if e else -1 for e in ends], np.int32)
        self.second = np.array([e[1] if len(e) > 1 else -1 for e in ends], np.int32)
        self.weigh(logp)

    def weigh(self, logp: np.ndarray) -> None:
        self.logp = np.append(logp, -np.inf)
        one, two = self.logp[self.first], self.logp[self.second]
        self.node = np.logaddexp(one, two)

    def _groups(self, data: np.ndarray, lengths: np.ndarray, most: int):
        """Words of one length at a time, marked, as rows of bytes."""
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order], prepend=-1, append=-1))
        for a, b in zip(cuts, cuts[1:], strict=False):
            size = int(lengths[order[a]])
            per = max(1, most // (size + 3))
            for i in range(a, b, per):
                rows = order[i : min(b, i + per)]
                chars = np.empty((size + 3, len(rows)), np.uint8)
                chars[:3] = np.frombuffer(_MARK, np.uint8)[:, None]
                if size:
                    chars[3:] = data[starts[rows][None, :] + np.arange(size)[:, None]]
                yield rows, self.column[chars]

    def _forward(self, chars: np.ndarray, arcs: list | None = None) -> np.ndarray:
        t, n = chars.shape
        alpha = np.full((t + 1, n), -np.inf)
        alpha[0] = 0.0
        for i in range(t):
            live = np.flatnonzero(alpha[i] > -np.inf)
            state = np.zeros(len(live), np.int32)
            for j in range(i, t):
                state = self.step[np.minimum(state, self.inner), chars[j, live]]
                on = state > 0
                if not on.all():
                    live, state = live[on], state[on]
                if not len(live):
                    break
                w = self.node[state]
                ends = w > -np.inf
                if ends.any():
                    e, s = live[ends], state[ends]
                    alpha[j + 1, e] = np.logaddexp(alpha[j + 1, e], alpha[i, e] + w[ends])
                    if arcs is not None:
                        arcs.append((i, j + 1, e, s))
        return alpha

    def word_logps(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Natural log of the marginal probability of each word."""
        out = np.zeros(len(lengths))
        for rows, chars in self._groups(data, lengths, 1 << 18):
            out[rows] = self._forward(chars)[-1]
        return out

    def expected(self, data: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations of the words, each counted so often."""
        node = np.zeros(len(self.first))
        for rows, chars in self._groups(data, lengths, 1 << 17):
            arcs: list = []
            alpha = self._forward(chars, arcs)
            t = len(chars)
            beta = np.full_like(alpha, -np.inf)
            beta[t] = 0.0
            c = counts[rows]
            for i, j, e, s in reversed(arcs):
                beta[i, e] = np.logaddexp(beta[i, e], beta[j, e] + self.node[s])
            total = alpha[t]
            for i, j, e, s in arcs:
                node += np.bincount(s, np.exp(alpha[i, e] + self.node[s] + beta[j, e] - total[e]) * c[e], minlength=len(node))
        out = np.zeros(self.n + 1)
        with np.errstate(invalid="ignore"):
            for kind in (self.first, self.second):
                share = np.exp(self.logp[kind] - self.node)
                np.add.at(out, kind, np.where(kind >= 0, np.nan_to_num(share) * node, 0.0))
        return out[:-1]


def vocabulary(model: str = MODEL) -> tuple[list[bytes], np.ndarray, int]:
    """Pieces, starting log weights from the vocabulary's scores, and the end piece.

    A unigram model's scores are log probabilities; a BPE model's are ranks, which start as Zipf weights.
    """
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(load(model))
    pieces, weight, end = [], np.zeros(len(m.pieces)), -1
    for k, p in enumerate(m.pieces):
        if p.type == 6:
            pieces.append(bytes([int(p.piece[3:5], 16)]))
            weight[k] = 1e-7
        elif p.type in (1, 4):
            pieces.append(p.piece.encode())
            weight[k] = 1 / (10 + max(0.0, -p.score)) if m.trainer_spec.model_type == 2 else np.exp(p.score)
        else:
            pieces.append(b"")
            if p.piece == m.trainer_spec.eos_piece:
                end, weight[k] = k, 1e-3
    if end < 0:
        raise ValueError("the vocabulary has no end piece")
    with np.errstate(divide="ignore"):
        return pieces, np.log(weight / weight.sum()), end


_LATTICES: dict = {}


def _lattice(pieces: list[bytes], logp: np.ndarray) -> Lattice:
    """The lattice of this Python worker, with the given weights."""
    key = len(pieces), hash(tuple(pieces[-50:]))
    if key not in _LATTICES:
        _LATTICES.clear()
        _LATTICES[key] = Lattice(pieces, logp)
    _LATTICES[key].weigh(logp)
    return _LATTICES[key]


def fit(counts: DataFrame, documents: int, model: str = MODEL, rounds: int = ROUNDS) -> tuple[list[bytes], np.ndarray, int]:
    """Pieces, fitted log weights and the end piece from the training words of count_table()."""
    pieces, logp, end = vocabulary(model)
    spark = counts.sparkSession
    usable = np.array([bool(p) for p in pieces])
    for _ in range(rounds if documents else 0):
        sent = spark.sparkContext.broadcast((pieces, logp))

        def run(batches, sent=sent):
            lattice = _lattice(*sent.value)
            total = np.zeros(lattice.n)
            for b in batches:
                for blob in b.column(0).to_pylist():
                    data, lengths = _unpack(blob)  # each type once: the lattice stands for words not seen
                    total += lattice.expected(data, lengths, np.ones(len(lengths)))
            k = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["piece", "uses"])

        # one row per piece of the vocabulary
        sums = counts.where(f"chunk = {ALL}").select("counts").mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toPandas()
        uses = np.where(usable, 1e-2, 0.0)
        uses[sums["piece"].to_numpy(np.int64)] += sums["uses"].to_numpy()
        uses[end] = documents + 1e-2
        with np.errstate(divide="ignore"):
            logp = np.log(uses / uses.sum())
        sent.destroy()
    return pieces, logp, end


def end_logp(pieces: list[bytes], logp: np.ndarray, end: int) -> float:
    """Natural log probability that a text ends here rather than goes on with a word: inner pieces cannot follow."""
    start = np.array([p.startswith(_MARK[:1]) for p in pieces])
    return float(logp[end] - np.logaddexp(logp[end], np.logaddexp.reduce(logp[start]) if start.any() else -np.inf))


def reuse(word: np.ndarray, times: np.ndarray, doc: np.ndarray, per: np.ndarray, end: float, prior: float = PRIOR) -> np.ndarray:
    """log10 probability of documents whose words may also be taken from what stands before.

    word: log10 p of each distinct word of a document, times: how often it stands there.  At the t-th word (from 0), one
    that has come k times before has (k + prior x p) / (t + prior); the product does not depend on the order.
    """
    scale = np.log1p(-min(10.0**end, 0.5)) / LN10  # words share what the end leaves
    p = np.maximum(10.0 ** np.minimum(word - scale, 0.0), 1e-300) * prior
    rest = np.zeros(len(word))
    often = times > 1  # the first use is log(prior x p), exact for any p
    rest[often] = lgamma(p[often] + times[often]) - lgamma(p[often] + 1.0)
    first = (word - scale) * LN10 + np.log(prior)
    total = np.bincount(doc, first + rest, minlength=len(per)) - (lgamma(per + prior) - lgamma(np.full(len(per), prior)))
    return total / LN10 + per * scale + end


def lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x > 0: Stirling's series after a shift of 8."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    z = x + 8.0
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * z * z)) / (z * z)) / (z * z)) / z - shift


def score(docs: DataFrame, model: str = MODEL, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score) of documents(doc_id, text).

    score: the model's log10 probability; lattice_score: that of the vocabulary's pieces alone, without arcs of whole words.
    Learns from documents whose crc32(doc_id as text) mod 10 is not 0 (a null doc_id counts as the empty text).
    Null and empty texts have one token, their end.  Words of any length are scored whole.  Repeated rows are scored
    and counted as often as they come; with no training documents the vocabulary's own weights stand and every base
    count is zero; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    often = docs.where(~held).groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(CLASSES + 1).collect()
    classes = [r["lang"] for r in often if r["lang"] is not None][:CLASSES]
    documents = docs.where(~held).count()
    own = {r["lang"]: r["n"] for r in often}
    share = np.array([*(own[c] for c in classes), documents - sum(own[c] for c in classes)], np.float64)
    buckets = max(8, docs.rdd.getNumPartitions())
    chunks = stored(chunk_table(docs, buckets, classes))
    counts = stored(count_table(chunks))
    names = ("n", "v", "once", "twice")
    rows = counts.where(f"chunk = {ALL}").select(F.posexplode(F.arrays_zip(*names)).alias("k", "z")).groupBy("k").agg(*[F.sum(f"z.{c}").alias(c) for c in names]).collect()  # one row per class
    total = np.zeros((4, len(classes) + 2), np.int64)
    for r in rows:
        total[:, r["k"]] = [r[c] for c in names]
    # an end is a token too; each class ends as often as it has documents
    size = total[0] + np.append(share, documents).astype(np.int64)
    types = total[1] + (np.append(share, documents) > 0)
    discount = np.clip(total[2] / np.maximum(total[2] + 2 * total[3], 1), 0.1, 0.9)
    n, v = int(size[-1]), int(types[-1])
    pieces, logp, end = fit(counts, documents, model, rounds)
    sent = spark.sparkContext.broadcast((pieces, logp, end_logp(pieces, logp, end)))

    def run(key, left, right):
        import pandas as pd

        pieces, logp, last = sent.value
        lattice = _lattice(pieces, logp)
        floor = np.log10(n + 0.1 * (v + 1))
        answers = dict(zip(right["bucket"], right["counts"], strict=True))
        out = []
        for body, parts in zip(left["body"], left["parts"], strict=True):
            ids, is_held, per, pairs, steps, times, words = _unpack(body)
            c, lm = [], []
            for k, part in enumerate(parts):
                if part is not None:
                    data, lengths, _ = _unpack(part)
                    c.append(_unpack(answers[k])[0])
                    lm.append(lattice.word_logps(data, lengths))
            c = np.concatenate(c) if c else np.zeros((0, len(share)), np.int64)
            lm = np.concatenate(lm) if lm else np.zeros(0)
            word = np.cumsum(steps.astype(np.int64)) % max(words, 1)
            doc = np.repeat(np.arange(len(ids)), pairs)
            add = lambda x: np.bincount(doc, x * times, minlength=len(ids))  # noqa: E731, B023
            every = c.sum(axis=1)
            base = add(np.log10(every + 0.1)[word] - floor)
            joint = []
            for k in range(len(share)):
                if share[k] or not n:
                    one = lambda c, e, x: mixed(c, e, x, size[[k, -1]], types[[k, -1]], discount[[k, -1]])  # noqa: E731, B023
                    prior = np.log10(share[k] / documents) if n else 0.0
                    joint.append(prior + reuse(one(c[:, k], every, lm)[word], times, doc, per, float(one(share[k], documents, last))))
                if not n:
                    break
            best = np.max(joint, axis=0)
            score = best + np.log10(np.sum(10.0 ** (np.array(joint) - best), axis=0))
            out.append(
                pd.DataFrame(
                    {
                        "doc_id": pd.array(ids, "Int64"),
                        "held_out": is_held,
                        "n_tokens": per + 1,
                        "n_known": add((every > 0)[word]).astype(np.int64) + (documents > 0),
                        "train_tokens": n,
                        "base_score": base + np.log10(documents + 0.1) - floor,
                        "score": score,
                        "lattice_score": (add(lm[word]) + last) / LN10,
                    }
                )
            )
        return pd.concat(out) if out else pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score"])

    return chunks.groupBy("chunk").cogroup(counts.where(f"chunk <> {ALL}").groupBy("chunk")).applyInPandas(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double")


def mixed(c, every, lm, size, types, discount):
    """log10 probability of a token in one class: its count there, then with SHARE each the lattice and all classes, which leave the rest to the lattice.

    c, every: its training counts in the class and in all; lm: natural log of its lattice; size, types, discount: of the class and of all.
    """
    if not size[1]:
        return lm / LN10
    lattice = np.exp(lm)
    broad = (np.maximum(every - discount[1], 0.0) + discount[1] * types[1] * lattice) / size[1]
    own = np.maximum(c - discount[0], 0.0) + discount[0] * types[0] * (SHARE * lattice + (1 - SHARE) * broad)
    with np.errstate(divide="ignore"):
        small = np.log(discount[0] * types[0] / size[0] * (SHARE + (1 - SHARE) * discount[1] * types[1] / size[1])) + lm  # what stands where exp(lm) is zero
        return np.maximum(np.log(own / size[0]), small) / LN10


__all__ = ["score", "fit", "Lattice", "vocabulary", "words_of", "hashes"]
