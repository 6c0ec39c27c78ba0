"""SentencePiece encoding and decoding with one trie traversal per batch of words.

Texts are cut into marked words (a run of the space mark and what follows), the distinct marked words of a
batch are sorted, and the sorted list is walked depth-first as a trie: the forward states of a common prefix are
computed once and reused by every word below it.  A forward state is the best last piece of the prefix:

* unigram models: the piece that maximises the sum of scores (Viterbi);
* BPE models: a prefix has one stable segmentation, and its last piece is the one that the merges keep beside the
  last piece of what stands before it.  Whether two neighbours are kept is decided by merging the two alone, and
  remembered.  This gives the merges' own result, which the sum of BPE ranks would not.

No shuffle takes place: each task encodes its own rows and keeps the words that it has seen (a cache whose
size is bounded; it is emptied, never consulted beyond its bound, so results do not depend on it).
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Marked words that a Python worker remembers: so many new ones, and as many from before.
CACHE_WORDS = 250_000
#: Stands for no piece; numbers from CHARS on stand for characters that are no piece.
EMPTY, CHARS, FAR = -1, 1 << 21, 1 << 22


class Vocabulary:
    """Pieces, scores and model type of a SentencePiece model file (its bytes)."""

    def __init__(self, proto: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(proto)
        spec = m.normalizer_spec
        if spec.name != "identity" or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models with identity normalisation are supported")
        self.prefix = MARK if spec.add_dummy_prefix else ""
        self.bpe = m.trainer_spec.model_type == 2
        self.unknown = 0
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes = [0] * 256
        self.table: list[bytes] = []
        for k, p in enumerate(m.pieces):
            out = b""
            if p.type == 6:
                value = int(p.piece[3:5], 16)
                self.bytes[value], out = k, bytes([value])
            elif p.type in (1, 4):
                self.ids[p.piece], self.scores[p.piece] = k, p.score
                out = p.piece.replace(MARK, " ").encode()
            elif p.type == 2:
                self.unknown = k
            self.table.append(out)
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("pieces that go on past a space are not supported")
        alone = {c for p in self.ids if len(p) > 1 for c in p}
        self.split_newline = "\n" not in alone
        self.words = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+" if self.split_newline else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.pieces = [p.piece for p in m.pieces]
        self.scores_by_id = [p.score for p in m.pieces]
        self.neighbours: dict[int, bool] = {}
        #: Pieces by their characters from the last to the first: character -> (more, piece or EMPTY).
        self.endings: dict[str, tuple[dict, int]] = {}
        for piece, k in self.ids.items():
            here, chars = self.endings, piece[::-1]
            for n, c in enumerate(chars):
                more, held = here.get(c, ({}, EMPTY))
                here[c] = (more, k if n == len(chars) - 1 else held)
                here = more

    def merged(self, text: str) -> list[str]:
        """The merges' result on a short text, one merge at a time: best score first, then leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.scores[p], -k) for k in range(len(parts) - 1) if (p := parts[k] + parts[k + 1]) in self.scores), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def kept(self, left: int, right: int) -> bool:
        """Whether the merges leave two pieces side by side as they are; left may be the empty piece."""
        a, b = self.name(left), self.name(right)
        if len(self.neighbours) > 2_000_000:
            self.neighbours.clear()
        known = self.neighbours[left * FAR + right] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def name(self, k: int) -> str:
        """The string of a piece, or of a character that is no piece."""
        return "" if k == EMPTY else self.pieces[k] if k < CHARS else chr(k - CHARS)

    def output(self, k: int) -> list[int]:
        """The ids that a piece is written as: its own, or those of its bytes."""
        return [k] if k < CHARS else [self.bytes[b] for b in chr(k - CHARS).encode()]


def encode_words(words: list[str], v: Vocabulary) -> dict[str, bytes]:
    """Ids (int32 bytes) of distinct marked words, sorted and walked as a trie."""
    out: dict[str, bytes] = {}
    last, came, best = [EMPTY], [0], [0.0]  # of each prefix of the current path: its last piece, where that starts, its score
    worst = min(v.scores.values(), default=0.0) - 10.0
    seen, kept, endings, scores, bpe, far = v.neighbours, v.kept, v.endings, v.scores_by_id, v.bpe, FAR
    before = ""
    for word in sorted(words):
        common, most = 0, min(len(before), len(word))
        while common < most and before[common] == word[common]:
            common += 1
        del last[common + 1 :], came[common + 1 :], best[common + 1 :]
        for end in range(common + 1, len(word) + 1):
            start = end - 1
            char = word[start]
            node = endings.get(char)
            if node is None or node[1] == EMPTY:
                alone = CHARS + ord(char)
                node = (node[0] if node else {}, alone)
            if bpe:
                while True:
                    piece = node[1]
                    if piece != EMPTY:
                        known = seen.get(last[start] * far + piece)
                        if known or known is None and kept(last[start], piece):
                            break
                    start -= 1
                    node = node[0][word[start]]
                last.append(piece)
                came.append(start)
            else:
                value, piece, at = float("-inf"), EMPTY, 0
                while node is not None:
                    if node[1] != EMPTY and (x := best[start] + (scores[node[1]] if node[1] < CHARS else worst)) >= value:
                        value, piece, at = x, node[1], start
                    start -= 1
                    node = node[0].get(word[start]) if start >= 0 else None
                last.append(piece)
                came.append(at)
                best.append(value)
        end, pieces = len(word), []
        while end:
            pieces.append(last[end])
            end = came[end]
        pieces.reverse()
        if max(pieces) >= CHARS:
            pieces = [k for p in pieces for k in v.output(p)]
        out[word] = array("i", pieces).tobytes()
        before = word
    return out


class Encoder:
    """Encodes batches of texts; remembers words up to a bound."""

    def __init__(self, proto: bytes):
        self.v = Vocabulary(proto)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """int32 ids of each text as bytes; null and empty texts have none."""
        cut = [self.v.words.findall(self.v.prefix + t.replace(" ", MARK)) if t else [] for t in texts]
        here = set().union(*cut)
        if len(self.known) + len(here) > CACHE_WORDS:  # words not met again before the next turn are forgotten
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = here.difference(known)
        again = new.intersection(older)
        known.update((w, older[w]) for w in again)
        known.update(encode_words(list(new - again), self.v))
        return [b"".join(map(known.__getitem__, ws)) for ws in cut]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the marked prefix of the first word is dropped.  Control and unknown ids have no text."""
        table = self.v.table
        raw = b"".join([table[k] for k in ids])
        if self.v.prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_ENCODERS: dict[int, Encoder] = {}


def encoder(proto: bytes) -> Encoder:
    """One encoder per Python worker and model."""
    key = hash(proto)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(proto)
    return _ENCODERS[key]


def load(model: str = MODEL) -> bytes:
    with open(model, "rb") as f:  # half a MB; sent to the tasks with the function
        return f.read()


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids, n_tokens) of documents(doc_id, text).

    ids are those of the SentencePiece library.  Null and empty texts have no ids; very long texts are encoded
    whole; rows are returned as they come, repeated ones and null doc_ids too; other columns are ignored.
    """
    proto = load(model)

    def run(batches):
        e = encoder(proto)
        for b in batches:
            ids = e.encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(ids), pa.array([len(x) // 4 for x in ids], pa.int64())], ["doc_id", "ids", "n_tokens"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give a null text."""
    proto = load(model)

    def run(batches):
        e = encoder(proto)
        for b in batches:
            texts = [None if ids is None else e.decode(ids) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    small_batches(encoded.sparkSession)
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids, n_tokens, decoded_sha256, exact): encode each text, decode its ids, and compare.

    decoded_sha256: lowercase hex of the decoded text's UTF-8; exact: it equals the text (null: empty).  A text
    that holds the space mark itself decodes with spaces and is therefore not exact.
    """
    import hashlib

    proto = load(model)

    def run(batches):
        e = encoder(proto)
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = e.encode(texts)
            decoded = [e.decode(np.frombuffer(x, np.int32).tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    _lists(ids),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
                    pa.array([d == (t or "") for d, t in zip(decoded, texts, strict=True)], pa.bool_()),
                ],
                ["doc_id", "ids", "n_tokens", "decoded_sha256", "exact"],
            )

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, decoded_sha256 string, exact boolean")


def lengths(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens): encoded lengths without the ids."""
    proto = load(model)

    def run(batches):
        e = encoder(proto)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in e.encode(b.column(1).to_pylist())], pa.int64())], ["doc_id", "n_tokens"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def _lists(ids: list[bytes]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids], dtype=np.int64))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))
