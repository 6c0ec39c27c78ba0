"""Byte-level BPE encoding and decoding by forced boundaries.

A pair of bytes that stands inside no token of the vocabulary can never be merged over, whatever surrounds it: between
the two is a certain cut.  Texts are taken apart at special tokens, then into the pattern's pieces, and pieces at their
certain cuts.  What lies between two cuts is encoded by itself, merges of lowest rank first, and the ids are put together again.

A piece's ids do not depend on its neighbours, so a task encodes each of its distinct pieces once and keeps them
(as many as stated; results do not depend on what is kept).  No shuffle takes place.  A fragment of n bytes takes n log n
steps, so a text without any cut is no special case.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .sentencepiece import _lists

#: Pieces that a Python worker remembers: so many new ones, and as many from before; longer ones are not kept.
CACHE_PIECES, LONGEST = 400_000, 64
#: Fragments of up to so many bytes are merged with all others of their size, longer ones by themselves with a heap.
SHORT = 48
#: Characters of the texts that are taken at a time.
GROUP = 1 << 20
#: More than any id.
FAR = 1 << 31

# The pattern of this kind of vocabulary, the bytes that are written as themselves.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of plain characters only, in terms that the standard library's faster matcher knows.
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file -> the byte."""
    rest = [b for b in range(256) if b not in set(PRINTED)]
    return {chr(b): b for b in PRINTED} | {chr(256 + k): b for k, b in enumerate(rest)}


def _plain(c: str) -> bool:
    """Whether both patterns class a character alike: no number but decimal digits, no separator of old, and known to Python's tables."""
    return unicodedata.category(c) != "Cn" and not "\x1c" <= c <= "\x1f" and (not c.isalnum() or c.isalpha() or c.isdecimal())


class Vocabulary:
    """Tokens, merges and certain cuts of a tokenizer file (its JSON text)."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        if model["type"] != "BPE" or not plain or spec["normalizer"] or spec["post_processor"] or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError("only byte-level BPE without normalisation, prefix and post-processing is supported")
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab = {raw(t): k for t, k in model["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that take in what stands beside them are not supported")
        self.table = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for t, k in [*vocab.items(), *((s.encode(), k) for s, k in special.items())]:
            self.table[k] = t
        self.single = [vocab[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = map(raw, pair if isinstance(pair, list) else pair.split(" "))
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        # the same for many fragments at once: pairs as sorted numbers, their ranks, what each rank's merge makes
        pairs = sorted((a * FAR + b, rank) for (a, b), (rank, _) in self.merges.items())
        self.pairs = np.array([p for p, _ in pairs] + [1 << 62], np.int64)
        self.ranks = np.array([r for _, r in pairs] + [0], np.int32)
        self.results = np.zeros(len(model["merges"]), np.int32)
        for rank, new in self.merges.values():
            self.results[rank] = new
        self.singles = np.array(self.single, np.int32)
        #: Byte pairs inside some token: first * 256 + second.
        self.inside = np.zeros(1 << 16, bool)
        self.inside[[t[i] << 8 | t[i + 1] for t in vocab for i in range(len(t) - 1)]] = True
        self.special = special
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pieces, self.quick = regex.compile(PATTERN), re.compile(PLAIN)
        self.plain: set[str] = set()

    def pattern(self, text: str) -> list[str]:
        """The pattern's pieces of a text.  One with characters newer than Python's tables is split by the tokenizers library, as those classify them otherwise."""
        rare = set(text).difference(self.plain)
        if rare:
            plain = set(filter(_plain, rare))
            self.plain |= plain
            rare -= plain
        if not rare:
            return self.quick.findall(text)
        if not any(unicodedata.category(c) == "Cn" for c in rare):
            return self.pieces.findall(text)
        from tokenizers.pre_tokenizers import ByteLevel

        return [text[a:b] for _, (a, b) in ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text)]

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Where bytes have a certain cut before them."""
        return np.flatnonzero(~self.inside[data[:-1].astype(np.int32) << 8 | data[1:]]) + 1

    def encoded(self, pieces: list[str]) -> dict[str, bytes]:
        """The int32 ids of pieces: all of them are cut at once, and fragments of one size merged at once."""
        raw = [p.encode() for p in pieces]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(x) for x in raw])
        cut = np.zeros(len(data) + 1, bool)
        cut[0] = cut[ends] = True
        cut[self.cuts(data)] = True
        at = np.flatnonzero(cut)
        starts, sizes = at[:-1], np.diff(at)
        out = np.full(len(data), -1, np.int32)  # a fragment's ids stand where it starts
        for size in np.unique(sizes).tolist():
            of = starts[sizes == size]
            if size > SHORT:
                for i in of.tolist():
                    ids = self.merged(data[i : i + size].tobytes())
                    out[i : i + len(ids)] = ids
            else:
                for rows, ids in self.merged_alike(self.singles[data[of[:, None] + np.arange(size)]]):
                    out[of[rows][:, None] + np.arange(ids.shape[1])] = ids
        kept = out >= 0
        held, stops = out[kept].tobytes(), (np.cumsum(kept)[ends - 1] * 4).tolist()
        return {p: held[a:z] for p, a, z in zip(pieces, [0, *stops], stops, strict=False)}

    def ranked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids; those that are never merged have the number of merges."""
        pairs = a.astype(np.int64) * FAR + b
        at = np.searchsorted(self.pairs, pairs)
        return np.where(self.pairs[at] == pairs, self.ranks[at], len(self.results))

    def merged_alike(self, ids: np.ndarray):
        """Fragments of one size, a row each, merged once in each round: (rows, their ids) as they are done."""
        rows = np.arange(len(ids))
        ranks = self.ranked(ids[:, :-1], ids[:, 1:])
        while ids.shape[1] > 1:
            i = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), i]
            done = best == len(self.results)
            if done.any():
                yield rows[done], ids[done]
                rows, ids, ranks, i, best = (x[~done] for x in (rows, ids, ranks, i, best))
            if not len(rows):
                return
            here, width = np.arange(len(rows)), ids.shape[1] - 1
            step = np.arange(width)[None, :]
            ids = np.take_along_axis(ids, step + (step > i[:, None]), axis=1)  # what follows moves up
            ids[here, i] = self.results[best]
            step = step[:, : width - 1]
            ranks = np.take_along_axis(ranks, step + (step >= i[:, None]), axis=1)
            left, right = i > 0, i < width - 1
            ranks[here[left], i[left] - 1] = self.ranked(ids[here[left], i[left] - 1], ids[here[left], i[left]])
            ranks[here[right], i[right]] = self.ranked(ids[here[right], i[right]], ids[here[right], i[right] + 1])
        yield rows, ids

    def merged(self, fragment: bytes) -> list[int]:
        """The ids of a fragment: the pair of lowest rank first, of equal ones the leftmost."""
        ids: list = [self.single[b] for b in fragment]
        after, before, merges = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), self.merges
        heap = [(*m, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, new, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:  # one of the two has been merged since
                continue
            ids[i], ids[j] = new, None
            k = after[i] = after[j]
            if k < len(ids):
                before[k] = i
                if m := merges.get((new, ids[k])):
                    heapq.heappush(heap, (*m, i, new, ids[k]))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], new))):
                heapq.heappush(heap, (*m, h, ids[h], new))
        return [k for k in ids if k is not None]


class Encoder:
    """Encodes and decodes texts; remembers pieces up to a bound."""

    def __init__(self, text: str):
        self.v = Vocabulary(text)
        self.special = {x: np.array([k], np.int32).tobytes() for x, k in self.v.special.items()}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.decimal = [str(k).encode() for k in range(len(self.v.table))]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The int32 ids of texts, a few texts at a time; null and empty texts have none."""
        group, size = [], 0
        for t in texts:
            group.append(t or "")
            size += len(group[-1])
            if size >= GROUP:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> list[bytes]:
        v = self.v
        parts = [[p for p in (v.at_special.split(t) if v.at_special else [t])] for t in texts]
        split = [[[p] if p in v.special else v.pattern(p) for p in ps] for ps in parts]
        here = set().union(*(xs for ps in split for xs in ps)).difference(self.special)
        if len(self.known) + len(here) > CACHE_PIECES:  # pieces not met again before the next turn are forgotten
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = here.difference(known)
        again = new.intersection(older)
        known.update((x, older[x]) for x in again)
        if fresh := list(new - again):
            known.update(v.encoded(fresh))
        known.update(self.special)
        get = known.__getitem__
        out = [b"".join([b"".join(map(get, xs)) for xs in ps]) for ps in split]
        for x in fresh:
            if len(x) > LONGEST:
                del known[x]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included; ids of no token have no text."""
        table = self.v.table
        return b"".join([table[k] for k in ids if 0 <= k < len(table)]).decode("utf-8", "replace")


_ENCODERS: dict[int, Encoder] = {}


def encoder(packed: bytes) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    key = hash(packed)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(zlib.decompress(packed).decode())
    return _ENCODERS[key]


def load(model: str | None = None) -> bytes:
    """A vocabulary file, packed to go with the tasks (half a MB); by default the public byte-level one."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("byte_bpe_50k.json")
    with open(model, encoding="utf-8") as f:
        return zlib.compress(f.read().encode())


def _mapped(table: DataFrame, columns: list, row, schema: str, types: list) -> DataFrame:
    """Each batch by row(encoder, values of the second column) -> columns beside the first."""
    names = [x.split()[0] for x in schema.split(", ")]
    small_batches(table.sparkSession)

    def run(batches):
        for b in batches:
            made = row(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *(x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(made, types, strict=True))], names)

    return table.select(*columns).mapInArrow(run, schema)


def _text_of(docs: DataFrame) -> list:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids, n_tokens) of documents(doc_id, text).

    ids are those of the tokenizers library, without special tokens but those that the text itself holds.  Null and
    empty texts have no ids; very long texts are encoded whole; rows are returned as they come, repeated ones and null
    doc_ids too; an empty table gives no rows; other columns are ignored.
    """
    packed = load(model)

    def row(texts):
        e = encoder(packed)
        ids = list(e.encode(texts))
        return _lists(ids), [len(x) // 4 for x in ids]

    return _mapped(docs, _text_of(docs), row, "doc_id long, ids array<int>, n_tokens long", [None, pa.int64()])


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give a null text, bytes that are no UTF-8 the replacement character."""
    packed = load(model)

    def row(lists):
        e = encoder(packed)
        return ([None if ids is None else e.decode([k for k in ids if k is not None]) for ids in lists],)

    return _mapped(encoded, [F.col("doc_id").cast("long").alias("doc_id"), "ids"], row, "doc_id long, text string", [pa.string()])


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, its ids decoded, both as digests.

    ids_sha256: of the decimal ids joined by commas; decoded_sha256: of the decoded text's UTF-8.  Cases are as in
    encode(); a null text counts as an empty one.
    """
    packed = load(model)

    def row(texts):
        e = encoder(packed)
        sizes, told, decoded = [], [], []
        for raw in e.encode(texts):
            ids = np.frombuffer(raw, np.int32).tolist()
            sizes.append(len(ids))
            told.append(hashlib.sha256(b",".join([e.decimal[k] for k in ids])).hexdigest())
            decoded.append(hashlib.sha256(e.decode(ids).encode()).hexdigest())
        return sizes, told, decoded

    return _mapped(docs, _text_of(docs), row, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", [pa.int64(), pa.string(), pa.string()])
