"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are computed once per document and collapsed to distinct values with a partial aggregate, so
thousands of copies cost one entry.  The distinct values are sorted by population count (of the whole and of
its four 16-bit parts) and packed into tiles.  Every pair of tiles is compared exactly by numpy exclusive-or
and bit counts, except pairs whose population counts already differ beyond the radius: the L1 distance of the
part counts is a lower bound of the Hamming distance.  A pair of tiles returns a spanning forest of the links it
found, never all pairs.  Tiles are dealt to groups of one population count each, and each pair of groups whose counts are
within the radius is one task; the number of groups grows with the data, so a task's memory does not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, dropped, small_batches, stored

SHINGLE, RADIUS = 4, 4
TILE = 4096
#: Distinct fingerprints that one side of a task's comparison holds at most, on average.
GROUP_ROWS = 131_072
LEAST_GROUPS = 12
_BLOCK = 1 << 15


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The unsigned SimHash of a text; no words: zero."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ones, n = np.zeros(64, np.int64), max(1, len(words) - shingle + 1)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
        ones += _bit_sums(np.array(hashes, np.uint64))
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
        ends = ends[shingle - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        for at in range(0, n, _BLOCK):
            hashes = [digest(joined[s:e], 42) for s, e in zip(starts[at : at + _BLOCK], ends[at : at + _BLOCK], strict=True)]
            ones += _bit_sums(np.array(hashes, np.uint64))
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _bit_sums(h: np.ndarray) -> np.ndarray:
    """How many hashes have each bit: byte counters packed in words, summed 255 at a time."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    sums = np.add.reduceat(bits, np.arange(0, len(h), 255), axis=0)
    return sums.view(np.uint8).sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of documents(doc_id, text); fp is the fingerprint's 64 bits as a signed long.  Null text: empty."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _tiles(classes: DataFrame, rows: int) -> DataFrame:
    """(tile, pc, fps, reps): packed runs of classes of one population count, in order of those of their parts."""
    part = lambda k: F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)))
    keyed = classes.withColumn("key", F.concat(*[F.char(x + F.lit(33)) for x in (F.bit_count("fp"), part(0), part(1), part(2), part(3))]))
    n = max(1, -(-rows // (4 * TILE)))

    def pack(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            if sum(len(x) for x, _ in held) >= 8 * TILE:
                yield from _packed(held)
                held = []
        if held:
            yield from _packed(held)

    return keyed.repartitionByRange(n, "key").sortWithinPartitions("key").select("fp", "rep").mapInArrow(pack, "tile string, pc int, fps binary, reps binary")


def _packed(held):
    import uuid

    fps, reps = np.concatenate([x for x, _ in held]).view(np.uint64), np.concatenate([x for _, x in held])
    pc = np.bitwise_count(fps)
    cuts = [0, *(np.flatnonzero(np.diff(pc)) + 1).tolist(), len(fps)]
    rows = [(uuid.uuid4().hex, int(pc[a]), fps[i : min(i + TILE, b)].tobytes(), reps[i : min(i + TILE, b)].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False) for i in range(a, b, TILE)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.binary(), pa.binary()))], ["tile", "pc", "fps", "reps"])


class Forest:
    """Union of array positions with whole-array path compression."""

    def __init__(self, n: int):
        self.root, self.links = np.arange(n), []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Join positions pairwise; the links that join two trees are kept."""
        while len(i):
            a, b = self.root[i], self.root[j]
            open_ = a != b
            if not open_.any():
                return
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            low, high = np.minimum(a, b), np.maximum(a, b)
            # each higher root hangs once; the rest is seen again in the next round
            _, first = np.unique(high, return_index=True)
            self.links += zip(i[first].tolist(), j[first].tolist(), strict=True)
            self.root[high[first]] = low[first]
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def _boxes(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = np.stack([np.bitwise_count((fps >> np.uint64(16 * k)) & np.uint64(0xFFFF)) for k in range(4)]).astype(np.int64)
    return parts.min(axis=1), parts.max(axis=1)


def compare(tiles: list[tuple[int, np.ndarray]], radius: int) -> list[tuple[int, int]]:
    """Spanning links of tiles (side, fps) over the concatenated positions; side 0 meets side 1 (or 0 itself if it is alone)."""
    alone = len({s for s, _ in tiles}) == 1
    start = np.concatenate(([0], np.cumsum([len(x) for _, x in tiles])))
    forest = Forest(int(start[-1]))
    boxes = [_boxes(x) for _, x in tiles]
    counts = [int(np.bitwise_count(x[:1])[0]) for _, x in tiles]
    for i, (si, x) in enumerate(tiles):
        for j, (sj, y) in enumerate(tiles):
            if (j < i) if alone else (si, sj) != (0, 1):
                continue
            if abs(counts[i] - counts[j]) > radius:
                continue
            (li, hi), (lj, hj) = boxes[i], boxes[j]
            if np.maximum(0, np.maximum(li - hj, lj - hi)).sum() > radius:
                continue
            for at in range(0, len(x), 64):
                r, c = np.nonzero(np.bitwise_count(x[at : at + 64, None] ^ y[None, :]) <= radius)
                forest.add(start[i] + at + r, start[j] + c)
    return forest.links


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): representatives of fingerprints within the radius; a spanning forest per pair of tile groups."""
    at = classes.groupBy(F.bit_count("fp").alias("pc")).agg(F.count(F.lit(1)).alias("n")).collect()  # 65 counts at most
    rows = sum(r["n"] for r in at)
    most = max(1, min(GROUP_ROWS, -(-rows // LEAST_GROUPS)))
    several, first, groups = {}, {}, 0
    for r in sorted(at, key=lambda r: r["pc"]):
        several[r["pc"]], first[r["pc"]] = -(-r["n"] // most), groups
        groups += several[r["pc"]]
    if not groups:
        return classes.sparkSession.createDataFrame([], "a long, b long")
    near = {pc: [g for other in first if abs(other - pc) <= radius for g in range(first[other], first[other] + several[other])] for pc in first}
    tiles = stored(_tiles(classes, rows))
    # a few numbers a count: first group, number of groups, and the groups that it meets
    per_count = F.broadcast(classes.sparkSession.createDataFrame([(pc, first[pc], several[pc], near[pc]) for pc in first], "pc int, first int, several int, near array<int>"))
    cells = (
        tiles.join(per_count, "pc")
        .select((F.col("first") + F.pmod(F.xxhash64("tile"), F.col("several"))).cast("int").alias("g"), F.explode("near").alias("k"), "fps", "reps")
        .select(F.least("g", "k").alias("i"), F.greatest("g", "k").alias("j"), (F.col("g") > F.col("k")).cast("int").alias("side"), "fps", "reps")
    )

    def run(pdf):
        import pandas as pd

        if pdf["i"].iloc[0] != pdf["j"].iloc[0] and pdf["side"].nunique() == 1:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        tiles = [(int(s), np.frombuffer(f, np.uint64)) for s, f in zip(pdf["side"], pdf["fps"], strict=True)]
        reps = np.concatenate([np.frombuffer(r, np.int64) for r in pdf["reps"]])
        out = np.array(compare(tiles, radius), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": reps[out[:, 0]], "b": reps[out[:, 1]]})

    return cells.groupBy("i", "j").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of documents(doc_id, text).

    fingerprint: 16 lowercase hex digits; component_id: the smallest doc_id reachable over links of at most
    `radius` differing bits.  Null or blank texts have fingerprint zero and link like any other; repeated rows are
    returned as often as they come; a null doc_id never becomes a component unless its group has no other id;
    an empty table gives an empty result; other columns are ignored.
    """
    fps = stored(fingerprints(docs, shingle))
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    # a class without any id cannot be a node
    found = stored(components(links(classes.where("rep is not null"), radius)))
    of = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


__all__ = ["fingerprint", "fingerprints", "links", "near_duplicates", "compare", "Forest", "dropped"]
