import numpy as np
import xxhash

from skein.llm import simhash


def plain(text, k=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), seed=42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(rows, radius=4):
    fp, root = [plain(t) for _, t in rows], {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= radius:
                a, b = find(rows[i][0]), find(rows[j][0])
                root[max(a, b)] = min(a, b)
    return {d: (f"{f:016x}", find(d)) for (d, _), f in zip(rows, fp, strict=True)}


def test_against_all_pairs(documents, words):
    rows, base = [], words(400, 1)
    for k in range(120):
        w = list(base)
        for j in range(k % 4):
            w[(k * 37 + j * 11) % 400] = f"new{k}"
        rows.append((k * 3, " ".join(w)))
    rows += [(1000 + k, " ".join(words(60))) for k in range(80)]
    rows += [(2000 + k, rows[4][1].upper()) for k in range(30)] + [(3000, ""), (3001, " \t\n"), (3002, None), (3003, "One two"), (3004, "one\x0btwo"), (3005, "É é")]
    out = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(documents(rows)).collect()}
    assert out == grouped(rows)
    assert out[2000][1] == out[12][1] and out[3002][1] == 3000


def test_long_text_and_blocks(words):
    text = " ".join(words(70_000, 2))
    n = simhash._BLOCK
    try:
        simhash._BLOCK = 1000
        assert simhash.fingerprint(text.encode()) == plain(text)
    finally:
        simhash._BLOCK = n


def test_compare_finds_every_component():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    f = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(20)]))
    f = f[np.argsort(np.bitwise_count(f), kind="stable")]
    tiles = [(0, f[np.bitwise_count(f) == c]) for c in np.unique(np.bitwise_count(f))]
    order = np.concatenate([t for _, t in tiles])
    links = simhash.compare(tiles, 4)
    assert all(int(order[a] ^ order[b]).bit_count() <= 4 for a, b in links)
    root = list(range(len(order)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        assert find(a) != find(b)  # a forest
        root[find(a)] = find(b)
    for i in range(len(order)):
        for j in np.flatnonzero(np.bitwise_count(order[i] ^ order) <= 4):
            assert find(i) == find(int(j))


def test_empty_null_and_repeated(documents):
    assert simhash.near_duplicates(documents([(1, "a")]).limit(0)).count() == 0
    out = simhash.near_duplicates(documents([(5, "a b"), (5, "a b"), (None, "a b"), (None, "c d")])).collect()
    assert sorted((r["doc_id"] is None, r["component_id"] or 0) for r in out) == [(False, 5), (False, 5), (True, 0), (True, 5)]
