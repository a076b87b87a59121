import random
from collections import Counter

import numpy as np
import xxhash

from textbarge.llm import simhash

from .helpers import awkward, documents, prose


def brute_fingerprint(text, shingle):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    parts = [b" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def cases():
    base = prose(5, 400).split()
    near = []
    for k in range(25):
        w = list(base)
        w[(k * 17) % 400] = f"changed{k}"
        near.append((100 + k, " ".join(w)))
    return awkward() + near + [(200, "Same Short"), (201, "same  short"), (202, "other")]


def test_equals_brute_force(spark):
    docs = cases()
    for shingle, radius in ((3, 2), (2, 4), (3, 0)):
        rows = simhash.near_duplicates(documents(spark, docs), shingle=shingle, max_bits=radius).collect()
        fps = [brute_fingerprint(t, shingle) for _, t in docs]
        groups = brute_components(fps, radius)
        least = {g: min((d for (d, _), x in zip(docs, groups) if x == g and d is not None), default=None) for g in groups}
        expected = Counter((d, f"{fp:016x}", least[g]) for (d, _), fp, g in zip(docs, fps, groups))
        assert Counter(map(tuple, rows)) == expected


def test_components_of_long_chains_and_stars(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    edges = chain + star + [(b, a) for a, b in chain[:20]] + [(7, 7)]
    rng.shuffle(edges)
    roots = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(roots[i] == 0 for i in range(1, 201)) and all(roots[1000 + i] == 1000 for i in range(1, 300))


def test_forest_connects_what_all_pairs_connect():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, 20).astype(np.uint64)
    a = np.unique(np.concatenate([centre, centre ^ np.uint64(1), centre ^ np.uint64(3 << 40)]))
    left, right = simhash._forest(a, a, True, 2)
    assert len(left) == 40      # 20 groups of 3
    assert all(bin((x ^ y) & (2**64 - 1)).count("1") <= 2 for x, y in zip(left, right))


def test_keep_first(spark):
    docs = cases()
    frame = documents(spark, docs)
    kept = simhash.keep_first(frame)
    assert kept.columns == frame.columns
    rows = simhash.near_duplicates(frame).collect()
    first = sorted({r["component_id"] for r in rows if r["doc_id"] is not None})
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(d for d in ids if d is not None) == first
    assert ids.count(None) == 2


def test_empty(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    assert simhash.keep_first(documents(spark, [])).count() == 0
