"""Pivot search, prefix trie and whitening: against brute force, with small groups and shards, odd rows and clashing names."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import pivots, trie, whitening
from tests.llm.samples import CLASHING, FOLDER, prose

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<double>"
TURNS = "conv_id long, turn long, role string, text string"
EXTRA = [c for c in [*CLASHING, "c", "x", "f", "g", "ids", "far", "e", "lot", "salt", "path", "shard", "depth", "component"]]


def clashing(df):
    return df.withColumns({c: F.lit(f"own {c}") for c in EXTRA if c not in df.columns})


def longs(v):
    if not v or any(c is None or not math.isfinite(c) for c in v):
        return None
    return tuple(min(max(math.floor(256 * c) if abs(c) < 1e300 else int(c), -2**63), 2**63 - 1) for c in v)


def clustered(n, size=6, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, size))
    return [(i, [float(c) for c in centres[i % 5] + 0.1 * rng.standard_normal(size)]) for i in range(n)]


ODD = [(100, None), (150, []), (200, [NAN, 1.0]), (250, [INF, 1.0]), (300, [None, 1.0]), (None, [0.25, 0.5]), (None, None), (350, [0.0, -0.0]), (400, [1.0, 2.0, 3.0]),
       (450, [1e300, -1e300]), (451, [1e300, 1e300]), (500, [0.25, 0.5]), (500, [0.25, 0.5]), (500, [0.5, 0.5]), (7, [0.25, 0.5]), (550, [1e-300, 1e-300])]


def best_of(rows, best=5, every=50):
    x = [(i, longs(v)) for i, v in rows]
    x = [(i, v) for i, v in x if v is not None]
    out = []
    for a, (i, v) in enumerate(x):
        if i is None or i % every:
            continue
        scores = [(-min(max(sum(p * q for p, q in zip(v, w)), -2**63), 2**63 - 1), j is None, j or 0) for b, (j, w) in enumerate(x) if b != a and len(w) == len(v)]
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(scores)[:best])]
    return out


def told(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


@pytest.mark.parametrize("group", [16, 8192])
def test_pivot_search_equals_brute_force(spark, group):
    rows = clustered(400) + [(1000 + i, [0.5] * 6) for i in range(90)] + [(i, v) for i, v in ODD]
    df = clashing(spark.createDataFrame(rows, VECTORS).repartition(5))
    assert told(pivots.search(df, group=group).select("query_id", "rank", "vec_id", "score")) == sorted(best_of(rows), key=str)


def test_pivot_search_of_odd_rows(spark):
    df = clashing(spark.createDataFrame(ODD, VECTORS))
    assert told(pivots.search(df)) == sorted(best_of(ODD), key=str)
    assert pivots.search(spark.createDataFrame([], VECTORS)).collect() == []
    assert pivots.search(spark.createDataFrame([(50, [1.0])], VECTORS)).collect() == []


def test_pivots_pass_over_clusters_that_cannot_win():
    rng = np.random.default_rng(3)
    x = np.floor(np.concatenate([rng.standard_normal((300, 8)) * 3 + 100 * c for c in np.eye(8)[:4]])).astype(np.int64)
    chosen = pivots.pivots_of(x[::10].tolist(), 16)[8]
    far = np.sqrt(((x[:, None, :] - chosen) ** 2).sum(2))
    side = {"k": list(range(len(x))), "x": x, "far": far, "ids": [[i] for i in range(len(x))], "to_beat": [None] * len(x)}
    seen = []
    scores = pivots._scores
    try:
        pivots._scores = lambda rows, q, small: seen.append(len(rows)) or scores(rows, q, small)
        pivots.BLOCK = 16
        found = pivots._best({k: v[:20] for k, v in side.items()}, side, 5)
    finally:
        pivots._scores, pivots.BLOCK = scores, 512
    assert sum(seen) < 0.35 * 20 * len(x)
    for q in range(20):
        assert [s for k, _, s, _ in found if k == q] == sorted((x @ x[q]).tolist(), reverse=True)[:6]


def rebuilt(rows, shared):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            mark = hashlib.sha256(f"{len(r or '')}:{r or ''}{x or ''}".encode()).digest()[:16]
            convs[c].append(((t is not None, t or 0), mark, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    if not shared:
        return own
    out = {}
    for c, path in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + path[h:]
    return out


def nodes_of(paths):
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1]) if k else 0)
    return sorted([(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k],
                    hashlib.sha256(",".join(map(str, sorted(c for c in m if len(paths[c]) == len(k)))).encode()).hexdigest()) for k, m in members.items()], key=str)


def talk(convs, seed=1, turns=7):
    rng = np.random.default_rng(seed)
    return [(c, t, ["system", "user", "assistant"][min(t, 2)] if rng.random() < 0.9 else None, prose(int(rng.integers(3)) if t < 4 else c, 3 + t))
            for c in convs for t in range(int(rng.integers(1, turns)))]


@pytest.mark.parametrize("shard, shared", [(1, False), (40, True), (50_000, True)])
def test_trie_equals_brute_force(spark, monkeypatch, shard, shared):
    monkeypatch.setattr(trie, "SHARD", shard)
    monkeypatch.setattr(trie, "PIECE", 40)
    same = [(5000 + c, t, "user", x) for c in range(60) for t, x in enumerate(["hello", "what is it", "é🙂"])]
    rows = talk(range(-30, 320)) + same + [(7000, t, "user", f"turn {t}") for t in range(300)] + [(7001, t, "user", f"turn {t}") for t in range(180)]
    df = clashing(spark.createDataFrame(rows, TURNS).repartition(6))
    assert told(trie.build(df, shared_heads=shared)) == nodes_of(rebuilt(rows, shared))


def test_trie_of_odd_rows(spark):
    rows = [(None, 0, "user", "lost"), (None, None, None, None), (1, None, "user", "first"), (1, 0, None, None), (1, 0, None, None), (1, 0, "user", "tie"), (2, 1, "", ""),
            (3, 1, None, None), (104, 0, "user", "x"), (2**63 - 1, 0, "user", "long " * 40_000), (-2**63, 0, "a", "b"), (205, None, None, None)]
    df = clashing(spark.createDataFrame(rows, TURNS))
    for shared in (False, True):
        assert told(trie.build(df, shared_heads=shared)) == nodes_of(rebuilt(rows, shared))
    assert trie.build(spark.createDataFrame([], TURNS)).collect() == []
    # Nothing but turnless conversations: the root alone.
    alone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    assert [tuple(r)[:5] for r in trie.build(spark.createDataFrame([(alone, 0, "user", "x")], TURNS), shared_heads=True).collect()] == [(alone, 0, None, 1, 0)]


def test_close_equals_a_stack():
    rng = np.random.default_rng(5)
    for n in (1, 2, 63, 64, 65, 1000, 5000):
        bits = rng.random(n) < 0.52
        excess = np.cumsum(np.where(bits, 1, -1))
        before = int(max(0, -excess.min())) + 1
        parens = trie.Parens(bits, before)
        stack, want = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            elif stack:
                want[stack.pop()] = i
        opened = np.flatnonzero(bits)
        assert parens.close(opened).tolist() == [want.get(int(i), n) for i in opened]


def whitened_of(rows):
    x = [(i, longs(v)) for i, v in rows]
    lengths = defaultdict(int)
    for _, v in x:
        if v:
            lengths[len(v)] += 1
    size = max(lengths, key=lambda s: (lengths[s], s))
    kept = [(i, v) for i, v in x if v and len(v) == size]
    fit = sorted({v for _, v in kept})
    n, sums = len(fit), [sum(v[j] for v in fit) for j in range(size)]
    m = np.array(fit, float) - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(m.T @ m / n)
    return kept, n, sums, values[::-1], vectors[:, ::-1]


def check_whitened(spark, rows, parts=4):
    kept, n, sums, values, vectors = whitened_of(rows)
    got = whitening.whiten(clashing(spark.createDataFrame(rows, VECTORS).repartition(parts))).collect()
    width = min(4, len(sums))
    assert len(got) == len(kept) * width
    by = defaultdict(list)
    for r in got:
        by[r.component].append(r)
        assert r.n == n
    exact = sorted((str(i), sum((n * c - s) ** 2 for c, s in zip(v, sums))) for i, v in kept)
    for k in range(1, width + 1):
        assert sorted((str(r.vec_id), r.deviation) for r in by[k]) == [(i, d if d < 2**63 else None) for i, d in exact]
        if values[k - 1] <= 1e-12 * values.sum():
            assert all(r.whitened is None for r in by[k])
            continue
        want = sorted((str(i), float((np.array(v, float) - np.array([s / n for s in sums])) @ vectors[:, k - 1] / math.sqrt(values[k - 1]))) for i, v in kept)
        mine = sorted((str(r.vec_id), r.whitened) for r in by[k])
        sign = 1 if np.dot([w for _, w in want], [w for _, w in mine]) >= 0 or len({i for i, _ in want}) < len(want) else -1
        mine = sorted((i, sign * w) for i, w in mine)
        assert np.allclose([w for _, w in want], [w for _, w in mine], atol=1e-7)
        assert all(abs(r.explained / (values[k - 1] / values.sum()) - 1) < 1e-9 and r.identity_error < 1e-9 for r in by[k])


def test_whitening_equals_direct_eigenvectors(spark):
    rows = clustered(300, 8) + [(1000 + i, [0.5] * 8) for i in range(80)]
    check_whitened(spark, rows)
    check_whitened(spark, rows, 1)
    check_whitened(spark, [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()], 20)


def test_whitening_of_odd_rows(spark):
    empty = whitening.whiten(spark.createDataFrame([], VECTORS))
    assert empty.collect() == [] and len(empty.columns) == 7
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, []), (3, [NAN])], VECTORS)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25]), (1, [0.5, 0.25]), (None, [0.5, 0.25])], VECTORS)).collect()
    assert len(one) == 6 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None for r in one)
    # Three vectors of three dimensions vary in two; lengths other than the most frequent give no rows; -0.0 is 0.
    check_whitened(spark, [(1, [0.0, 1.0, 2.0]), (2, [-0.0, 1.0, 2.0]), (3, [4.0, 1.0, 0.0]), (None, [1.0, 5.0, 0.0]), (5, [1.0, 2.0]), (6, None), (7, [None, 1.0, 1.0])])
    check_whitened(spark, [(1, [1.0, 3.0, 5.0]), (2, [2.0, 1.0, 4.0]), (3, [5e9, 1.0, 0.0]), (4, [0.0, 1e9, 1.0])])


@pytest.mark.parametrize("size", [1, 2, 5, 24])
def test_rank_one_updates_and_combination(size):
    rng = np.random.default_rng(size)
    x = np.floor(rng.standard_normal((60, size)) * 50 * 10.0 ** -(np.arange(size) % 3))
    x[10:20] = x[0]
    parts = [whitening.Spectrum.empty(size) for _ in range(3)]
    for i, row in enumerate(x):
        parts[i % 3].add(row)
    whole = parts[0].combine(parts[1]).combine(parts[2])
    scatter = (x - x.mean(0)).T @ (x - x.mean(0))
    assert whole.n == 60 and np.allclose(whole.mean, x.mean(0))
    assert np.abs(whole.vectors * whole.values @ whole.vectors.T - scatter).max() < 1e-11 * max(1, np.abs(scatter).max())
    assert np.abs(whole.vectors.T @ whole.vectors - np.eye(size)).max() < 1e-11
