"""Hard negatives against all pairs: random and clustered vectors, many shards and centres, hard rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdata.llm import negatives as N


def plain(raw, divisor, n_pos=5, n_neg=3):
    rows = {(i, l, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, l in raw if None not in (i, v, l) and all(x is not None and math.isfinite(x) for x in v)}
    sizes = [len(v) for _, _, v in rows]
    dim = max(set(sizes), key=lambda d: (sizes.count(d), d)) if sizes else 0
    rows = [r for r in rows if len(r[2]) == dim]
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, l, v in rows:
        if i % divisor:
            continue
        scored = [(-dot(v, w), j, m) for j, m, w in rows]
        for s, p in sorted((s, j) for s, j, m in scored if m == l and j != i)[:n_pos]:
            fits = sorted((t, j) for t, j, m in scored if m != l and -50 * s <= -100 * t <= -95 * s)[:n_neg]
            out += [(i, p, k + 1, j, -s, -t) for k, (t, j) in enumerate(fits)]
    return sorted(out)


COLS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def clustered(n, seed=5):
    rng = np.random.default_rng(seed)
    heads = rng.standard_normal((12, 8)) * 0.6
    x = (heads[rng.integers(0, 12, n)] + rng.standard_normal((n, 8)) * 0.05).astype(np.float32)
    return [(i, [float(y) for y in x[i]], int(rng.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"shard_rows": 40, "n_centres": 7, "sample": 100}])
def test_mining(spark, monkeypatch, options):
    raw = clustered(700)
    rng = np.random.default_rng(2)
    raw += [(1000 + i, [float(np.float32(y)) for y in rng.standard_normal(8) * 0.2], i % 4) for i in range(200)]
    raw += [(2000 + i, raw[10][1], 1) for i in range(30)] + [raw[3], raw[50], raw[50]]
    raw += [(3000, None, 1), (3050, [0.1] * 8, None), (3100, [0.1] * 7 + [None], 1), (3150, [float("nan")] * 8, 1), (3200, [float("inf")] + [0.0] * 7, 1), (None, [0.3] * 8, 1), (3250, [], 1), (3300, [0.2] * 5, 1), (3350, [0.0] * 8, 2)]
    raw += [(3400, [0.25] * 8, 77), (50, [0.5] * 8, 9), (51, [0.4] * 8, 9)]
    if options:
        monkeypatch.setattr(N, "BLOCK", 6)
    df = spark.createDataFrame(raw, "vec_id long, embedding array<float>, label int").select("*", F.lit(1).alias("id"), F.lit("k").alias("key"), F.lit("w").alias("windows"), F.lit(0).alias("a.b")).repartition(3)
    got = N.hard_negatives(df, F.col("id") % 50 == 0, **options)
    assert sorted(tuple(r) for r in got.select(*COLS).collect()) == plain(raw, 50)
    assert N.hard_negatives(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_trees_hold_every_row_and_prune():
    raw = clustered(4000)
    x = np.array([[math.floor(256 * v) for v in r[1]] for r in raw])
    longest = float((x * x).sum(axis=1).max())
    tree = N.CoverTree(x, longest, fan=8, leaf=20)
    below = np.concatenate([*tree.children.values(), [tree.root]])
    assert sorted(below.tolist()) == list(range(4000))
    lifted = N.augment(x, longest)

    def under(n):
        return [n, *(y for c in tree.children.get(n, ()) for y in under(int(c)))]
    for n in tree.children:
        assert N.distances(lifted[under(n)], lifted[n]).max() <= tree.radius[n] + 1e-6
    seen = 0
    real = N.products

    def counted(q, y):
        nonlocal seen
        seen += len(q) * len(y)
        return real(q, y)
    N.products = counted
    try:
        ids, labels = np.arange(4000), np.array([r[2] for r in raw])
        q = x[::400]
        got = N.search(tree, x, ids, labels, q, ids[::400], labels[::400], np.full(10, N._LOWEST), np.full(10, np.iinfo(np.int64).max), np.arange(10), 5, True)
    finally:
        N.products = real
    s = q @ x.T
    for k in range(10):
        want = sorted((-s[k, j], j) for j in range(4000) if labels[j] == labels[k * 400] and j != k * 400)[:5]
        assert [(-r[1], r[2]) for r in got if r[0] == k] == want
    assert seen < 0.6 * 10 * 4000  # nodes were skipped


def test_large_products_are_exact():
    q, x = np.array([[2 ** 27 + 1, 2 ** 27 - 1]]), np.array([[2 ** 27 - 3, 2 ** 27 + 5]])
    assert N.products(q, x)[0, 0] == (2 ** 27 + 1) * (2 ** 27 - 3) + (2 ** 27 - 1) * (2 ** 27 + 5)
    assert N.products(q << 3, x)[0, 0] == 8 * N.products(q, x)[0, 0]
