"""Centroid clustering against plain loops, and odd rows."""

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from govdocs.llm import clusters

SCHEMA = "vec_id long, embedding array<float>, cluster string, label int"


def plain(rows, k, rounds, dims):
    """(vec_id, cluster, distance) of rows (id, vector) by comparing all with all."""
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    kept = [(i, v) for i, v in kept if max(map(abs, v)) <= clusters.LARGEST]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    at = [v for _, v in named[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((far(v, c), n) for n, c in enumerate(at)) for _, v in kept]
    for _ in range(rounds if at else 0):
        who = [n for _, n in assign()]
        for n in range(len(at)):
            mine = [v for (_, v), w in zip(kept, who) if w == n]
            if mine:
                at[n] = [sum(col) // len(mine) for col in zip(*mine)]
    return [(i, n, d) for (i, _), (d, n) in zip(kept, assign() if at else [])], at


def check(spark, rows, k=40, rounds=5, dims=64):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(3)
    got = clusters.cluster(df, k, rounds, dims).collect()
    want, at = plain(rows, k, rounds, dims)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, at[r.cluster])).encode()).hexdigest()
        assert r.inertia == sum(d for *_, d in want) and r.cluster_inertia == sum(d for _, n, d in want if n == r.cluster)
    return got


def test_whole_table_equals_plain_loops(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert len(check(spark, rows)) == len(rows)


def test_odd_rows_are_left_out_and_repeats_count(spark):
    good = [[i / 7, -i / 3] for i in range(9)]
    rows = [(i, v) for i, v in enumerate(good)] + [(3, good[3]), (3, [5.0, 5.0]), (None, [0.1, 0.2])]
    odd = [(20, None), (21, []), (22, [1.0]), (23, [1.0, None]), (24, [float("nan"), 1.0]), (25, [float("inf"), 1.0]), (26, [3e38, 0.0]), (27, [1.0, 2.0, 3.0])]
    assert len(check(spark, rows + odd, k=4, rounds=3, dims=2)) == 12


def test_fewer_vectors_than_centroids_and_none(spark):
    check(spark, [(1, [0.0, 1.0]), (2, [0.0, 1.0])], k=5, rounds=2, dims=2)
    assert check(spark, [(None, [0.0, 1.0])], k=5, dims=2) == []  # no row may be a first centroid
    assert check(spark, [], k=5, dims=2) == []


def test_large_components_and_empty_clusters_stay_exact(spark):
    rows = [(i, [(-1) ** i * 2.0**17 + i, 2.0**17 - 3 * i]) for i in range(30)] + [(40 + i, [0.5, 0.5]) for i in range(12)]
    check(spark, rows, k=12, rounds=4, dims=2)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60), st.integers(1, 80), st.integers(1, 4), st.sampled_from([2, 30, 1 << 26]), st.integers(0, 10**6))
def test_tree_finds_the_nearest_with_ties(k, n, dims, size, seed):
    rng = np.random.default_rng(seed)
    c, x = rng.integers(-size, size + 1, (k, dims)), rng.integers(-size, size + 1, (n, dims))
    far = ((x[:, None, :] - c[None, :, :]) ** 2).sum(2)
    who, best = clusters.nearest_centroids(x, c, clusters.vantage_tree(clusters.exact(c, size)))
    assert who.tolist() == far.argmin(1).tolist() and best.tolist() == far.min(1).tolist()


def test_far_halves_are_passed_over():
    c = np.concatenate([np.arange(40)[:, None] + [[0, 0]], np.arange(40)[:, None] + [[10**6, 0]]])
    nodes, seen = clusters.vantage_tree(c), []
    real = clusters.distances
    try:
        clusters.distances = lambda x, y: seen.append(len(x) * len(y)) or real(x, y)
        clusters.nearest_centroids(c[:5], c, nodes)
    finally:
        clusters.distances = real
    assert sum(seen) < 5 * len(c) / 2
