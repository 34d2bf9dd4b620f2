"""Neighborhoods in parts against a walk over plain sets, and their size around a hub."""

import random

import pytest
from pyspark.sql import functions as F

from govdocs.operators import hoods as H

EDGES = "edge_id string, source_node_id string, target_node_id string"


def walked(edges, seeds, depth):
    """{(seed, node): distance}, {(seed, edge)} by breadth-first search."""
    beside = {}
    for _, s, t in edges:
        if s is not None and t is not None:
            beside.setdefault(s, set()).add(t)
            beside.setdefault(t, set()).add(s)
    near, induced = {}, set()
    for seed in seeds:
        at = {seed: 0}
        for step in range(1, depth + 1):
            for n in [n for n, d in at.items() if d == step - 1]:
                for m in beside.get(n, ()):
                    at.setdefault(m, step)
        near |= {(seed, n): d for n, d in at.items()}
        induced |= {(seed, e) for e, s, t in edges if s in at and t in at}
    return near, induced


def graph_of(turn):
    """Some hubs joined to each other and to many nodes, edges that repeat, loops, edges without an end, nodes apart."""
    rng = random.Random(turn)
    name = lambda: f"h{rng.randrange(3)}" if rng.random() < 0.4 else f"n{rng.randrange(40)}"
    ends = [(name(), name()) for _ in range(90)] + [("n1", "n1"), ("h1", "h1"), ("h0", "h1"), ("h0", "h1"), ("n2", None), (None, "h0")]
    return [(f"e{i}", s, t) for i, (s, t) in enumerate(ends)]


@pytest.mark.parametrize("depth, hub, turn", [(1, 4, 0), (2, 4, 1), (2, 2, 2)])
def test_parts_are_the_walk(spark, tmp_path, monkeypatch, depth, hub, turn):
    monkeypatch.setattr(H, "SLICE", 5)
    edges = graph_of(turn)
    seeds = ["h0", "h1", *[f"n{i}" for i in range(20)], "apart"]
    df = spark.createDataFrame([(s,) for s in [*seeds, "n1", None]], "seed string")
    found = H.hoods(df, spark.createDataFrame(edges, EDGES), depth, hub, str(tmp_path / "parts"))
    near, induced = walked(edges, seeds, depth)
    assert sorted((r.seed, r.node_id, r.distance) for r in found.near().collect()) == sorted((*k, d) for k, d in near.items())
    assert sorted((r.seed, r.edge_id) for r in found.induced().collect()) == sorted(induced)
    got = {r.seed: r for r in found.summary().collect()}
    assert set(got) == set(seeds)
    for seed in seeds:
        mine, inside = {n: d for (s, n), d in near.items() if s == seed}, [e for s, e in induced if s == seed]
        assert (got[seed].n_nodes, got[seed].distances, got[seed].last_node) == (len(mine), sum(mine.values()), max(mine))
        assert (got[seed].n_edges, got[seed].last_edge) == (len(inside), max(inside, default=None))
    groups = [(i % 3, s) for i, s in enumerate(seeds)] + [(7, "h0"), (7, "n3")]
    nodes, linked = found.candidates(spark.createDataFrame(groups, "query_id int, seed string"), "query_id")
    assert sorted(map(tuple, nodes.collect())) == sorted({(g, n) for g, s in groups for t, n in near if s == t})
    assert sorted(map(tuple, linked.collect())) == sorted({(g, e) for g, s in groups for t, e in induced if s == t})


def test_empty_tables(spark):
    edges, seeds = spark.createDataFrame([], EDGES), spark.createDataFrame([], "seed string")
    some = spark.createDataFrame([("a",)], "seed string")
    assert H.hoods(seeds, spark.createDataFrame([("e", "a", "b")], EDGES), 2).summary().count() == 0
    row = H.hoods(some, edges, 2).summary().first()
    assert (row.n_nodes, row.distances, row.n_edges, row.last_edge) == (1, 0, 0, None)


def test_many_seeds_around_a_hub(spark, tmp_path):
    """10^5 neighbours and 10^3 seeds: the parts grow with their sum, not with their product, and no slice holds the hub."""
    n, m = 100_000, 1_000
    edges = spark.range(n).select(F.concat(F.lit("e"), "id").alias("edge_id"), F.lit("hub").alias("source_node_id"), F.concat(F.lit("n"), "id").alias("target_node_id"))
    seeds = spark.range(m).select(F.concat(F.lit("n"), "id").alias("seed"))
    found = H.hoods(seeds, edges, 2, path=str(tmp_path / "parts"))
    sizes = [x.count() for x in (found.own, found.classes, found.class_nodes, found.own_pairs, found.class_pairs, found.point_pairs)]
    assert sum(sizes) <= 2 * n + 4 * m
    slices = [r["count"] for r in H.adjacency(edges).where("a = 'hub'").groupBy("slice").count().collect()]
    assert len(slices) == -(-n // H.SLICE) and max(slices) < 1.2 * min(slices)
    rows = found.summary().select("n_nodes", "distances", "n_edges").distinct().collect()
    assert [tuple(r) for r in rows] == [(n + 1, 2 * (n - 1) + 1, n)]
