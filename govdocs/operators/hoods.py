"""Neighborhoods of one or two steps in which the neighbours of hubs are stored once and referred to.

A node with more than `hub` neighbours is a hub. Two steps from a seed reach, through nodes that are no
hubs, at most hub² nodes: these are the seed's own. Through hubs they reach whole neighbour lists, which
depend on nothing but the set of hubs next to the seed: seeds with the same set are a class, whose nodes
and pairs are worked out once. A hub's neighbours are dealt out in slices, so that no task holds them all.
Rows of seed and hub neighbour are made by `near` and `induced` alone; `summary` and `candidates` need none
(candidates: as many as the groups have classes).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govdocs.operators.registry import written

#: Neighbours from which on a node is a hub.
HUB = 128
#: Neighbours of a hub in one slice.
SLICE = 1 << 14


def slices(n: Column) -> Column:
    return F.greatest(F.ceil(n / SLICE), F.lit(1)).cast("int")


def low_high(a: str, b: str) -> list[Column]:
    """The two ends of a pair in one order."""
    return [F.least(a, b).alias("low"), F.greatest(a, b).alias("high")]


def adjacency(edges: DataFrame) -> DataFrame:
    """a, b, a_n, b_n (neighbours of each) and slice (part of a's list) of all neighbours, in both directions."""
    ends = edges.select(F.col("source_node_id").alias("a"), F.col("target_node_id").alias("b")).where("a is not null and b is not null")
    both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    degree = both.groupBy("a").agg(F.count("*").alias("a_n"))
    both = both.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("a_n").alias("b_n")), "b")
    return both.select("a", "b", "a_n", "b_n", F.pmod(F.xxhash64("b"), slices(F.col("a_n"))).cast("int").alias("slice"))


def stepped(rows: DataFrame, at: str, n: str, adj: DataFrame) -> DataFrame:
    """rows (at: a node of n neighbours) beside its neighbours b and their b_n, slice by slice."""
    parts = rows.withColumn("slice", F.explode(F.sequence(F.lit(0), slices(F.col(n)) - 1)))
    return parts.join(adj.select(F.col("a").alias(at), "slice", "b", "b_n"), [at, "slice"]).drop("slice")


@dataclass(frozen=True)
class Hoods:
    """The neighborhoods of some seeds in parts.

    own: seed, class_id, node_id, distance, n (neighbours), class_distance (null outside the class); classes:
    seed, class_id; class_nodes: class_id, node_id, distance, n; pairs of neighbouring nodes (low, high) in
    own_pairs (by seed), class_pairs (by class_id) and point_pairs (by class_id and point, a hub outside the
    class that is one of own). Each pair of a neighborhood is in one of the three.
    """

    own: DataFrame
    classes: DataFrame
    class_nodes: DataFrame
    own_pairs: DataFrame
    class_pairs: DataFrame
    point_pairs: DataFrame
    edges: DataFrame
    hub: int

    def points(self) -> DataFrame:
        """seed, class_id, point: hubs among a seed's own nodes that its class lacks."""
        return self.own.where((F.col("n") > self.hub) & F.col("class_distance").isNull()).select("seed", "class_id", F.col("node_id").alias("point"))

    def named_edges(self) -> DataFrame:
        whole = F.col("source_node_id").isNotNull() & F.col("target_node_id").isNotNull()  # least and greatest pass over nulls
        return self.edges.where(whole).select(*low_high("source_node_id", "target_node_id"), "edge_id", "source_node_id", "target_node_id")

    def near(self) -> DataFrame:
        """seed, node_id, distance, a row for each node of each neighborhood."""
        rows = self.own.select("seed", "node_id", "distance").unionByName(self.classes.join(self.class_nodes, "class_id").select("seed", "node_id", "distance"))
        return rows.groupBy("seed", "node_id").agg(F.min("distance").alias("distance"))

    def induced(self) -> DataFrame:
        """seed, edge_id, source_node_id, target_node_id, a row for each edge inside each neighborhood."""
        pairs = self.own_pairs.unionByName(self.classes.join(self.class_pairs, "class_id").select("seed", "low", "high"))
        pairs = pairs.unionByName(self.points().join(self.point_pairs, ["class_id", "point"]).select("seed", "low", "high"))
        return pairs.join(self.named_edges(), ["low", "high"]).select("seed", "edge_id", "source_node_id", "target_node_id")

    def summary(self) -> DataFrame:
        """seed, n_nodes, distances (their sum), last_node, n_edges, last_edge (null without edges), from sums of the parts."""
        shift = F.when(F.col("class_distance").isNull(), F.col("distance")).otherwise(F.least(F.col("distance") - F.col("class_distance"), F.lit(0)))
        nodes = self.own.groupBy("seed").agg(F.count_if(F.col("class_distance").isNull()).alias("n_nodes"), F.sum(shift).alias("distances"), F.max("node_id").alias("last_node"))
        shared = self.class_nodes.groupBy("class_id").agg(F.count("*").alias("n_nodes"), F.sum("distance").alias("distances"), F.max("node_id").alias("last_node"))
        nodes = nodes.unionByName(self.classes.join(shared, "class_id").drop("class_id"))
        nodes = nodes.groupBy("seed").agg(*[f(c).alias(c) for f, c in ((F.sum, "n_nodes"), (F.sum, "distances"), (F.max, "last_node"))])
        beside = self.named_edges().groupBy("low", "high").agg(F.count("*").alias("n"), F.max("edge_id").alias("last"))
        summed = lambda df, *by: df.join(beside, ["low", "high"]).groupBy(*by).agg(F.sum("n").alias("n_edges"), F.max("last").alias("last_edge"))
        edges = summed(self.own_pairs, "seed").unionByName(self.classes.join(summed(self.class_pairs, "class_id"), "class_id").drop("class_id"))
        edges = edges.unionByName(self.points().join(summed(self.point_pairs, "class_id", "point"), ["class_id", "point"]).select("seed", "n_edges", "last_edge"))
        edges = edges.groupBy("seed").agg(F.sum("n_edges").alias("n_edges"), F.max("last_edge").alias("last_edge"))
        return nodes.join(edges, "seed", "left").fillna(0, ["n_edges"])

    def candidates(self, groups: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
        """(group, node_id), (group, edge_id) of the neighborhoods of each group's seeds (groups: group, seed): a class that several of its seeds have is taken once."""
        of_class = groups.join(self.classes, "seed").select(group, "class_id").distinct()
        nodes = groups.join(self.own, "seed").select(group, "node_id").unionByName(of_class.join(self.class_nodes, "class_id").select(group, "node_id")).distinct()
        points = groups.join(self.points(), "seed").select(group, "class_id", "point").distinct()
        pairs = groups.join(self.own_pairs, "seed").select(group, "low", "high").unionByName(of_class.join(self.class_pairs, "class_id").select(group, "low", "high"))
        pairs = pairs.unionByName(points.join(self.point_pairs, ["class_id", "point"]).select(group, "low", "high")).distinct()
        return nodes, pairs.join(self.named_edges(), ["low", "high"]).select(group, "edge_id")


def classes_of(next_hubs: DataFrame) -> DataFrame:
    """seed, class_id (the least of its seeds) by the set of hubs next to each seed (next_hubs: seed, node_id), which count, ends and two 64-bit sums of hashes tell apart."""
    parts = [F.count("*").alias("k0"), F.min("node_id").alias("k1"), F.max("node_id").alias("k2"), F.sum(F.xxhash64("node_id").cast("decimal(20,0)")).alias("k3"), F.bit_xor(F.xxhash64("node_id", F.lit(1))).alias("k4")]
    keys = next_hubs.groupBy("seed").agg(*parts)
    names = [f"k{i}" for i in range(len(parts))]
    return keys.join(keys.groupBy(*names).agg(F.min("seed").alias("class_id")), names).select("seed", "class_id")


def hoods(seeds: DataFrame, edges: DataFrame, depth: int, hub: int = HUB, path: str | None = None, adj: DataFrame | None = None) -> Hoods:
    """The neighborhoods of seeds (seed) within depth (1 or 2), undirected. path: a folder for the parts, which several steps read; adj: the edges' adjacency, if it is stored.

    Seeds that repeat or are null count once or not at all; a seed without edges is its own neighborhood; edges
    without one of their ends are no neighbours. An empty table of seeds or edges gives empty parts.
    """
    if depth not in (1, 2):
        raise ValueError("depth must be 1 or 2")
    put = written(path)
    adj = put(adjacency(edges), "adjacency") if adj is None else adj
    known = seeds.select("seed").where("seed is not null").distinct()
    degree = adj.groupBy("a").agg(F.first("a_n").alias("n")).withColumnRenamed("a", "seed")
    start = put(known.join(degree, "seed", "left").fillna(0, ["n"]), "start")
    one = put(stepped(start, "seed", "n", adj).select("seed", F.col("b").alias("node_id"), F.col("b_n").alias("n")), "one")
    light = adj.where(F.col("a_n") <= hub)
    reached = start.select("seed", F.col("seed").alias("node_id"), "n", F.lit(0).alias("distance")).unionByName(one.withColumn("distance", F.lit(1)))
    next_hubs = one.where(F.col("n") > hub) if depth == 2 else one.limit(0)
    classes = put(classes_of(next_hubs), "classes")
    first = next_hubs.join(classes.select(F.col("class_id").alias("seed")).distinct(), "seed", "left_semi").withColumnRenamed("seed", "class_id")
    listed = stepped(first, "node_id", "n", adj).select("class_id", F.col("b").alias("node_id"), F.col("b_n").alias("n"), F.lit(2).alias("distance"))
    shared = listed.unionByName(first.select("class_id", "node_id", "n", F.lit(1).alias("distance")))
    class_nodes = put(shared.groupBy("class_id", "node_id").agg(F.min("distance").alias("distance"), F.max("n").alias("n")), "class_nodes")
    if depth == 2:
        two = one.where(F.col("n") <= hub).select("seed", F.col("node_id").alias("a")).join(light, "a")
        reached = reached.unionByName(two.select("seed", F.col("b").alias("node_id"), F.col("b_n").alias("n"), F.lit(2).alias("distance")))
    own = reached.groupBy("seed", "node_id").agg(F.min("distance").alias("distance"), F.max("n").alias("n")).join(classes, "seed", "left")
    own = put(own.join(class_nodes.select("class_id", "node_id", F.col("distance").alias("class_distance")), ["class_id", "node_id"], "left"), "own")
    outside = own.where(F.col("class_distance").isNull())
    # a node that is no hub has few pairs, whatever is at their other ends
    tried = outside.where(F.col("n") <= hub).select("seed", "class_id", F.col("node_id").alias("a")).join(light.select("a", "b"), "a")
    tried = tried.join(own.select("seed", F.col("node_id").alias("b"), F.lit(True).alias("mine")), ["seed", "b"], "left")
    tried = tried.join(class_nodes.select("class_id", F.col("node_id").alias("b"), F.lit(True).alias("ours")), ["class_id", "b"], "left")
    own_pairs = tried.where("mine or ours").select("seed", *low_high("a", "b")).distinct()
    # from the end with fewer neighbours, a node has no more pairs than the root of twice their number
    tail, head = (F.struct(F.col(f"{x}_n"), F.col(x)) for x in "ab")
    pairs = adj.where(tail <= head).select("a", "b", "a_n")
    hubs = outside.where(F.col("n") > hub).select("seed", F.col("node_id").alias("a"))
    between = hubs.join(pairs.where(F.col("a_n") > hub), "a").join(hubs.withColumnRenamed("a", "b"), ["seed", "b"], "left_semi")
    own_pairs = put(own_pairs.unionByName(between.select("seed", *low_high("a", "b"))), "own_pairs")
    ours = class_nodes.select("class_id", F.col("node_id").alias("b"))
    class_pairs = ours.withColumnRenamed("b", "a").join(pairs.select("a", "b"), "a").join(ours, ["class_id", "b"], "left_semi").select("class_id", *low_high("a", "b"))
    points = outside.where((F.col("n") > hub) & F.col("class_id").isNotNull()).select("class_id", F.col("node_id").alias("point"), "n").distinct()
    point_pairs = stepped(points, "point", "n", adj).join(ours, ["class_id", "b"], "left_semi").select("class_id", "point", *low_high("point", "b"))
    return Hoods(own, classes, class_nodes, own_pairs, put(class_pairs, "class_pairs"), put(point_pairs, "point_pairs"), edges, hub)
