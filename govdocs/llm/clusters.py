"""Centroid clustering in integers, with a vantage-point tree over the centroids.

Each round the tree is built anew on the driver (as many centroids as asked for, whatever the input) and
broadcast. Every vector finds its centroid by best-first branch and bound: of its open nodes the one with
the smallest lower bound comes next, until no bound is within the best distance so far; a bound that
equals it is still followed, so that ties go to the smaller number. Batches of vectors search in step.
Distances are exact integers; only bounds are floating-point, and they give way by more than they round.

Vectors are packed once into blocks of 32-bit integers, which every round reads. A task hands on a count
and sums for each centroid that it met.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govdocs.llm.common import Scratch

#: Largest component, after scaling, of a vector that is clustered: squared distances of 64 such fit in a long.
LARGEST = 1 << 26
BLOCK, LEAF = 4096, 4
#: Nodes times vectors that are searched in step.
SEARCHED = 1 << 21


@dataclass(frozen=True)
class Node:
    """number of the vantage centroid, and child, nearest and farthest of it for both halves; or the members of a leaf, in ascending order."""

    vantage: int = -1
    children: tuple[tuple[int, float, float], ...] = ()
    members: tuple[int, ...] = ()


def distances(x, c):
    """Squared distances of the rows of x and c; both are of integers, kept as doubles where these hold all results exactly."""
    return (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T)


def exact(x, most: int):
    """x as doubles if squared distances of rows with components up to `most` are below 2^53, else as longs."""
    return x.astype("float64" if 16 * x.shape[1] * most * most < 1 << 53 else "int64")


def vantage_tree(centroids) -> list[Node]:
    """Nodes of the tree over the rows of centroids, the root first."""
    import numpy as np

    nodes: list[Node] = []

    def grow(members: list[int]) -> int:
        at = len(nodes)
        nodes.append(Node(members=tuple(sorted(members))))
        if len(members) > LEAF:
            vantage, rest = members[0], members[1:]
            far = np.sqrt(distances(centroids[[vantage]], centroids[rest])[0].astype("float64"))
            order = np.argsort(far, kind="stable")
            halves = [order[: len(rest) // 2], order[len(rest) // 2 :]]
            nodes[at] = Node(vantage, tuple((grow([rest[i] for i in h]), far[h].min(), far[h].max()) for h in halves))
        return at

    if len(centroids):
        grow(list(range(len(centroids))))
    return nodes


def nearest_centroids(x, centroids, nodes: list[Node]):
    """(number, squared distance) of the nearest of centroids to each row of x, ties to the smaller number; both longs."""
    import numpy as np

    most = int(max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)))
    x, c = exact(x, most), exact(centroids, most)
    who, best = np.full(len(x), len(c)), np.full(len(x), np.inf if x.dtype == "float64" else np.iinfo("int64").max, dtype=x.dtype)
    step = max(1, SEARCHED // len(nodes))
    for start in range(0, len(x), step):
        rows = np.arange(start, min(len(x), start + step))
        bound = np.full((len(rows), len(nodes)), np.inf)
        bound[:, 0] = 0
        while len(rows):
            at = rows - start
            node = bound[at].argmin(1)
            low = bound[at, node]
            within = low <= np.sqrt(best[rows].astype("float64")) * (1 + 1e-9)
            rows, at, node, low = rows[within], at[within], node[within], low[within]
            bound[at, node] = np.inf
            for m in np.unique(node):
                here = node == m
                r, tree = rows[here], nodes[m]
                members = np.array([tree.vantage] if tree.children else tree.members)
                d = distances(x[r], c[members])
                first = d.argmin(1)  # the smaller number, as members ascend
                d0, n0 = d[np.arange(len(r)), first], members[first]
                better = (d0 < best[r]) | ((d0 == best[r]) & (n0 < who[r]))
                best[r[better]], who[r[better]] = d0[better], n0[better]
                for child, nearest, farthest in tree.children:
                    v = np.sqrt(d[:, 0].astype("float64"))
                    gap = np.maximum(nearest - v, v - farthest) - 1e-9 * (v + farthest)
                    bound[r - start, child] = np.maximum(gap, low[here])
    return who, best.astype("int64")


def packed(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """ids (0 for null), nameless (places of null ids) and matrix (32-bit integers floor(scale * x), row by row) of blocks of those vectors that are clustered."""
    kind = vectors.schema["embedding"].dataType.elementType
    plain = F.col("embedding") if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col("embedding").cast("array<double>")

    def run(parts) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in parts:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, dims)  # a null is nan
            whole = np.isfinite(x).all(1)
            x = np.floor(scale * np.where(whole[:, None], x, 0))
            whole &= (np.abs(x) <= LARGEST).all(1)
            ids, x = b.column(0).filter(pa.array(whole)), x[whole].astype("<i4")
            blocks = [(ids[a : a + BLOCK], x[a : a + BLOCK]) for a in range(0, len(ids), BLOCK)]
            columns = [
                pa.array([i.fill_null(0).to_numpy() for i, _ in blocks], type=pa.list_(pa.int64())),
                pa.array([np.nonzero(i.is_null().to_numpy(zero_copy_only=False))[0] for i, _ in blocks], type=pa.list_(pa.int64())),
                pa.array([m.tobytes() for _, m in blocks], type=pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["ids", "nameless", "matrix"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), plain.alias("embedding")).where(F.size("embedding") == dims)
    return rows.mapInArrow(run, "ids array<long>, nameless array<long>, matrix binary")


def block_of(matrix: bytes, dims: int):
    import numpy as np

    return np.frombuffer(matrix, dtype="<i4").reshape(-1, dims).astype("int64")


def first_vectors(blocks: DataFrame, k: int, dims: int, seed: str) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of seed and id, in that order; equal ids by their components. Rows without an id are passed over."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for ids, nameless, matrix in zip(p["ids"], p["nameless"], p["matrix"]):
                skip = set(nameless)
                named = ((hashlib.sha256(f"{seed}{i}".encode()).hexdigest(), tuple(v)) for n, (i, v) in enumerate(zip(ids, block_of(matrix, dims))) if n not in skip)
                yield pd.DataFrame(heapq.nsmallest(k, named), columns=["hash", "vector"], dtype=object)

    return [r.vector for r in blocks.mapInPandas(run, "hash string, vector array<long>").orderBy("hash", "vector").limit(k).collect()]


def moved_centroids(blocks: DataFrame, centroids, dims: int):
    """The centroids after one round; those that no vector is nearest to stay. Counts and sums of k * dims components reach the driver."""
    import numpy as np

    shared = blocks.sparkSession.sparkContext.broadcast((centroids, vantage_tree(centroids)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, nodes = shared.value
        n, sums = np.zeros(len(c), dtype="int64"), np.zeros(c.shape, dtype="int64")
        for p in parts:
            for matrix in p["matrix"]:
                x = block_of(matrix, dims)
                who, _ = nearest_centroids(x, c, nodes)
                order = np.argsort(who, kind="stable")
                met, first, count = np.unique(who[order], return_index=True, return_counts=True)
                sums[met] += np.add.reduceat(x[order], first)
                n[met] += count
        met = np.nonzero(n)[0]
        yield pd.DataFrame({"cluster": met.astype("int32"), "n": n[met], "sums": list(sums[met])})

    parts = blocks.mapInPandas(run, "cluster int, n long, sums array<long>")
    rows = parts.select("cluster", "n", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("s")).collect()
    out = centroids.copy()
    for r in rows:
        out[r.cluster, r.pos] = r.s // r.n
    shared.destroy()
    return out


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2:") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each clustered row of vectors (vec_id, embedding).

    Rows with another number of components than dims, with a null or non-finite one, or with one beyond
    LARGEST after scaling are left out. A null vec_id is clustered but never a first centroid. Rows that
    repeat a vec_id count each, as first centroids too. With fewer vectors than k there are so many
    centroids; without any the result is empty. Other columns are ignored. Sums beyond a long are null.
    """
    import numpy as np

    spark = vectors.sparkSession
    scratch = Scratch(spark, "clusters")
    blocks = scratch.put("blocks", packed(vectors.select("vec_id", "embedding"), dims, scale))
    centroids = np.array(first_vectors(blocks, k, dims, seed), dtype="int64").reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved_centroids(blocks, centroids, dims)
    shared = spark.sparkContext.broadcast((centroids, vantage_tree(centroids)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, nodes = shared.value
        for p in parts if len(c) else ():
            for ids, nameless, matrix in zip(p["ids"], p["nameless"], p["matrix"]):
                who, far = nearest_centroids(block_of(matrix, dims), c, nodes)
                names = pd.Series(ids, dtype="Int64")
                names[nameless] = pd.NA
                yield pd.DataFrame({"vec_id": names, "cluster": who.astype("int32"), "distance": far})

    held = scratch.put("held", blocks.mapInPandas(run, "vec_id long, cluster int, distance long"))
    sums = {r.cluster: int(r.s) for r in held.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    long = lambda s: s if s < 1 << 63 else None
    sha = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    rows = [(n, long(s), long(sum(sums.values())), sha(centroids[n].tolist())) for n, s in sums.items()]
    named = spark.createDataFrame(rows, "c int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    return held.join(F.broadcast(named), F.col("cluster") == F.col("c")).drop("c")
