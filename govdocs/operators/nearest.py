"""Exact nearest neighbours by cosine, with pivots and the triangle inequality.

Some vectors are pivots; every vector belongs to the cell of the nearest one. Vectors are packed where they
are read into blocks of one cell, with the least and largest distance to its pivot. Queries first meet the
cells around them that hold k vectors, which gives a k-th distance, and then only the cells whose bounds
let them beat it. Queries that all tasks can hold meet blocks where these are read, and a task keeps its k
best; else batches of queries meet blocks by their cell in an equality join, as matrices. A block leaves out
the queries that its own bounds rule out. Distances are chords of unit vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors that serve as pivots, rows of a block, and what bounds give way to rounding.
PIVOTS, BLOCK, SLACK = 64, 1024, 1e-6
#: Queries that meet a block at once.
MEETING = 1024
#: Bytes of query vectors up to which they are sent to all tasks, so that blocks meet them where they are read; matches that a task holds before it keeps the best, and the most that these may be.
SENT_BYTES, HELD = 8 << 20, 1 << 18
#: Cell of zero vectors, which are as far from all others as a right angle is.
NOWHERE = -1


def unit(vectors):
    """Rows as doubles of unit length; zero rows stay."""
    import numpy as np

    v = np.stack([np.asarray(x, dtype=np.float64) for x in vectors])
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def chords(cosine):
    import numpy as np

    return np.sqrt(np.maximum(0.0, 2 - 2 * cosine))


def pivots_of(vectors: DataFrame, n: int):
    """Unit vectors of up to n rows, those with the smallest hash of their id; None without vectors. So many reach the driver, however many there are."""
    import numpy as np

    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(4 * n).select("vector").collect()
    if not rows:
        return None
    made = np.unique(unit([r.vector for r in rows]), axis=0)
    made = made[np.abs(made).sum(1) > 0]
    return made[np.random.default_rng(0).permutation(len(made))[:n]]


def blocks_of(vectors: DataFrame, pivots, rows: int) -> DataFrame:
    """cell, low, high (distances to its pivot), ids, matrix (in floats of width bytes) of blocks of up to so many vectors (id, vector)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for p in parts:
            v, ids = unit(p["vector"]), p["id"].to_numpy()
            plain = np.stack(p["vector"]).astype(kind_of)
            cosine = v @ pivots.T if len(pivots) else np.zeros((len(v), 1))
            cell = np.where((v != 0).any(1), cosine.argmax(1), NOWHERE)
            far = np.where(cell == NOWHERE, 2**0.5, chords(cosine.max(1)))
            out = []
            for c in np.unique(cell):
                mine = np.nonzero(cell == c)[0]
                mine = mine[np.argsort(far[mine], kind="stable")]
                for at in range(0, len(mine), rows):
                    m = mine[at : at + rows]
                    out.append((int(c), len(m), far[m].min(), far[m].max(), ids[m], plain[m].tobytes(), plain.itemsize))
            yield pd.DataFrame(out, columns=["cell", "n", "low", "high", "ids", "matrix", "width"])

    kind_of = "float32" if vectors.schema["vector"].dataType.elementType.simpleString() == "float" else "float64"
    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.mapInPandas(run, f"cell int, n int, low double, high double, ids array<{kind}>, matrix binary, width int")


def matrix_of(block):
    """The unit vectors of a block, which keeps them as they came."""
    import numpy as np

    return unit(np.frombuffer(block.matrix, dtype=f"float{8 * block.width}").reshape(len(block.ids), -1))


def bounds(q, pivots, cells, low, high):
    """Least distance of each query to anything in each cell."""
    import numpy as np

    right = np.full((len(q), len(cells)), 2**0.5)
    some = [i for i, c in enumerate(cells) if c != NOWHERE]
    if some:
        d = chords(q @ pivots[[cells[i] for i in some]].T)
        right[:, some] = np.maximum(0.0, np.maximum(d - np.asarray(high)[some], np.asarray(low)[some] - d))
    right[~(q != 0).any(1)] = 2**0.5
    return right - SLACK


def visits(queries: DataFrame, pivots, cells: list[tuple], k: int) -> DataFrame:
    """cell, q_ids, q_matrix, q_kth: the queries of a batch that meet a cell, up to MEETING in a row. cells: cell, n, low, high. Without a kth column, the
    nearest cells that hold k vectors together; with it (a distance), all others that may hold a nearer one."""
    first = "kth" not in queries.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        names, _, low, high = (np.array(x) for x in zip(*cells))
        for p in parts:
            q, ids = unit(p["vector"]), p["query_id"].to_numpy()
            near, early = bounds(q, pivots, names, low, high), meeting(cells, pivots, q, k)
            kth = np.full(len(q), 4.0) if first else p["kth"].to_numpy(dtype=float)
            meets = early if first else ~early & (near <= kth[:, None])
            for j in np.nonzero(meets.any(0))[0]:
                own = np.nonzero(meets[:, j])[0]
                for at in range(0, len(own), MEETING):  # one row at a time, as each has its vectors
                    m = own[at : at + MEETING]
                    yield pd.DataFrame([(int(names[j]), ids[m], q[m].tobytes(), kth[m])], columns=["q_cell", "q_ids", "q_matrix", "q_kth"])

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.mapInPandas(run, f"q_cell int, q_ids array<{kind}>, q_matrix binary, q_kth array<double>")


def meeting(cells: list[tuple], pivots, q, k: int):
    """queries x cells: the nearest cells of each query that hold k vectors together. cells: cell, n, low, high."""
    import numpy as np

    names, n, low, high = (np.array(x) for x in zip(*cells))
    order = np.argsort(bounds(q, pivots, names, low, high), axis=1, kind="stable")
    before = np.cumsum(n[order], axis=1) - n[order]
    early = np.zeros(order.shape, dtype=bool)
    np.put_along_axis(early, order, before < k, axis=1)
    return early


def best_where_read(blocks: DataFrame, pivots, cells: list[tuple], names: list, q, k: int, kth, found: str) -> DataFrame:
    """found (query_id, id, cosine): the k best of each task's blocks for all queries (names, unit vectors q). Without kth in the cells that they meet
    first, with it (a distance for each query) in the others that may hold a nearer one."""
    early = dict(zip([c[0] for c in cells], meeting(cells, pivots, q, k).T))
    most = max(HELD, 2 * k * len(q))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        least, held, n = np.full(len(q), -np.inf), [], 0

        def kept() -> list:
            query, cosine, ids = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((ids, -cosine, query))
            query, cosine, ids = query[order], cosine[order], ids[order]
            place = np.arange(len(query)) - np.searchsorted(query, query)
            last = place == k - 1
            least[query[last]] = cosine[last]
            return [(query[place < k], cosine[place < k], ids[place < k])]

        for p in parts:
            for r in p.itertuples(index=False):
                mine = early[r.cell] if kth is None else ~early[r.cell] & (bounds(q, pivots, [r.cell], [r.low], [r.high])[:, 0] <= kth)
                if not mine.any():
                    continue
                v, ids, all_own = matrix_of(r), np.asarray(list(r.ids)), np.nonzero(mine)[0]
                for a in range(0, len(all_own), MEETING):
                    own = all_own[a : a + MEETING]
                    cosine = np.round(q[own] @ v.T, 12)
                    at, row = np.nonzero(cosine >= least[own][:, None])
                    held.append((own[at], cosine[at, row], ids[row]))
                    n += len(at)
                    if n > most:
                        held = kept()
                        n = len(held[0][0])
        if held:
            query, cosine, ids = kept()[0]
            for a in range(0, len(query), HELD):
                piece = slice(a, a + HELD)
                yield pd.DataFrame({"query_id": np.asarray(names)[query[piece]], "id": ids[piece], "cosine": cosine[piece]})

    return blocks.mapInPandas(run, found)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK, pivots: int = PIVOTS, put: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """query_id, id, cosine, rank: the k nearest of vectors (id, vector) to each query (query_id, vector), ties by id.

    Exact. Zero vectors have cosine 0; a query or row without a vector finds nothing and is not found.
    put(df, name) writes what is read again (blocks, the first round) to the shared folder; without it that is
    worked out anew.
    """
    import numpy as np

    put = put or (lambda df, name: df)
    id_type, query_type = vectors.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    vectors, queries = vectors.select("id", "vector").where("vector is not null"), queries.select("query_id", "vector").where("vector is not null")
    at = pivots_of(vectors, pivots)
    found = f"query_id {query_type}, id {id_type}, cosine double"
    if at is None:
        return vectors.sparkSession.createDataFrame([], found + ", rank int")
    blocks = put(blocks_of(vectors, at, block), "blocks")
    cells = [tuple(r) for r in blocks.groupBy("cell").agg(F.sum("n"), F.min("low"), F.max("high")).collect()]  # a row for each pivot

    def products(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for p in parts:
            for r in p.itertuples(index=False):
                q, v = np.frombuffer(r.q_matrix).reshape(len(r.q_ids), -1), matrix_of(r)
                able = bounds(q, at, [r.cell], [r.low], [r.high])[:, 0] <= r.q_kth
                if not able.any():
                    continue
                names, ids = np.asarray(r.q_ids)[able], np.asarray(r.ids)
                cosine = np.round(q[able] @ v.T, 12)
                rank = np.argsort(ids, kind="stable")
                best = rank[np.argsort(-cosine[:, rank], axis=1, kind="stable")[:, :k]]
                n = best.shape[1]
                yield pd.DataFrame({"query_id": np.repeat(names, n), "id": ids[best.ravel()], "cosine": np.take_along_axis(cosine, best, axis=1).ravel()})

    top = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(8 * F.size("vector") + 64), F.lit(0)).alias("bytes")).first()
    if size.bytes <= SENT_BYTES and size.n * k <= HELD:
        asked = queries.collect()  # bounded above
        if not asked:
            return vectors.sparkSession.createDataFrame([], found + ", rank int")
        q, names = unit([r.vector for r in asked]), [r.query_id for r in asked]
        first = put(ranked(best_where_read(blocks, at, cells, names, q, k, None, found)), "first")
        far = {r.query_id: r.cosine for r in first.where(F.col("rank") == k).collect()}  # a row for each query
        kth = chords(np.array([far.get(x, -7.0) for x in names]))  # 4 for those with fewer than k
        return ranked(first.drop("rank").unionByName(best_where_read(blocks, at, cells, names, q, k, kth, found)))
    meet = lambda asked: visits(asked, at, cells, k).join(blocks, F.col("q_cell") == F.col("cell")).drop("q_cell").mapInPandas(products, found)
    first = put(ranked(meet(queries)), "first")
    kth = first.where(F.col("rank") == k).select("query_id", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("cosine"))).alias("kth"))
    rest = meet(queries.join(kth, "query_id", "left").fillna(4.0, ["kth"]))
    return ranked(first.drop("rank").unionByName(rest))
