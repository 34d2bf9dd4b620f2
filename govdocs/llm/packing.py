"""Best-fit packing of token pieces into sequences by non-negative least squares over length patterns.

Only the histogram of piece lengths is planned, so that the plan's size depends on the sequence length and
not on the corpus: patterns of one to three lengths that fill a sequence exactly get repeat counts by
sparse non-negative least squares, the counts are rounded to what the histogram holds, and the lengths
left over are packed best-fit decreasing. The rows then find their place from their rank among equal lengths.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from govdocs.llm import tokens
from govdocs.llm.common import Scratch, text_batches, text_or_empty

#: Rows of equal length are ranked within this many buckets, by a hash of their key.
BUCKETS = 1024
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def cut(ids: bytes, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first of a longer one may be short."""
    n = len(ids) // 4
    if n <= most:
        return [(0, n)]
    first = n % most or most
    return [(0, first)] + [(at, most) for at in range(first, n, most)]


def pieces(docs: DataFrame, most: int, path: str, end_id: int) -> DataFrame:
    """PIECES of every document: its ids and the end id, cut at most `most` long. Null text is empty."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end = end_id.to_bytes(4, "little")
        for p in parts:
            rows = []
            for doc, ids in zip(p["doc_id"].astype("Int64"), tokens.encoded(p["text"].tolist(), path)):
                whole = memoryview(ids + end)
                rows += [(doc, k, at, n, zlib.crc32(whole[4 * at : 4 * (at + n)])) for k, (at, n) in enumerate(cut(whole, most))]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInPandas(run, PIECES)


def exact_patterns(lengths, most: int):
    """Index triples into lengths (ascending), -1 for none, of one to three lengths that sum to most."""
    import numpy as np

    at = np.full(most + 1, -1, dtype=np.int64)
    at[lengths] = np.arange(len(lengths))
    rows = [np.array([[at[most], -1, -1]])] if at[most] >= 0 else []
    a = np.arange(len(lengths))
    left = most - lengths
    b = np.where(left > 0, at[np.maximum(left, 0)], -1)
    ok = b >= a
    rows.append(np.stack([a[ok], b[ok], np.full(ok.sum(), -1)], axis=1))
    for i, x in enumerate(lengths):
        second = a[i:]
        left = most - x - lengths[second]
        third = np.where(left > 0, at[np.maximum(left, 0)], -1)
        ok = third >= second
        rows.append(np.stack([np.full(ok.sum(), i), second[ok], third[ok]], axis=1))
    return np.concatenate(rows).astype(np.int64) if rows else np.zeros((0, 3), dtype=np.int64)


def repeat_counts(patterns, histogram, turns: int = 60, batch: int = 256):
    """Sparse non-negative x that makes the lengths used by patterns fit the histogram, by an active set.

    Squares are divided by the histogram, so that rare lengths weigh as much as their share. Each turn
    prices all patterns by the gradient and takes in up to `batch` of the dearest that share no length;
    the taken ones are fitted by least squares and those that would be negative leave. As taken patterns
    are independent, no more than there are lengths have repeats.
    """
    import numpy as np

    n, k = len(histogram), len(patterns)
    index = np.where(patterns < 0, n, patterns)
    scale = 1 / np.sqrt(histogram)
    goal = scale * histogram

    def columns(chosen):
        out = np.zeros((len(chosen), n + 1))
        np.add.at(out, (np.repeat(np.arange(len(chosen)), 3), index[chosen].ravel()), 1)
        return out[:, :n] * scale

    taken, x, held = np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros((0, n))
    gram, best, fitted = np.zeros((0, 0)), float(goal @ goal), (np.zeros(0, dtype=np.int64), np.zeros(0))
    for _ in range(turns):
        gradient = np.append(scale * (goal - x @ held), 0.0)
        price = gradient[index].sum(axis=1)
        price[taken] = 0
        dear, used, new = np.argsort(-price, kind="stable")[: 64 * batch], set(), []
        for j in dear.tolist():
            lengths = set(index[j].tolist()) - {n}
            if price[j] <= 1e-7 or len(new) == batch:
                break
            if not used & lengths:
                used |= lengths
                new.append(j)
        if not new:
            break
        more = columns(np.array(new))
        cross = held @ more.T
        gram = np.block([[gram, cross], [cross.T, more @ more.T]])
        taken, held = np.append(taken, new), np.vstack([held, more])
        while True:
            x = np.linalg.solve(gram + 1e-9 * np.eye(len(taken)), held @ goal)
            stay = x > 1e-9
            if stay.all():
                break
            taken, held, gram = taken[stay], held[stay], gram[np.ix_(stay, stay)]
        rest = goal - x @ held
        now = float(rest @ rest)
        if now >= best * (1 - 1e-4):
            if now < best:
                fitted = (taken, x)
            break
        best, fitted = now, (taken, x)
    out = np.zeros(k)
    out[fitted[0]] = fitted[1]
    return out


def best_fit(histogram: dict[int, int], most: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that pack the histogram best-fit decreasing, whole groups of equal bins at a time."""
    out: list[tuple[tuple[int, ...], int]] = []
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []  # ascending
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                fit = most // length
                whole, part = divmod(n, fit)
                made = [((length,) * fit, whole)] * (whole > 0) + [((length,) * part, 1)] * (part > 0)
                n = 0
            else:
                room = rooms[k]
                bins = open_bins[room]
                held, count = bins.pop()
                if not bins:
                    rooms.pop(k)
                    del open_bins[room]
                take = min(n, count)
                if take < count:
                    bins = open_bins.setdefault(room, [])
                    if not bins:
                        bisect.insort(rooms, room)
                    bins.append((held, count - take))
                n -= take
                made = [((*held, length), take)]
            for held, count in made:
                room = most - sum(held)
                if room == 0:
                    out.append((held, count))
                    continue
                bins = open_bins.setdefault(room, [])
                if not bins:
                    bisect.insort(rooms, room)
                bins.append((held, count))
    return out + [b for bins in open_bins.values() for b in bins]


def rounded(patterns, x, count) -> list[tuple[int, int]]:
    """(pattern, repeats) that the histogram holds: whole repeats first, then one more of each by the part that was cut off."""
    import numpy as np

    left, sums = count.copy(), {}
    for wanted in (np.floor(x + 1e-6).astype(np.int64), (x > 1e-6).astype(np.int64)):
        order = np.argsort(-(x - np.floor(x + 1e-6)) if sums else -x, kind="stable")
        for k in order[wanted[order] > 0].tolist():
            used = [i for i in patterns[k].tolist() if i >= 0]
            many = min([int(wanted[k])] + [int(left[i]) // used.count(i) for i in used])
            if many > 0:
                for i in used:
                    left[i] -= many
                sums[k] = sums.get(k, 0) + many
    return sorted(sums.items(), key=lambda s: -s[1])


def plan(histogram: dict[int, int], most: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that hold exactly the histogram (length to count), none over most.

    The rounded patterns fill their sequences; what they leave over is packed best-fit decreasing. If that
    takes more sequences than the tokens need, the least repeated patterns are given up, an eighth of
    their sequences at a time, so that the rest has more lengths to choose from.
    """
    import numpy as np

    lengths = np.array(sorted(histogram), dtype=np.int64)
    if not len(lengths):
        return []
    count = np.array([histogram[x] for x in lengths.tolist()], dtype=np.int64)
    patterns = exact_patterns(lengths, most)
    chosen = rounded(patterns, repeat_counts(patterns, count.astype(float)), count) if len(patterns) else []
    total, bound = sum(n for _, n in chosen), -(-int((lengths * count).sum()) // most)
    best = None
    for eighths in range(8, 3, -1):
        kept, left, out = total * eighths // 8, count.copy(), []
        for k, n in chosen:
            n = min(n, kept)
            if n > 0:
                kept -= n
                used = [i for i in patterns[k].tolist() if i >= 0]
                for i in used:
                    left[i] -= n
                out.append((tuple(int(lengths[i]) for i in used), n))
        out += best_fit({x: n for x, n in zip(lengths.tolist(), left.tolist()) if n}, most)
        size = sum(n for _, n in out)
        if best is None or size < best[0]:
            best = (size, out)
        if size == bound or not total:
            break
    return best[1]


def slots(planned: list[tuple[tuple[int, ...], int]]):
    """Arrays by length and rank: the first rank of each run, its sequence number and its offset."""
    import numpy as np

    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for held, repeats in planned:
        offset = 0
        for length in held:
            rank = taken.get(length, 0)
            rows.append((length, rank, sequence, offset))
            taken[length] = rank + repeats
            offset += length
        sequence += repeats
    rows.sort()
    a = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return a[:, 0], a[:, 1], a[:, 2], a[:, 3]


def pack(docs: DataFrame, most: int = 2048, path: str | None = None, end_id: int = 0) -> DataFrame:
    """One row per piece: PIECES (length as long) with sequence_id and offset.

    Every piece of every row is placed once; offsets leave no gap and no sequence is longer than `most`.
    Null and empty texts are documents of the end id alone. Rows that repeat a doc_id are packed each;
    a null doc_id keeps its row. An empty table gives an empty result; other columns are ignored.
    """
    import numpy as np

    spark = docs.sparkSession
    text_batches(spark)
    scratch = Scratch(spark, "packing")
    cuts = scratch.put("pieces", pieces(docs, most, path or tokens.vocabulary_path(), end_id))
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(BUCKETS)).cast("int")
    rows = cuts.withColumn("bucket", bucket)
    counts = scratch.put("counts", rows.groupBy("length", "bucket").agg(F.count("*").alias("n")))

    def planned(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("length", "first", "sequence", "offset"), slots(plan(dict(zip(p["length"].tolist(), p["n"].tolist())), most)))))

    # at most `most` rows; in a task, as the plan's arrays would weigh on the driver
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).groupBy()
    runs = histogram.applyInPandas(planned, "length long, first long, sequence long, offset long").collect()
    lengths, first, sequence, offset = np.array(sorted(map(tuple, runs)), dtype=np.int64).reshape(-1, 4).T
    # rank = the bucket's first rank among its length + the rank inside the bucket
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start")
    # by bucket alone, which spreads lengths that many pieces have
    ranked = rows.repartition(F.col("bucket")).withColumn("inside", F.row_number().over(inside) - 1)
    ranked = ranked.join(starts, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("inside"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    shift = 1 << 40
    code = lengths * shift + first

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for p in parts:
            rank = p["rank"].to_numpy()
            k = np.searchsorted(code, p["length"].to_numpy().astype(np.int64) * shift + rank, side="right") - 1
            p = p.assign(doc_id=p["doc_id"].astype("Int64"), sequence_id=sequence[k] + rank - first[k], offset=offset[k])
            yield p.drop(columns="rank")

    return ranked.mapInPandas(place, PIECES.replace("length int", "length long") + ", sequence_id long, offset long")
