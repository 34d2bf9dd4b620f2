"""Near-duplicate documents by SimHash fingerprints and a byte-position inverted index.

Two fingerprints of eight bytes that differ in at most two bits share at least six bytes by position.
The index posts every distinct fingerprint under sets of its byte positions; two that share a posting
list are tallied over all eight positions, pairs under the guaranteed minimum of six are dropped, and
the rest is verified by the bits that differ. Postings of single bytes would grow as n/256, so a list
is keyed by four bytes: two of the four halves of two bytes, of which two differing bits can touch
only two. Each pair is taken from the first such list that it shares.

Lists longer than `long_list` are linked without pairs: two fingerprints within two bits have a common
neighbour within one bit, so that each posts its one-bit neighbours and those that meet there are
linked to the smallest. This is exact too, and linear in the list.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govdocs.llm.common import Scratch, small_side, text_batches, text_or_empty
from govdocs.llm.components import connected_components

BYTES, BITS = 8, 2
LEAST_SHARED = BYTES - BITS
#: The halves of two bytes that are posted together.
HALVES = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]


def shingle_blocks(text: str, words: int) -> Iterator:
    """XXH64 of the shingles of a text, repeats included, in arrays of bounded length; fewer words than a shingle make one, none no array."""
    import numpy as np
    import xxhash

    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return
    joined = b" ".join(tokens)
    starts = [0]
    for t in tokens:
        starts.append(starts[-1] + len(t) + 1)
    width = min(words, len(tokens))
    digest, n = xxhash.xxh64_intdigest, len(tokens) - width + 1
    for at in range(0, n, 1 << 14):  # blocks, so that very long texts stay small
        to = min(n, at + (1 << 14))
        yield np.array([digest(joined[a : b - 1], 42) for a, b in zip(starts[at:to], starts[at + width : to + width])], dtype="<u8")


def majority(blocks) -> int:
    """The 64 bits that are set in over half the hashes; zero without any."""
    import numpy as np

    ones, n = np.zeros(64, dtype=np.int64), 0
    for h in blocks:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint_of(text: str, words: int = 3) -> int:
    """64 majority bits of the XXH64 of the shingles of a text; zero without words."""
    return majority(shingle_blocks(text, words))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of each row; null counts as empty."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for p in parts:
            fp = np.array([fingerprint_of(t, words) for t in p["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": p["doc_id"].astype("Int64"), "fp": fp})

    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInPandas(run, "doc_id long, fp long")


def byte_at(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255))


def half_at(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(65535))


def shared_bytes(a: Column, b: Column) -> Column:
    """How many of the eight positions hold the same byte."""
    return sum((byte_at(a, i) == byte_at(b, i)).cast("int") for i in range(BYTES))


def first_shared_list(a: Column, b: Column) -> Column:
    """Number of the first set of positions on which both agree."""
    out = F.lit(None).cast("int")
    for k, (i, j) in reversed(list(enumerate(HALVES))):
        out = F.when((half_at(a, i) == half_at(b, i)) & (half_at(a, j) == half_at(b, j)), F.lit(k)).otherwise(out)
    return out


def links(distinct: DataFrame, scratch: Scratch, long_list: int) -> DataFrame:
    """a < b: pairs of distinct fingerprints (column fp) that link all which are within two bits."""
    fp = F.col("fp")
    sets = F.array(*[F.struct(F.lit(k).alias("k"), (half_at(fp, i) * 65536 + half_at(fp, j)).alias("key")) for k, (i, j) in enumerate(HALVES)])
    posts = distinct.select("fp", F.explode(sets).alias("s")).select("fp", "s.k", "s.key")
    sizes = scratch.put("lists", posts.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1"))
    short = posts.join(sizes.where(F.col("n") <= long_list).drop("n"), ["k", "key"])
    short = scratch.put("short", short)
    a, b = F.col("a"), F.col("b")
    pairs = short.withColumnRenamed("fp", "a").join(short.withColumnRenamed("fp", "b"), ["k", "key"]).where((a < b) & (first_shared_list(a, b) == F.col("k")))
    pairs = pairs.where(shared_bytes(a, b) >= LEAST_SHARED).where(F.bit_count(a.bitwiseXOR(b)) <= BITS).select("a", "b")
    long = posts.join(sizes.where(F.col("n") > long_list).drop("n"), ["k", "key"]).select("fp").distinct()
    near = F.concat(F.array(fp), F.array(*[fp.bitwiseXOR(F.lit(v if v < 1 << 63 else v - (1 << 64))) for v in (1 << i for i in range(64))]))
    met = long.select("fp", F.explode(near).alias("middle"))
    least = met.groupBy("middle").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    least = scratch.put("middles", least.select("middle", "a"))
    stars = met.join(least, "middle").where(F.col("a") < F.col("fp")).select("a", F.col("fp").alias("b")).distinct()
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, words: int = 3, long_list: int = 64) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id, n_linked.

    component_id is the smallest doc_id reachable over links of two bits or fewer, itself included.
    Texts without words (null and empty too) have fingerprint zero and are linked like any other.
    Fewer words than a shingle make one shingle. n_linked counts the distinct fingerprints of the
    component. Rows that repeat a doc_id are each returned. A null doc_id keeps its row; it has the
    component of its text. An empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.put("prints", fingerprints(docs, words))
    distinct = scratch.put("distinct", prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = scratch.put("edges", links(distinct.select("fp"), scratch, long_list))
    labels = connected_components(edges, scratch)
    comp = labels.join(distinct, labels["node"] == distinct["fp"]).select("node", "comp", "least")
    ids = comp.groupBy("comp").agg(F.min("least").alias("component_id"), F.count("*").alias("n_linked"))
    known = scratch.put("known", comp.join(ids, "comp").select("node", "component_id", "n_linked"))
    known = small_side(known, known.count(), 24)
    least = distinct.select(F.col("fp").alias("d_fp"), "least")
    named = scratch.put("named", least.join(known, F.col("d_fp") == F.col("node"), "left").select("d_fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("n_linked", F.lit(1)).alias("n_linked")))
    out = prints.join(named, F.col("fp") == F.col("d_fp"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_linked")
