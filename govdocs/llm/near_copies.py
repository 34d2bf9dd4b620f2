"""Near copies of a given similarity: SimHash links first, then all that fingerprints cannot guarantee.

Links of the SimHash index (byte-position lists, count filter) are verified by the Jaccard similarity of
the shingle sets. Sets that are alike to 0.8 differ in four to nine of 64 bits as a rule, more than lists
of whole bytes can guarantee, so that prefix filtering completes the links without loss: two sets of
which 0.8 of the union is shared have a common member among the first fifth (and one more) of each, in
any one order of all shingles. The order is by hash, with those of long lists last, so that a passage in
many documents makes no pairs of them.

Large groups are linked without their pairs: in some rounds each set is compared with a few others of its
lists, which belong to other components so far. Only pairs of different components are then left; of
these, maps of 1024 bits rule out all whose differing bits alone make 0.8 impossible, wide maps of 8 to
16 bits a shingle nearly all others below 0.8, and the rest is verified by the whole sets. Wide maps and
sets go to cells of pairs that share them, not to each pair. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from govdocs.llm import simhash
from govdocs.llm.common import Scratch, small_side, text_batches, text_or_empty
from govdocs.llm.components import connected_components

#: Bits of the maps that say which shingles go last and which may be shared. A bit may stand for several: any choice
#: of the last gives the same links, and what is not shared after all is dropped.
MAP_BITS = 1 << 25
#: Longs of the map of a set.
MAP_LONGS = 16
#: How many others a set is compared with in each round.
PROBES = (16,)
#: Rows from which on a list's pairs are ruled out by maps where they meet, instead of being written first.
HEAVY = 256
#: Keys of a set in long lists before the one where it meets another: a pair that shares one of them is not made again.
KEYS_BEFORE = 32
#: Pairs of a cell on average, and sets of a list that meet in one.
CELL_PAIRS, CELL_SETS = 256, 256
#: Bits of a page of the maps that count shingles.
PAGE_BITS = 16
PLACE = ("sid", "n", "at", "comp")
MAPS = [f"m{i}" for i in range(MAP_LONGS)]


def shingle_hashes(text: str, words: int = 5):
    """Sorted distinct hashes of the shingles of a text; fewer words than a shingle make one."""
    import numpy as np

    blocks = list(simhash.shingle_blocks(text, words))
    return np.unique(np.concatenate(blocks).view(np.int64)) if blocks else np.zeros(0, dtype=np.int64)


def is_set(shingles, bits):
    """Whether the bit of each shingle is set."""
    import numpy as np

    place = shingles.view(np.uint64) % np.uint64(MAP_BITS)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def first_fifth(shingles, last=None):
    """The first fifth of a set and one more, those whose bit is set in `last` behind all others."""
    import numpy as np

    most = len(shingles) // 5 + 1
    if last is None:
        return shingles[:most]
    behind = is_set(shingles, last)
    return np.concatenate([shingles[~behind], shingles[behind]])[:most]


def set_map(shingles):
    """MAP_LONGS longs with the bit of each shingle set."""
    import numpy as np

    bits = np.zeros(64 * MAP_LONGS, dtype=np.uint8)
    bits[(shingles.view(np.uint64) >> np.uint64(40)) % np.uint64(64 * MAP_LONGS)] = 1
    return np.packbits(bits, bitorder="little").view("<i8")


def wide_map(shingles):
    """A map of 8 to 16 bits for each shingle, a power of two (64 at least): its bytes are 0 or 1 here, one for each bit."""
    import numpy as np

    size = max(64, 1 << (8 * len(shingles) - 1).bit_length()) if len(shingles) else 64
    bits = np.zeros(size, dtype=np.uint8)
    bits[(shingles.view(np.uint64) >> np.uint64(20)) % np.uint64(size)] = 1
    return bits


def alone(a, b) -> tuple[int, int]:
    """How many bits are set in one of two packed wide maps alone, the larger folded to the smaller's size."""
    import numpy as np

    size = min(len(a), len(b))
    fold = lambda x: np.bitwise_or.reduce(x.reshape(-1, size), axis=0)
    a, b = fold(a), fold(b)
    return int(np.bitwise_count(a & ~b).sum()), int(np.bitwise_count(b & ~a).sum())


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id, body (hash of the text) and text of each row; null counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("body"), text_or_empty().alias("text"))


def marks(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, body, sid (hash of the set), fp (fingerprint), n (size), first (the lowest fifth and one more) and MAPS of each row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import xxhash

        for p in parts:
            rows = []
            for t in p["text"]:
                blocks = list(simhash.shingle_blocks(t, words))
                s = np.unique(np.concatenate(blocks).view(np.int64)) if blocks else np.zeros(0, dtype=np.int64)
                rows.append((xxhash.xxh64_intdigest(s.tobytes()), simhash.majority(blocks), len(s), first_fifth(s), set_map(s)))
            sid, fp, n, first, maps = zip(*rows)
            signed = lambda x: np.array(x, dtype=np.uint64).view(np.int64)
            out = {"doc_id": p["doc_id"].astype("Int64"), "body": p["body"], "sid": signed(sid), "fp": signed(fp), "n": n, "first": first}
            yield pd.DataFrame(out | dict(zip(MAPS, np.stack(maps).T)))

    return texts_of(docs).mapInPandas(run, "doc_id long, body long, sid long, fp long, n int, first array<long>, " + ", ".join(f"{m} long" for m in MAPS))


def of_sets(docs: DataFrame, reps: DataFrame, words: int, make, schema: str, once: bool) -> DataFrame:
    """sid and what `make` gives for the shingles of each row of reps (sid, doc_id, body), whose texts are read again. once: rows of docs that repeat doc_id and text give it once."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(sid, *make(shingle_hashes(t, words))) for sid, t in zip(p["sid"], p["text"])]
            if rows:
                yield pd.DataFrame(rows, columns=["sid", *[c.strip().split(" ")[0] for c in schema.split(",")]])

    reps = small_side(reps.select(F.col("doc_id").alias("r_id"), F.col("body").alias("r_body"), "sid"), reps.count(), 32)
    texts = texts_of(docs).join(reps, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("body") == F.col("r_body"))).select("sid", "text")
    return (texts.dropDuplicates(["sid"]) if once else texts).mapInPandas(run, f"sid long, {schema}")


def bit_map(sets: DataFrame, more_than: int):
    """MAP_BITS bits, set for the keys that more prefixes (first) have; None without any. The map has this size whatever the corpus.

    Keys travel in four bytes, by page of the map; what is told apart by their other bits only counts together, and is told apart later.
    """
    import numpy as np

    def dealt(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            keys = np.sort(np.concatenate([np.zeros(0, dtype=np.int64), *p["first"]]).view(np.uint64))
            again = np.zeros(len(keys), dtype=bool)
            again[more_than + 1 :] = keys[more_than + 1 :] == keys[: -more_than - 1]  # more of one batch say nothing more
            keys = keys[~again]
            place = (keys % np.uint64(MAP_BITS)).astype(np.uint32)
            # the place in its page and bits beyond the map's: what tells keys of a page apart
            rest = (keys >> np.uint64(25)).astype(np.uint32) << np.uint32(PAGE_BITS) | place & np.uint32((1 << PAGE_BITS) - 1)
            page = place >> np.uint32(PAGE_BITS)
            order = np.argsort(page, kind="stable")
            names, starts = np.unique(page[order], return_index=True)
            if len(names):
                yield pd.DataFrame({"page": names.astype(np.int64), "rest": [x.astype("<u4").tobytes() for x in np.split(rest[order], starts[1:])]})

    def counted(p: pd.DataFrame) -> pd.DataFrame:
        keys, posts = np.unique(np.frombuffer(b"".join(p["rest"]), dtype="<u4"), return_counts=True)
        page = np.zeros(1 << PAGE_BITS, dtype=np.uint8)
        page[keys[posts > more_than] & np.uint32((1 << PAGE_BITS) - 1)] = 1
        return pd.DataFrame({"page": p["page"][:1], "bits": [np.packbits(page, bitorder="little").tobytes()]}) if page.any() else pd.DataFrame({"page": [], "bits": []})

    pages = sets.select("first").mapInPandas(dealt, "page long, rest binary").groupBy("page").applyInPandas(counted, "page long, bits binary").collect()
    if not pages:
        return None
    out = np.zeros(MAP_BITS // 8, dtype=np.uint8)
    for r in pages:
        out[r.page << PAGE_BITS - 3 : (r.page + 1) << PAGE_BITS - 3] = np.frombuffer(r.bits, dtype=np.uint8)
    return out


def keys_in(sets: DataFrame, bits, schema: str) -> DataFrame:
    """sid, n and the keys (with their places) of the prefixes whose bit is set, as far as there are any."""
    shared = sets.sparkSession.sparkContext.broadcast(bits)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for p in parts:
            firsts = [np.asarray(s, dtype=np.int64) for s in p["first"]]
            at = [np.nonzero(is_set(s, shared.value))[0] for s in firsts]
            out = p.drop(columns="first").assign(at=at, keys=[s[a] for s, a in zip(firsts, at)])
            yield out[[len(a) > 0 for a in at]]

    return sets.mapInPandas(run, f"{schema}, at array<long>, keys array<long>")


def shared_lists(docs: DataFrame, uniq: DataFrame, words: int, long_list: int, once: bool, scratch: Scratch) -> DataFrame:
    """key, sid, n, at (from 0): the prefixes of all sets, as far as they share a key with another."""
    sets = uniq.select("sid", "n", "first")
    last = bit_map(sets, long_list)
    if last is not None:
        touched = keys_in(uniq.select("sid", "doc_id", "body", "first"), last, "sid long, doc_id long, body long")
        touched = scratch.put("touched", touched.select("sid", "doc_id", "body"))
        shared = docs.sparkSession.sparkContext.broadcast(last)
        again = of_sets(docs, touched, words, lambda s: (len(s), first_fifth(s, shared.value)), "n int, first array<long>", once)
        same = sets.join(small_side(touched.select("sid"), touched.count(), 16), "sid", "left_anti")
        sets = same.unionByName(scratch.put("again", again))
    twice = bit_map(sets, 1)
    if twice is None:
        return sets.select(F.lit(0).cast("long").alias("key"), "sid", "n", F.lit(0).alias("at")).limit(0)
    posts = keys_in(sets, twice, "sid long, n int").select("sid", "n", F.explode(F.arrays_zip("at", "keys")).alias("p")).select(F.col("p.keys").alias("key"), "sid", "n", F.col("p.at").cast("int").alias("at"))
    posts = scratch.put("posts", posts)
    keys = scratch.put("keys", posts.groupBy("key").agg(F.count("*").alias("posts")).where("posts > 1").select("key"))
    lists = scratch.put("lists", posts.join(keys, "key", "left_semi"))
    for name in ("posts", "keys", *(() if last is None else ("touched", "again"))):
        scratch.drop(name)  # all that follows reads the lists
    return lists


def reaches(shared: Column, a: Column, b: Column) -> Column:
    """Whether sets of a and b members that share so many reach 0.8: shared / (a + b - shared) >= 4 / 5."""
    return 9 * shared >= 4 * (a + b)


def may_reach() -> Column:
    """Whether the maps (a_*, b_*) of two sets leave 0.8 possible: a bit of one map alone stands for a member that the other set has not."""
    alone = lambda x, y: sum(F.bit_count(F.col(f"{x}_{m}").bitwiseAND(F.bitwise_not(F.col(f"{y}_{m}")))) for m in MAPS)
    return reaches(F.least(F.col("a_n") - alone("a", "b"), F.col("b_n") - alone("b", "a")), F.col("a_n"), F.col("b_n"))


@dataclass(frozen=True)
class Sets:
    """What pairs are verified by: the texts, and one row for each set (uniq: sid, doc_id, body, n, MAPS)."""

    docs: DataFrame
    uniq: DataFrame
    words: int

    def possible(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b; key, list) without those whose maps rule out 0.8."""
        side = lambda x: self.uniq.select(F.col("sid").alias(x), F.col("n").alias(f"{x}_n"), *[F.col(m).alias(f"{x}_{m}") for m in MAPS])
        return pairs.join(side("a"), "a").join(side("b"), "b").where(may_reach()).select("a", "b", "key", "list")

    def tested(self, pairs: DataFrame, whole: bool, scratch: Scratch, name: str) -> DataFrame:
        """Pairs (a, b; key, list) whose wide maps leave 0.8 possible, or (whole) whose sets reach it.

        Pairs meet what they need in cells: those of one list together, as far as it is short, else blocks of it.
        """
        cells = -(-pairs.count() // CELL_PAIRS)
        if not cells:
            return pairs
        block = lambda x: F.pmod(F.xxhash64(x), F.ceil(F.col("list") / CELL_SETS))
        pairs = pairs.withColumn("cell", F.pmod(F.xxhash64("key", block("a"), block("b")), F.lit(cells)))
        need = pairs.select("cell", F.col("a").alias("sid")).union(pairs.select("cell", "b")).distinct().groupBy("sid").agg(F.collect_list("cell").alias("cells"))
        need = scratch.put(f"{name}-asked", self.uniq.select("sid", "doc_id", "body").join(need, "sid"))
        words = self.words

        def make(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import numpy as np

            for p in parts:
                for sid, text, at in zip(p["sid"], p["text"], p["cells"]):
                    s = shingle_hashes(text, words)
                    held = s.tobytes() if whole else np.packbits(wide_map(s)).tobytes()
                    for few in np.array_split(at, -(-len(at) * len(held) // (1 << 23)) or 1):  # 8 MB at a time
                        yield pd.DataFrame({"cell": few, "sid": sid, "n": len(s), "held": held})

        def meet(both: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
            import numpy as np

            held = {sid: (n, np.frombuffer(x, dtype=np.int64 if whole else np.uint8)) for sid, n, x in zip(sets["sid"], sets["n"], sets["held"])}
            ok = []
            for a, b in zip(both["a"], both["b"]):
                (na, x), (nb, y) = held[a], held[b]
                if whole:
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                else:
                    only = alone(x, y)
                    shared = min(na - only[0], nb - only[1])
                ok.append(9 * shared >= 4 * (na + nb))
            return both.loc[np.array(ok, dtype=bool), ["a", "b", "key", "list"]]

        asked = small_side(need.select(F.col("doc_id").alias("r_id"), F.col("body").alias("r_body"), "sid", "cells"), need.select(F.sum(F.size("cells") + 8)).first()[0] or 0, 8)
        texts = texts_of(self.docs).join(asked, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("body") == F.col("r_body"))).select("sid", "text", "cells")
        sets = texts.mapInPandas(make, "cell long, sid long, n int, held binary")
        return pairs.groupBy("cell").cogroup(sets.groupBy("cell")).applyInPandas(meet, "a long, b long, key long, list long")

    def verified(self, pairs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
        """Those of pairs (a, b; key and list: where they met, and how many sets meet there) whose whole sets reach 0.8."""
        pairs = scratch.put(f"{name}-pairs", self.possible(pairs))
        pairs = scratch.put(f"{name}-wide", self.tested(pairs, False, scratch, name))
        return scratch.put(f"{name}-links", self.tested(pairs, True, scratch, name).select("a", "b"))


def room(x: str, y: str) -> Column:
    """Whether the places of a common key leave room for 0.8: all members before it are not shared."""
    n = [F.col(f"{s}_n") for s in (x, y)]
    return reaches(F.least(n[0] - F.col(f"{x}_at"), n[1] - F.col(f"{y}_at")), n[0], n[1])


def similar_sets(docs: DataFrame, uniq: DataFrame, words: int, long_list: int, once: bool, scratch: Scratch) -> DataFrame:
    """sid and comp (the least sid of its component) for all sets with a link to another of 0.8 or more."""
    lists = shared_lists(docs, uniq, words, long_list, once, scratch)
    prints = scratch.put("prints", uniq.groupBy("fp").agg(F.min("sid").alias("least"), F.count("*").alias("n")))
    near = simhash.links(prints.select("fp"), scratch, long_list)
    name = lambda x: prints.select(F.col("fp").alias(x), F.col("least").alias(f"{x}_sid"))
    near = near.join(name("a"), "a").join(name("b"), "b").select(F.col("a_sid").alias("a"), F.col("b_sid").alias("b"))
    alike = uniq.select("sid", "fp").join(prints.where("n > 1").select("fp", "least"), "fp").where("sid <> least")
    near = near.unionByName(alike.select(F.col("least").alias("a"), F.col("sid").alias("b")))
    met_at = lambda pairs, key: pairs.select("a", "b", F.col(key).alias("key"), F.lit(1).cast("long").alias("list"))
    near = scratch.put("near", near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    sets = Sets(docs, uniq, words)
    links = sets.verified(met_at(near, "a"), scratch, "near")
    tried, placed = near, lists
    for turn in range(len(PROBES) + 1):
        comps = connected_components(links, Scratch(docs.sparkSession, f"near-comps{turn}")).withColumnRenamed("node", "sid")
        links = comps.where("comp <> sid").select(F.col("comp").alias("a"), F.col("sid").alias("b"))  # a star for each component
        placed = placed.select("key", "sid", "n", "at").join(comps, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
        # of each list another head in each round; later one that has links, if there is any
        head = F.min(F.struct((F.col("sid") == F.col("comp")) if turn else F.lit(True), F.xxhash64("sid", "key", F.lit(turn)), "sid", "n", "at", "comp"))
        mixed = placed.groupBy("key").agg(head.alias("h"), F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count("*").alias("list")).where("c1 <> c2")
        placed = scratch.put(f"mixed{turn}", placed.join(mixed.select("key", "list", *[F.col(f"h.{c}").alias(f"b_{c}") for c in PLACE]), "key"))
        if turn:
            scratch.drop(f"mixed{turn - 1}")
        if turn == len(PROBES):
            break
        met = placed.select(*[F.col(c).alias(f"a_{c}") for c in PLACE], *[f"b_{c}" for c in PLACE])
        met = met.where((F.col("a_comp") != F.col("b_comp")) & room("a", "b"))
        met = met.select("a_sid", F.least("a_sid", "b_sid").alias("a"), F.greatest("a_sid", "b_sid").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        few = F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64("a", "b", F.lit(turn)).alias("h"), "a", "b"))), 1, PROBES[turn])
        met = met.groupBy("a_sid").agg(few.alias("p")).select(F.explode("p").alias("p")).select("p.a", "p.b").distinct()
        met = scratch.put(f"met{turn}", met)
        links, tried = links.unionByName(sets.verified(met_at(met, "a"), scratch, f"round{turn}")), tried.unionByName(met)
    on = (F.col("a_sid") < F.col("b_sid")) & (F.col("a_comp") != F.col("b_comp")) & room("a", "b")
    named = lambda met: met.groupBy(F.col("a_sid").alias("a"), F.col("b_sid").alias("b")).agg(F.min("key").alias("key"), F.max("list").alias("list"))
    both = lambda df, more=(): (df.select("key", "list", *[F.col(c).alias(f"a_{c}") for c in (*PLACE, *more)]), df.select("key", *[F.col(c).alias(f"b_{c}") for c in (*PLACE, *more)]))
    a, b = both(placed.where(F.col("list") <= HEAVY))
    light = a.join(b, "key").where(on).select("key", "list", "a_sid", "b_sid")
    # sets that share one of the keys before have met there
    before = F.collect_list("key").over(Window.partitionBy("sid").orderBy("at").rowsBetween(-KEYS_BEFORE, -1))
    heavy = placed.where(F.col("list") > HEAVY).select("key", "list", "sid", "n", "at", "comp", before.alias("before")).join(uniq.select("sid", *MAPS), "sid")
    a, b = both(scratch.put("heavy", heavy), ("before", *MAPS))
    heavy = a.join(b, "key").where(on & may_reach() & ~F.arrays_overlap("a_before", "b_before")).select("key", "list", "a_sid", "b_sid")
    pairs = named(light.unionByName(heavy))
    links = links.unionByName(sets.verified(pairs.join(tried, ["a", "b"], "left_anti"), scratch, "rest"))
    return connected_components(links, scratch).withColumnRenamed("node", "sid")


def drop_near_duplicates(docs: DataFrame, words: int = 5, long_list: int = 64) -> DataFrame:
    """docs with one row of each component of texts with a similarity of 0.8 or more: the smallest doc_id (null last); all columns are kept.

    Texts with the same shingles (none, too: null and empty texts) are near copies. A doc_id with several
    texts loses only those that are copies. Of rows that repeat doc_id and text one stays, whichever of
    them. Columns of any name pass through; an empty table stays empty.
    """
    spark = docs.sparkSession
    text_batches(spark, 400, "8m")
    scratch = Scratch(spark, "near-copies")
    rows = scratch.put("rows", marks(docs, words))
    me = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body")
    many = scratch.put("many", rows.groupBy("sid").agg(F.count("*").alias("n_rows"), F.min(me).alias("me")).where("n_rows > 1"))
    many = small_side(many.select(F.col("sid").alias("m_sid"), "me"), many.count(), 48)
    uniq = rows.join(many, F.col("sid") == F.col("m_sid"), "left").where(F.col("me").isNull() | (me == F.col("me"))).drop("m_sid", "me")
    once = not rows.groupBy("doc_id", "body").agg(F.count("*").alias("n")).where("n > 1").isEmpty()  # rows that repeat both
    if once:
        uniq = scratch.put("uniq", uniq.dropDuplicates(["sid"]))
    comps = similar_sets(docs, uniq, words, long_list, once, scratch)
    named = rows.groupBy("sid", "doc_id", "body").agg(F.count("*").alias("same")).join(comps, "sid", "left").withColumn("comp", F.coalesce("comp", "sid")).withColumn("me", me)
    named = scratch.put("named", named)
    kept = scratch.put("kept", named.groupBy("comp").agg(F.min("me").alias("stays"), F.count("*").alias("n")).where("n > 1").drop("n"))
    found = named.join(kept, "comp", "left").withColumn("__stays", F.coalesce(F.col("me") == F.col("stays"), F.lit(True))).where("not __stays or same > 1")
    found = scratch.put("found", found.select(F.col("doc_id").alias("__id"), F.col("body").alias("__body"), "__stays"))
    size, again = found.count(), found.where("__stays")
    own = docs.select("*", F.xxhash64(text_or_empty()).alias("__own"))
    match = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__body"))
    out = own.join(small_side(found, size, 32), match, "left_anti").select(*docs.columns)
    if again.isEmpty():
        return out
    once = own.join(small_side(again, size, 32), match, "left_semi").dropDuplicates(["doc_id", "__own"]).select(*docs.columns)
    return out.unionByName(once)
