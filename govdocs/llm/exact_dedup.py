"""Exact deduplication by distributed most-significant-digit radix partitioning.

Texts are equal when they are identical without ASCII white space. All documents are first split by
length and their leading bytes. Only groups of two or more go on: each round splits them by their next
bytes, in digits that widen eightfold, until a group is a single document or its texts have ended.
Groups are compared byte by byte and numbered by the round that made them; the SHA-256 that is returned
only tells apart rows that repeat a doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govdocs.llm.common import Scratch, null_safe, small_side, text_or_empty

#: What tells a row from others; rows that share all of it are the same document.
KEYS = ["doc_id", "text_sha256", "n_chars"]


def normalised(name: str = "text"):
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(text_or_empty(name), r"[\x20\x09-\x0D]+", "")


def keyed(docs: DataFrame, *more) -> DataFrame:
    """KEYS of docs, after the columns `more`."""
    return docs.select(*more, F.sha2(normalised(), 256).alias("text_sha256"), F.length(text_or_empty()).cast("long").alias("n_chars"))


def numbered_groups(rows: DataFrame, by: list[str], turn: int) -> DataFrame:
    """`by` and gid of groups of two rows or more. The number holds for the table that it is written to."""
    groups = rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return groups.withColumn("new_gid", F.concat_ws("-", F.lit(turn), F.monotonically_increasing_id()))


def radix_groups(docs: DataFrame, base: DataFrame, scratch: Scratch, first: int, widen: int) -> DataFrame:
    """KEYS and gid (one for each set of equal texts) for groups of two rows or more."""
    at_start = ["n_bytes", "digit"]
    shared = scratch.put("start", numbered_groups(base, at_start, 0))
    here = base.join(shared, at_start).withColumnRenamed("new_gid", "gid")
    ended = scratch.put("ended", here.where(F.col("n_bytes") <= first).select(*KEYS, "gid"))
    open_keys = scratch.put("open", here.where(F.col("n_bytes") > first).select(*KEYS, "gid").distinct())
    n_open = open_keys.count()
    if not n_open:
        return ended
    texts = keyed(docs, "doc_id", F.encode(normalised(), "utf-8").alias("body"))
    keys = small_side(open_keys.toDF(*[f"k_{c}" for c in KEYS], "gid"), n_open, 130)
    rest = texts.join(keys, F.col("doc_id").eqNullSafe(F.col("k_doc_id")) & (F.col("text_sha256") == F.col("k_text_sha256")) & (F.col("n_chars") == F.col("k_n_chars")))
    rest = scratch.put("rest", rest.select(*KEYS, "gid", F.expr(f"substring(body, {first + 1})").alias("rest")))
    parts, turn, width = [ended], 1, first * widen
    while True:
        cut = rest.withColumn("digit", F.expr(f"substring(rest, 1, {width})"))
        split = scratch.put(f"split{turn}", numbered_groups(cut, ["gid", "digit"], turn))
        moved = cut.join(split, ["gid", "digit"])
        moved = moved.select(*KEYS, F.col("new_gid").alias("gid"), F.expr(f"substring(rest, {width + 1})").alias("rest"), (F.length("rest") <= width).alias("over"))
        moved = scratch.put(f"moved{turn}", moved)
        scratch.drop("rest" if turn == 1 else f"moved{turn - 1}")
        parts.append(scratch.put(f"ended{turn}", moved.where("over").drop("rest", "over")))
        rest = moved.where("not over").drop("over")
        if rest.isEmpty():
            break
        turn, width = turn + 1, width * widen
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def exact_duplicates(docs: DataFrame, first: int = 64, widen: int = 8) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, n_chars, n_same.

    Of equal texts the one with the most code points in its original text stays, then the smallest
    doc_id (a null doc_id sorts last). group_size counts rows. Null and empty texts are equal to each
    other. A doc_id with several texts is judged for each of them. Rows that repeat doc_id, text and
    length (also if their white space differs) count in group_size, get the same result and say in n_same
    how many they are. An empty table gives an empty result. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    docs = docs.select("doc_id", "text")
    base = docs.select("doc_id", F.length(text_or_empty()).cast("long").alias("n_chars"), normalised().alias("norm"))
    base = base.select("doc_id", "n_chars", F.sha2("norm", 256).alias("text_sha256"), F.length(F.encode("norm", "utf-8")).cast("long").alias("n_bytes"), F.expr(f"substring(encode(norm, 'utf-8'), 1, {first})").alias("digit"))
    base = scratch.put("base", base)
    members = radix_groups(docs, base, scratch, first, widen)
    best = members.groupBy("gid").agg(F.count("*").alias("group_size"), F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id")).alias("best"))
    best = scratch.put("best", best.select("gid", "group_size", F.col("best.doc_id").alias("keep_id"), (-F.col("best.less")).alias("keep_chars")))
    held = members.groupBy(*KEYS, "gid").agg(F.count("*").alias("n_same")).join(best, "gid")
    held = scratch.put("held", held.select(*[F.col(c).alias(f"m_{c}") for c in KEYS], "n_same", "group_size", "keep_id", "keep_chars"))
    out = base.join(held, null_safe(base, held, {c: f"m_{c}" for c in KEYS}), "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    kept = alone | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars")))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), kept.alias("kept"), "text_sha256", "n_chars", F.coalesce("n_same", F.lit(1)).alias("n_same"))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each set of equal texts, as `exact_duplicates` chooses it; all columns are kept.

    Of rows that repeat doc_id and text one stays, whichever of them. A doc_id with several texts loses
    only those that equal a text that stays; a null doc_id stays if its text is the only one. Columns of
    any name pass through. An empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "exact-dropped")
    found = exact_duplicates(docs).where("not kept or n_same > 1").select(*[F.col(c).alias(f"__{c}") for c in KEYS], F.col("kept").alias("__kept")).distinct()
    found = scratch.put("found", found)
    size, again = found.count(), found.where("__kept")
    own = keyed(docs, *[F.col(f"`{c}`") for c in docs.columns]).toDF(*docs.columns, "__sha", "__chars")
    match = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("__sha") == F.col("__text_sha256")) & (F.col("__chars") == F.col("__n_chars"))
    out = own.join(small_side(found, size, 110), match, "left_anti").select(*docs.columns)
    if again.isEmpty():
        return out
    once = own.join(small_side(again, size, 110), match, "left_semi").dropDuplicates(["doc_id", "__sha", "__chars"]).select(*docs.columns)
    return out.unionByName(once)
