"""Mixing sources to target weights over a domain-language-source tree.

A budget of tokens goes down the tree. Children share their parent's budget by weight, but none gets more
than its subtree can give over the allowed epochs; what one cannot use goes to its siblings, and only a
parent whose whole subtree is short leaves tokens to its own siblings. Each leaf then takes whole passes
over its documents and a prefix, in tokens, of one more pass in a seeded order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from govdocs.llm.common import WORD, Scratch, small_side, text_or_empty

LEVELS = ["domain", "lang", "source"]
#: Slices of a leaf's seeded order. Only the slice in which its prefix ends is sorted.
SLICES = 4096


def share(nodes: DataFrame, parents: list[str]) -> DataFrame:
    """Adds budget: the parent's (parent_budget) shared by weight among siblings, at most cap each.

    Siblings are filled in order of cap / weight: one is full if the level that the rest of the budget
    reaches over the rest of the weights is above its own. Decimals keep the comparison exact.
    """
    order = [F.col("cap") / F.col("weight"), *(F.col(c) for c in LEVELS if c in nodes.columns)]
    by = Window.partitionBy(*[F.col(c) for c in parents]).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*[F.col(c) for c in parents])
    nodes = nodes.withColumns({"cap_before": F.coalesce(F.sum("cap").over(by), F.lit(0)), "weight_before": F.coalesce(F.sum("weight").over(by), F.lit(0)), "weight_all": F.sum("weight").over(whole)})
    big = lambda c: F.col(c).cast("decimal(18,0)")
    left, weights = big("parent_budget") - big("cap_before"), big("weight_all") - big("weight_before")
    full = big("cap") * weights <= left * big("weight")
    nodes = nodes.withColumn("full", full)
    # the first that is not full sets the level for itself and all after it
    level = F.min(F.when(~F.col("full"), F.struct(*order, (big("parent_budget") - big("cap_before")).alias("left"), weights.alias("weights")))).over(whole)
    nodes = nodes.withColumn("level", level)
    part = F.floor(big("weight") * F.col("level.left") / F.col("level.weights")).cast("long")
    return nodes.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(F.greatest(F.lit(0), F.least(part, F.col("cap"))))).drop("cap_before", "weight_before", "weight_all", "full", "level", "parent_budget")


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], budget: int, epochs: int) -> DataFrame:
    """LEVELS, avail, budget of each leaf (LEVELS, avail: its tokens in one epoch). weights: level to name to a positive integer; others weigh 1."""

    def weight(level: str) -> Column:
        known = weights.get(level, {})
        out = F.lit(1)
        for name, w in known.items():
            out = F.when(F.col(level) == name, F.lit(int(w))).otherwise(out)
        return out.cast("long")

    cap = F.col("avail") * epochs
    at = None
    for k, level in enumerate(LEVELS):
        keys = LEVELS[: k + 1]
        nodes = leaves.groupBy(*keys).agg(F.sum(cap).alias("cap")).withColumn("weight", weight(level))
        nodes = nodes.join(at, keys[:-1]) if k else nodes.withColumn("parent_budget", F.lit(budget).cast("long"))
        at = share(nodes, keys[:-1]).select(*keys, "budget")
        if k + 1 < len(LEVELS):
            at = at.withColumnRenamed("budget", "parent_budget")
    return leaves.join(at, LEVELS)


def seeded(seed: int, epoch: Column) -> Column:
    """A document's place in the order of an epoch; 32 hex digits."""
    return F.md5(F.concat_ws("-", F.lit(seed), epoch, F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], fraction: float, epochs: int = 2, seed: int = 7) -> DataFrame:
    """One row per row of docs (doc_id, text, lang, source): doc_id, domain, lang, source, n_tokens, copies, body (a hash of the text).

    The budget is `fraction` of all tokens (words without ASCII white space). copies: in how many
    epochs the document is taken. A leaf's prefix ends before the first document that would exceed its
    budget. Null domains, languages and sources are the leaf named ''. Null and empty texts have no
    tokens; they are taken while the prefix lasts. Rows that repeat a doc_id stand beside each other in
    the order and are each returned; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    named = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for c, n in ((domain, "domain"), (F.col("lang"), "lang"), (F.col("source"), "source"))]
    rows = scratch.put("rows", docs.select("doc_id", *named, F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("n_tokens"), F.xxhash64(text_or_empty()).alias("body")))
    leaves = scratch.put("leaves", rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("avail")))
    total = leaves.agg(F.sum("avail")).first()[0] or 0
    plan = leaf_budgets(leaves, weights, int(total * fraction), epochs)
    passes = F.when(F.col("avail") > 0, F.least(F.lit(epochs), F.floor(F.col("budget") / F.col("avail")))).otherwise(F.lit(1))
    plan = plan.withColumn("passes", passes.cast("long")).withColumn("part", F.col("budget") - F.col("passes") * F.col("avail"))
    plan = scratch.put("plan", plan.select(*LEVELS, "passes", "part"))
    # the order of the epoch that is taken in part; the slice is its first three digits
    placed = rows.join(plan, LEVELS).withColumn("place", seeded(seed, F.col("passes") + 1)).withColumn("slice", F.conv(F.substring("place", 1, 3), 16, 10).cast("int"))
    sums = scratch.put("sums", placed.groupBy(*LEVELS, "slice").agg(F.sum("n_tokens").alias("n")))
    upto = Window.partitionBy(*LEVELS).orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    ends = sums.withColumn("upto", F.sum("n").over(upto)).join(plan, LEVELS)
    ends = ends.groupBy(*LEVELS).agg(F.min(F.when(F.col("upto") > F.col("part"), F.struct("slice", (F.col("upto") - F.col("n")).alias("before")))).alias("end"))
    ends = scratch.put("ends", plan.join(ends, LEVELS, "left").select(*LEVELS, "passes", "part", F.col("end.slice").alias("end_slice"), F.coalesce("end.before", F.lit(0)).alias("before")))
    placed = rows.join(ends, LEVELS).withColumn("place", seeded(seed, F.col("passes") + 1)).withColumn("slice", F.conv(F.substring("place", 1, 3), 16, 10).cast("int"))
    edge = F.col("slice") == F.col("end_slice")
    run = Window.partitionBy(*LEVELS, "slice").orderBy("place", "doc_id", "n_tokens", "body").rowsBetween(Window.unboundedPreceding, 0)
    last = placed.where(edge).withColumn("more", (F.col("before") + F.sum("n_tokens").over(run) <= F.col("part")).cast("long"))
    rest = placed.where(~F.coalesce(edge, F.lit(False))).withColumn("more", (F.col("end_slice").isNull() | (F.col("slice") < F.col("end_slice"))).cast("long"))
    out = last.unionByName(rest)
    open_end = (F.col("part") > 0) | (F.col("passes") == 0)
    more = F.when(F.col("passes") >= epochs, F.lit(0)).otherwise(F.when(open_end, F.col("more")).otherwise(F.lit(0)))
    return out.select("doc_id", *LEVELS, "n_tokens", (F.col("passes") + more).cast("long").alias("copies"), "body")


def drop_unmixed(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], fraction: float) -> DataFrame:
    """docs without the rows that one epoch of the mix does not take; all columns are kept.

    A doc_id with several texts loses only those that are not taken. Rows that repeat doc_id and text stay
    together if one of them is taken. Null and empty texts are rows without tokens; an empty table stays empty.
    """
    mixed = mix(docs, domain, weights, fraction, epochs=1)
    gone = mixed.groupBy(F.col("doc_id").alias("__id"), F.col("body").alias("__body")).agg(F.max("copies").alias("most")).where("most = 0").drop("most")
    gone = Scratch(docs.sparkSession, "unmixed").put("gone", gone)
    own = docs.select("*", F.xxhash64(text_or_empty()).alias("__own"))
    match = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__body"))
    return own.join(small_side(gone, gone.count(), 24), match, "left_anti").select(*docs.columns)


def source_domain() -> Column:
    """The sources of the test tables by four domains: the number in their name modulo four."""
    return F.concat(F.lit("domain"), F.pmod(F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int"), F.lit(0)), F.lit(4)).cast("string"))


#: Target weights of the registered query.
WEIGHTS = {"domain": {"domain0": 2, "domain1": 3, "domain2": 3, "domain3": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {}}
