"""Access levels, persona scopes and the filters they resolve to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govdocs.operators import bm25, profiles
from govdocs.operators.profiles import ARRAYS, SCALARS
from govdocs.settings import ACCESS_LEVELS

#: Dimension -> scope column of the persona.
SCOPES = {"departments": "department_scope", "regions": "regions", "policy_types": "allowed_policy_types", "owners": "owner_scope"}


def levels() -> Column:
    return F.array(*map(F.lit, ACCESS_LEVELS))


def level_rank(c: Column) -> Column:
    """1 for public up to 4 for confidential; 0 for anything else."""
    return F.array_position(levels(), c)


def levels_up_to(c: Column) -> Column:
    return F.slice(levels(), F.lit(1), F.greatest(level_rank(c), F.lit(0)).cast("int"))


def resolve_scope(requested: Column, scope: Column, name: str) -> tuple[Column, Column]:
    """(allowed, reason). No scope passes the request; no request gives the scope; else the canonical spellings that both have, in the order of the request."""
    asked = F.coalesce(F.size(requested) > 0, F.lit(False))
    spelled = F.transform(requested, lambda v: F.get(F.filter(scope, lambda s: F.lower(s) == F.lower(v)), F.lit(0)))
    both = F.array_distinct(F.filter(spelled, lambda s: s.isNotNull()))
    denied = F.filter(requested, lambda v: ~F.exists(scope, lambda s: F.lower(s) == F.lower(v)))
    allowed = F.when(scope.isNull(), F.when(asked, requested)).when(~asked, scope).otherwise(both)
    reason = F.when(scope.isNotNull() & asked & (F.size(denied) > 0), F.concat(F.lit(f"requested_{name} denied outside persona scope: "), F.array_join(denied, ", ")))
    return allowed, reason


def resolve_levels(requested: Column, most: Column) -> tuple[Column, Column]:
    asked = F.coalesce(F.size(requested) > 0, F.lit(False))
    fits = lambda v: level_rank(v) <= level_rank(most)
    allowed = F.when(asked, F.array_distinct(F.filter(requested, fits))).otherwise(levels_up_to(most))
    denied = F.filter(requested, lambda v: ~fits(v))
    reason = F.when(asked & (F.size(denied) > 0), F.concat(F.lit("requested_access_levels denied above max_access_level "), most, F.lit(": "), F.array_join(denied, ", ")))
    return allowed, reason


def resolve_access(requests: DataFrame, personas: DataFrame) -> DataFrame:
    """requests (request_id, persona_id, requested_*) with allowed_* arrays, denied_reasons and error.

    A null array means unconstrained, an empty one that nothing is allowed. An unknown persona gives an
    error row without filters. Personas are joined by id.
    """
    who = personas.select(F.col("persona_id").alias("p_id"), "max_access_level", *SCOPES.values(), F.lit(True).alias("known"))
    rows = requests.join(who, F.trim("persona_id") == F.col("p_id"), "left")
    made = {n: resolve_scope(F.col(f"requested_{n}"), F.col(s), n) for n, s in SCOPES.items()}
    made["access_levels"] = resolve_levels(F.col("requested_access_levels"), F.col("max_access_level"))
    order = ["departments", "regions", "policy_types", "access_levels", "owners"]
    known = F.col("known").isNotNull()
    reasons = F.array_compact(F.array(*[made[n][1] for n in order]))
    return rows.select(
        "request_id",
        "persona_id",
        *[F.when(known, made[n][0]).alias(f"allowed_{n}") for n in order],
        F.when(known, reasons).otherwise(F.array().cast("array<string>")).alias("denied_reasons"),
        F.when(~known, F.lit("INVALID_REQUEST")).alias("error"),
    )


#: Columns of chunks that requests look at.
LOOKED_AT = {n: c for n, c in SCALARS.items() if n not in ("doc_ids", "access_levels")}
ATTRIBUTES = [*LOOKED_AT.values(), "access_level", ARRAYS["regions"]]


def passing(profiles: DataFrame, resolved: DataFrame) -> DataFrame:
    """request_id and the columns of profiles (distinct ATTRIBUTES and more) that each resolved request may see, met by access level."""
    allowed = resolved.where("error is null").select("request_id", *[c for c in resolved.columns if c.startswith("allowed_")])
    allowed = allowed.withColumn("access_level", F.explode(F.array_distinct("allowed_access_levels")))
    seen = F.col("allowed_regions").isNull() | F.arrays_overlap("allowed_regions", ARRAYS["regions"])
    for name, column in LOOKED_AT.items():
        seen &= F.col(f"allowed_{name}").isNull() | F.array_contains(f"allowed_{name}", F.col(column))
    return allowed.join(profiles, "access_level").where(seen).select("request_id", *profiles.columns)


def authorize(chunks: DataFrame, resolved: DataFrame) -> DataFrame:
    """request_id and the chunk columns that each resolved request may see; an empty array lets nothing pass.

    Requests meet the distinct combinations of attributes, of which there are far fewer than chunks, by
    access level; the chunks are then joined by their combination. Every request has a list of levels.
    """
    key = F.xxhash64(*ATTRIBUTES)
    met = passing(chunks.select(*ATTRIBUTES).distinct(), resolved)
    met = met.select("request_id", key.alias("profile"), *[F.col(c).alias(f"p_{c}") for c in ATTRIBUTES])
    same = F.col("profile") == F.col("own_profile")
    for c in ATTRIBUTES:
        same &= F.col(c).eqNullSafe(F.col(f"p_{c}"))
    return chunks.withColumn("own_profile", key).join(met, same).select("request_id", *chunks.columns)


def authorized_counts(chunks: DataFrame, resolved: DataFrame) -> DataFrame:
    """request_id, n, first, last: how many chunks each resolved request may see, and the smallest and largest id; none without any.

    Chunks are counted by their combination first, so that pairs of requests and chunks are never made.
    """
    profiles = chunks.groupBy(*ATTRIBUTES).agg(F.count("*").alias("n"), F.min("chunk_id").alias("first"), F.max("chunk_id").alias("last"))
    return passing(profiles, resolved).groupBy("request_id").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


def search_as(resolved: DataFrame, asked: DataFrame, index: bm25.Index, k: int, path: str) -> DataFrame:
    """request_id, chunk_id, raw_score, normalized_score, rank: the k best chunks that each resolved request may see for its text (asked: request_id, text).

    The allowed lists narrow the postings before they are summed: requests become classes of profiles, so
    that what a request may see is never written out. Requests with the same text and lists are searched
    once. A request with an error, or with an empty list, finds nothing.
    """
    allowed = {n: F.col(f"allowed_{n}") for n in ("departments", "regions", "policy_types", "access_levels", "owners")}
    rows = profiles.with_class(resolved.where("error is null").join(asked.select("request_id", "text"), "request_id"), profiles.allowance(**allowed))
    rows = rows.select("request_id", "text", "class", "wanted", F.sha2(F.to_json(F.struct("class", "text")), 256).alias("query_id"))
    rows.write.parquet(f"{path}/requests")
    rows = resolved.sparkSession.read.schema(rows.schema).parquet(f"{path}/requests")
    units = rows.dropDuplicates(["query_id"])
    scope = profiles.scopes(units, index.profiles, index.chunks.select("chunk_id", "doc_id", "profile"), 2 * k, f"{path}/scopes")
    found = bm25.search(units.select("query_id", "text", "class"), index, k, scope, f"{path}/bm25")
    return rows.select("request_id", "query_id").join(found, "query_id").drop("query_id")
