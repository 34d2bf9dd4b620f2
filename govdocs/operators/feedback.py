"""Feedback tables: filters, summary, triage updates, review queue, audit events and the readiness roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from govdocs.operators.registry import page

#: Updates that a task deals with, however many there are; so many tasks share those of one record when its last values are taken.
TASK_ROWS, SHARES = 250_000, 64
UNRESOLVED = ["open", "triaged"]
FIELDS = ["review_status", "reviewer_note", "linked_eval_case_id"]


def list_feedback(df: DataFrame, review_status=None, feedback_type=None, issue_category=None, user_rating=None, offset: int = 0, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """(total, page) of the records that match, in the order of their position."""
    kept = df
    for column, value in (("review_status", review_status), ("feedback_type", feedback_type), ("issue_category", issue_category), ("user_rating", user_rating)):
        if value is not None:
            kept = kept.where(F.col(column) == value)
    return page(kept, ["position"], offset, limit, max_limit=500)


def feedback_counts(df: DataFrame) -> DataFrame:
    """dimension, value, n for issue, status and type in one aggregation."""
    kinds = [F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in ("issue_category", "review_status", "feedback_type")]
    return df.select(F.inline(F.array(*kinds))).groupBy("dimension", "value").agg(F.count("*").alias("n"))


def feedback_totals(df: DataFrame) -> DataFrame:
    """One row: total, negative and unresolved."""
    return df.agg(F.count("*").alias("total_count"), F.count_if(F.col("user_rating") == "negative").alias("negative_count"), F.count_if(F.col("review_status").isin(UNRESOLVED)).alias("unresolved_count"))


def top_issues(df: DataFrame, k: int = 5) -> DataFrame:
    """issue_category, n, rank: the most frequent issues; of equal ones the first seen."""
    sums = df.groupBy("issue_category").agg(F.count("*").alias("n"), F.min("position").alias("first"))
    order = Window.orderBy(F.desc("n"), "first")
    return sums.orderBy(F.desc("n"), "first").limit(k).withColumn("rank", F.row_number().over(order)).drop("first")


def update_trail(feedback: DataFrame, updates: DataFrame, order: str | None = None, path: str | None = None) -> DataFrame:
    """feedback_id, at, set_fields, FIELDS as before_* and after_*, changed_fields (in the order set) for each update of a known record.

    updates: feedback_id, set_fields and FIELDS; a field not in set_fields stays, a null in it is set.
    Updates of one id act one after another by the column `order` (by their values where none is given);
    each meets the state that those before it left. With a path, updates are dealt out in ranges of id and
    order and written there, so that a record with very many of them is not one task: what the ranges
    before it set last comes to each range as one row of a record.
    """
    at = F.struct(*([order] if order else []), "set_fields", *FIELDS)
    first = feedback.select("feedback_id", *[F.col(f).alias(f"first_{f}") for f in FIELDS])
    steps = updates.select("feedback_id", at.alias("at"))
    key = ["feedback_id"]
    if path is not None:
        n = tasks_for(updates)
        steps.repartitionByRange(n, "feedback_id", "at").withColumn("part", F.spark_partition_id()).write.parquet(path)
        steps = feedback.sparkSession.read.schema(steps.withColumn("part", F.lit(0)).schema).parquet(path)
        key = ["part", "feedback_id"]
        steps = steps.repartition(n, *key)
    put = {f: F.when(F.array_contains("at.set_fields", f), F.struct(F.col(f"at.{f}").alias("v"))) for f in FIELDS}
    before = Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    last = {f"last_{f}": F.last(put[f], ignorenulls=True).over(before) for f in FIELDS}
    rows = steps.withColumns(last)
    if path is not None:
        # records meet the ranges that they have updates in, a row of each, and not the updates, of which one record may have most
        ends = steps.groupBy(*key).agg(*[F.max_by(put[f], F.when(put[f].isNotNull(), F.col("at"))).alias(f"end_{f}") for f in FIELDS])
        earlier = Window.partitionBy("feedback_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.repartition(n, "feedback_id").withColumns({f"in_{f}": F.last(f"end_{f}", ignorenulls=True).over(earlier) for f in FIELDS})
        ends = ends.join(first.repartition(n, "feedback_id"), "feedback_id").drop(*[f"end_{f}" for f in FIELDS])
        rows = rows.join(ends.repartition(n, *key), key)
        rows = rows.withColumns({f"last_{f}": F.coalesce(f"last_{f}", f"in_{f}") for f in FIELDS})
    else:
        rows = rows.join(first, "feedback_id")
    was = {f: F.when(F.col(f"last_{f}").isNotNull(), F.col(f"last_{f}.v")).otherwise(F.col(f"first_{f}")) for f in FIELDS}
    now = {f: F.when(put[f].isNotNull(), F.col(f"at.{f}")).otherwise(was[f]) for f in FIELDS}
    differs = F.create_map(*[x for f in FIELDS for x in (F.lit(f), ~now[f].eqNullSafe(was[f]))])
    changed = F.filter(F.array_distinct("at.set_fields"), lambda f: F.coalesce(F.element_at(differs, f), F.lit(False)))
    named = [was[f].alias(f"before_{f}") for f in FIELDS] + [now[f].alias(f"after_{f}") for f in FIELDS]
    return rows.select("feedback_id", "at", F.col("at.set_fields").alias("set_fields"), *named, changed.alias("changed_fields"))


def tasks_for(rows: DataFrame) -> int:
    """Tasks of TASK_ROWS at most, and as many as shuffles have at least."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))


def last_values(updates: DataFrame, order: str | None) -> DataFrame:
    """feedback_id and for each field new_: what its last update sets, as a struct (v), null without one.

    Rows are dealt out before they are summed up, in shares of a record: a scan's part may hold millions of
    records, all of which a sum where it is read would keep.
    """
    n = tasks_for(updates)
    place = F.struct(*([order] if order else []), "set_fields", *FIELDS)
    at = {f: F.when(F.array_contains("set_fields", f), place) for f in FIELDS}
    rows = updates.select("feedback_id", F.pmod(F.xxhash64(place), F.lit(SHARES)).alias("share"), *[at[f].alias(f) for f in FIELDS])
    shares = rows.repartition(n, "feedback_id", "share").groupBy("feedback_id", "share").agg(*[F.max(f).alias(f) for f in FIELDS])
    last = shares.drop("share").repartition(n, "feedback_id").groupBy("feedback_id").agg(*[F.max(f).alias(f) for f in FIELDS])
    return last.select("feedback_id", *[F.when(F.col(f).isNotNull(), F.struct(F.col(f"{f}.{f}").alias("v"))).alias(f"new_{f}") for f in FIELDS])


def apply_updates(feedback: DataFrame, updates: DataFrame, order: str | None = None, path: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new, changes, errors) of updates as update_trail takes them.

    new: the records after all updates; changes: the rows of the trail of updates that changed something;
    errors: each update of an unknown id.
    """
    changes = update_trail(feedback, updates, order, path).where(F.size("changed_fields") > 0)
    rows = feedback.join(last_values(updates, order), "feedback_id", "left")
    out = rows.select(*[F.when(F.col(f"new_{c}").isNotNull(), F.col(f"new_{c}.v")).otherwise(F.col(c)).alias(c) if c in FIELDS else F.col(c) for c in feedback.columns])
    errors = updates.join(feedback.select("feedback_id"), "feedback_id", "left_anti").select("feedback_id", F.lit("INVALID_REQUEST").alias("error_code"))
    return out, changes, errors


def review_queue(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(total, queue): records that are open or triaged, by position."""
    queue = df.where(F.col("review_status").isin(UNRESOLVED))
    return queue.agg(F.count("*").alias("total")), queue.orderBy("position")


def feedback_audit(submitted: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """feedback_id, at, step, event_type, metadata: one event a submission (at is null); for each change of apply_updates one for its status, note and link, in that order."""
    text = lambda **names: F.create_map(*[x for n, c in names.items() for x in (F.lit(n), F.col(c).cast("string"))])
    made = submitted.select("feedback_id", F.lit(0).alias("step"), F.lit("feedback_submission").alias("event_type"), text(feedback_type="feedback_type", issue_category="issue_category", user_rating="user_rating").alias("metadata"))
    if changes is None:
        return made
    none = F.create_map().cast("map<string,string>")
    events = [("review_status", "feedback_status_updated", text(review_status="after_review_status")), ("reviewer_note", "feedback_reviewer_note_updated", none), ("linked_eval_case_id", "feedback_eval_linked", text(linked_eval_case_id="after_linked_eval_case_id"))]
    one = lambda i, field, name, meta: F.when(F.array_contains("changed_fields", field), F.struct(F.lit(i).alias("step"), F.lit(name).alias("event_type"), meta.alias("metadata")))
    steps = F.array_compact(F.array(*[one(i + 1, *e) for i, e in enumerate(events)]))
    return made.unionByName(changes.select("feedback_id", "at", F.inline(steps)), allowMissingColumns=True)


def readiness_summary(personas: DataFrame | None, graph: DataFrame | None, latest_run: DataFrame | None, feedback: DataFrame | None, corrupt: DataFrame | None = None) -> DataFrame:
    """part, status, detail: a row for personas, graph, evaluation and feedback; a missing input is unavailable, and so is feedback with a corrupt line."""
    spark = next(df for df in (personas, graph, latest_run, feedback, corrupt) if df is not None).sparkSession
    show = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    ok = lambda df, name, detail: df.agg(detail.alias("detail")).select(F.lit(name).alias("part"), F.lit("available").alias("status"), "detail")
    gone = lambda name: spark.createDataFrame([(name, "unavailable", None)], "part string, status string, detail string")
    parts = [
        gone("personas") if personas is None else ok(personas, "personas", show(F.count("*"))),
        gone("graph") if graph is None else ok(graph, "graph", F.concat_ws("/", show(F.max("n_nodes")), show(F.max("n_edges")))),
        gone("evaluation") if latest_run is None else ok(latest_run, "evaluation", show(F.max("pass_rate"))),
    ]
    if feedback is None:
        parts.append(gone("feedback"))
    else:
        row = ok(feedback, "feedback", F.concat_ws(",", *[F.concat(F.lit(f"{s}="), show(F.count_if(F.col("review_status") == s))) for s in ("open", "triaged", "resolved", "closed")]))
        if corrupt is not None:
            n = corrupt.agg(F.count("*").alias("n_bad"))
            bad = F.col("n_bad") > 0
            row = row.join(n, how="cross").select("part", F.when(bad, "unavailable").otherwise(F.col("status")).alias("status"), F.when(bad, None).otherwise(F.col("detail")).alias("detail"))
        parts.append(row)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
