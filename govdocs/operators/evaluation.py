"""Labelled cases against outcomes: checks, metrics and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EQUAL = ["intent", "route", "status", "answer_generation_status", "refusal_reason", "answer_refusal_reason"]
REFUSED = ["refused", "insufficient_evidence"]
SPLITS = ["core", "holdout"]
LISTS = ["retrieval_doc_ids", "chunk_ids", "citation_doc_ids", "graph_relations", "answer_contains"]


def n_of(c: str) -> Column:
    return F.coalesce(F.size(c), F.lit(0))


def within(part: str, whole: str) -> Column:
    """Every item of part is in whole; true for an empty part."""
    return F.size(F.array_except(F.coalesce(part, F.array().cast("array<string>")), F.coalesce(whole, F.array().cast("array<string>")))) == 0


def evaluate_cases(cases: DataFrame, outcomes: DataFrame) -> DataFrame:
    """cases (case_id, split, expected_*, forbidden_answer_contains) joined to outcomes (case_id, EQUAL, doc_ids, chunk_ids, citation_ids, answer_citation_ids, answer_citation_doc_ids, graph_relations, answer, grounding_summary) with each check, failed_checks in order, and passed."""
    rows = cases.join(outcomes, "case_id")
    c = F.col
    generated, refusal = c("expected_answer_generation_status") == "generated", c("expected_answer_generation_status").isin(REFUSED)
    found = F.size(F.array_intersect("expected_retrieval_doc_ids", "doc_ids"))
    hit = F.when(n_of("expected_retrieval_doc_ids") > 0, found > 0)
    rows = rows.withColumns(
        {
            "retrieval_hit_at_k": hit,
            "retrieval_recall_at_k": F.when(n_of("expected_retrieval_doc_ids") > 0, found / F.size(F.array_distinct("expected_retrieval_doc_ids"))),
            "citation_subset_valid": F.when(generated, (n_of("answer_citation_ids") > 0) & within("answer_citation_ids", "citation_ids")),
            "expected_citation_match": F.when(generated, within("expected_citation_doc_ids", "answer_citation_doc_ids")),
            "fabricated_answer": refusal & c("answer").isNotNull(),
            "refusal_correct": F.when(
                refusal,
                c("answer").isNull()
                & c("answer_generation_status").eqNullSafe(c("expected_answer_generation_status"))
                & c("answer_refusal_reason").eqNullSafe(c("expected_answer_refusal_reason"))
                & c("refusal_reason").eqNullSafe(c("expected_refusal_reason")),
            ),
        }
    )
    say = lambda test, name: F.array_compact(F.array(F.when(F.coalesce(test, F.lit(False)), F.lit(name))))
    has_answer = F.coalesce(c("answer") != "", F.lit(False))
    holds = lambda p: F.lower("answer").contains(F.lower(p))
    phrases = lambda col, wrong, name: F.when(generated & has_answer, F.transform(F.filter(F.coalesce(col, F.array().cast("array<string>")), wrong), lambda p: F.concat(F.lit(f"{name}:"), p))).otherwise(F.array().cast("array<string>"))
    required = phrases("expected_answer_contains", lambda p: ~holds(p), "required_answer_phrase_missing")
    forbidden = phrases("forbidden_answer_contains", holds, "forbidden_answer_phrase_present")
    grounding = [
        say(generated & ~c("citation_subset_valid"), "answer_citations_not_valid_subset"),
        say(generated & ~c("expected_citation_match"), "expected_answer_citation_document_missing"),
        say(generated & ~has_answer, "generated_answer_missing"),
        required,
        forbidden,
        say(generated & ~c("status").eqNullSafe(F.lit("evidence_ready")), "answer_generated_without_evidence_ready"),
        say(generated & (F.coalesce("grounding_summary", F.lit("")) == ""), "grounding_summary_missing"),
    ]
    failed = F.concat(
        *[say(~c(f"expected_{n}").eqNullSafe(c(n)), f"{n}_mismatch") for n in EQUAL],
        say(~c("retrieval_hit_at_k"), "retrieval_expected_document_missing"),
        say((n_of("expected_chunk_ids") > 0) & ~within("expected_chunk_ids", "chunk_ids"), "expected_chunk_missing"),
        say((n_of("expected_graph_relations") > 0) & ~within("expected_graph_relations", "graph_relations"), "expected_graph_relation_missing"),
        *grounding,
        say(~generated & c("answer").isNotNull(), "unexpected_answer_generated"),
        say(~generated & (n_of("answer_citation_ids") > 0), "unexpected_answer_citations"),
        say(~c("refusal_correct"), "refusal_behavior_incorrect"),
    )
    rows = rows.withColumns({"failed_checks": failed, "grounding_pass": F.when(generated, F.size(F.concat(*grounding)) == 0)})
    return rows.withColumn("passed", F.size("failed_checks") == 0)


def rate(top: Column, bottom: Column) -> Column:
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def aggregate_metrics(results: DataFrame) -> DataFrame:
    """One row of 15 rates over evaluated cases; a rate without cases is null."""
    c = F.col
    count = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    total = lambda col: F.coalesce(F.sum(col), F.lit(0))
    shared = lambda a, b: F.coalesce(F.size(F.array_intersect(a, b)), F.lit(0))
    generated, refusal = c("expected_answer_generation_status") == "generated", c("expected_answer_generation_status").isin(REFUSED)
    correct = lambda test: rate(count(refusal & test & c("refusal_correct")), count(refusal & test))
    among = lambda value: F.when(generated, value).otherwise(F.lit(0))
    return results.agg(
        F.count("*").alias("total"),
        rate(count(c("passed")), F.count("*")).alias("pass_rate"),
        rate(count(c("expected_intent").eqNullSafe(c("intent"))), F.count("*")).alias("intent_accuracy"),
        rate(count(c("expected_route").eqNullSafe(c("route"))), F.count("*")).alias("route_accuracy"),
        rate(count(c("retrieval_hit_at_k")), F.count("retrieval_hit_at_k")).alias("retrieval_hit_at_k"),
        F.avg("retrieval_recall_at_k").alias("retrieval_recall_at_k"),
        rate(total(shared("expected_chunk_ids", "chunk_ids")), total(n_of("expected_chunk_ids"))).alias("expected_chunk_presence_rate"),
        rate(count(generated & (n_of("answer_citation_ids") > 0)), count(generated)).alias("answer_citation_non_empty_rate"),
        rate(total(among(shared("answer_citation_ids", "citation_ids"))), total(among(n_of("answer_citation_ids")))).alias("citation_validity_rate"),
        rate(total(shared("expected_citation_doc_ids", "answer_citation_doc_ids")), total(n_of("expected_citation_doc_ids"))).alias("expected_citation_match_rate"),
        rate(count(generated & c("grounding_pass")), count(generated)).alias("grounded_answer_pass_rate"),
        correct(F.lit(True)).alias("refusal_accuracy"),
        correct(c("expected_intent") == "out_of_scope").alias("out_of_scope_refusal_accuracy"),
        correct(c("expected_intent") == "unsupported").alias("unsupported_refusal_accuracy"),
        correct(c("expected_answer_generation_status") == "insufficient_evidence").alias("insufficient_evidence_refusal_accuracy"),
        rate(count(refusal & c("fabricated_answer")), count(refusal)).alias("fabricated_answer_rate"),
    )


def split_metrics(results: DataFrame, splits: list[str] = SPLITS) -> DataFrame:
    """split, total, passed, failed, pass_rate; known splits without cases too."""
    known = results.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    sums = results.groupBy("split").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"))
    rows = known.join(sums, "split", "left").fillna(0, ["total", "passed"])
    return rows.select("split", "total", "passed", (F.col("total") - F.col("passed")).alias("failed"), rate(F.col("passed"), F.col("total")).alias("pass_rate"))


def intent_metrics(results: DataFrame) -> DataFrame:
    """expected_intent, total, passed, pass_rate, intent_accuracy."""
    sums = results.groupBy("expected_intent").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(F.col("expected_intent") == F.col("intent")).alias("right"))
    return sums.select("expected_intent", "total", "passed", rate(F.col("passed"), F.col("total")).alias("pass_rate"), rate(F.col("right"), F.col("total")).alias("intent_accuracy"))


def confusion(results: DataFrame) -> DataFrame:
    """expected_intent, intent, n."""
    return results.groupBy("expected_intent", "intent").agg(F.count("*").alias("n"))


def validate_cases(cases: DataFrame) -> DataFrame:
    """case_id, errors of cases that break a rule: unique ids, no answer phrases without an answer, and what a generated answer needs."""
    same = F.count("*").over(Window.partitionBy("case_id"))
    generated = F.col("expected_answer_generation_status") == "generated"
    has = lambda c: n_of(c) > 0
    errors = F.array_compact(
        F.array(
            F.when(F.col("n_same") > 1, F.lit("case_id_not_unique")),
            F.when((F.col("expected_status") == "refused") & has("expected_answer_contains"), F.lit("refusal_with_answer_phrases")),
            F.when(~generated & has("expected_answer_contains"), F.lit("not_generated_with_answer_phrases")),
            F.when(generated & ~F.coalesce("generate_answer", F.lit(False)), F.lit("generated_without_flag")),
            F.when(generated & ~has("expected_answer_contains"), F.lit("generated_without_phrases")),
            F.when(generated & ~has("expected_citation_doc_ids"), F.lit("generated_without_citation_documents")),
        )
    )
    return cases.withColumn("n_same", same).select("case_id", errors.alias("errors")).where(F.size("errors") > 0)


def evaluation_report(results: DataFrame, run_id: str, timestamp: Column) -> DataFrame:
    """One row: run, metrics, failures and totals by split."""
    part = [F.count_if((F.col("split") == s) & keep).alias(f"{s}_{name}") for s in SPLITS for name, keep in (("total", F.lit(True)), ("passed", F.col("passed")))]
    failures = results.agg(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.struct("case_id", "failed_checks")))).alias("failures"), *part)
    return aggregate_metrics(results).join(failures, how="cross").select(F.lit(run_id).alias("run_id"), timestamp.alias("timestamp"), "*")  # one row each


def latest_summary(runs: DataFrame) -> DataFrame:
    """The latest run's row."""
    return runs.agg(F.max_by(F.struct(*runs.columns), F.struct("timestamp", "run_id")).alias("r")).where("r is not null").select("r.*")
