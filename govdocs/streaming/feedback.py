"""Feedback logs as a stream: each batch of appended lines goes through the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from govdocs.operators.feedback import feedback_audit
from govdocs.sources.files import redact, split_records


def follow_feedback(spark: SparkSession, log_dir: str, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Reads lines that are appended to log_dir; writes valid records, quarantined lines and audit events below out.

    A batch is written under its number, so that one that is tried again replaces what it wrote before.
    """
    lines = spark.readStream.text(log_dir).withColumn("line_number", F.lit(None).cast("long"))

    def each(batch: DataFrame, number: int) -> None:
        valid, corrupt = split_records(batch)
        valid.drop("position", "line_number").write.mode("overwrite").parquet(f"{out}/feedback/batch={number}")
        corrupt.drop("line_number").write.mode("overwrite").parquet(f"{out}/quarantine/batch={number}")
        events = feedback_audit(valid)
        events.withColumn("metadata", redact("metadata")).write.mode("overwrite").json(f"{out}/audit/batch={number}")

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
