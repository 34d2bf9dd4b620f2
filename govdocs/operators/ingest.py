"""From raw files to document, section and chunk tables, and their upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from govdocs.functions import text as X
from govdocs.functions.helpers import parsed_front_matter, parsed_sections, text_batches
from govdocs.settings import ACCESS_LEVELS, POLICY_TYPES, Settings

METADATA = ["doc_id", "title", "department", "regions", "policy_type", "effective_date", "version", "access_level", "owner", "source_file", "related_processes", "created_at", "updated_at", "content_sha256"]


def split_front_matter(files: DataFrame) -> DataFrame:
    """files (path, content) with yaml, body and error: the block between the first line --- and the next; the body must not be blank."""
    close = F.locate("\n---\n", F.col("content"), 5)
    has = F.col("content").startswith("---\n") & (close > 0)
    out = files.withColumns({"yaml": F.when(has, F.expr("substring(content, 5, locate('\n---\n', content, 5) - 5)")), "body": F.when(has, F.expr("substring(content, locate('\n---\n', content, 5) + 5)"))})
    blank = F.coalesce(X.strip(F.col("body")) == "", F.lit(True))
    return out.withColumn("error", F.when(~F.coalesce(has, F.lit(False)), F.lit("missing_front_matter")).when(blank, F.lit("empty_body")))


def parse_metadata(split: DataFrame) -> DataFrame:
    """METADATA columns, body and errors of split files; the source path and the body's hash are computed, never read."""
    rows = split.withColumn("m", parsed_front_matter(F.col("yaml")))
    plain = ["title", "department", "policy_type", "version", "access_level", "owner"]
    return rows.select(
        "path",
        "body",
        X.strip(F.col("m.doc_id")).alias("doc_id"),
        *[X.strip(F.col(f"m.{c}")).alias(c) for c in plain],
        X.normalize_list(F.col("m.regions")).alias("regions"),
        F.coalesce(X.normalize_list(F.col("m.related_processes")), F.array().cast("array<string>")).alias("related_processes"),
        F.col("m.effective_date").try_cast("date").alias("effective_date"),
        F.col("m.created_at").try_cast("timestamp").alias("created_at"),
        F.col("m.updated_at").try_cast("timestamp").alias("updated_at"),
        F.col("path").alias("source_file"),
        X.sha256(F.col("body")).alias("content_sha256"),
        F.array_compact(F.array(F.coalesce(F.col("error"), F.col("m.error")))).alias("errors"),
    )


def metadata_errors() -> Column:
    """The rules that a metadata row breaks, as an array of names."""
    c = F.col
    text = lambda name, most: F.when(c(name).isNull() | (c(name) == "") | (F.length(name) > most), F.lit(name))
    safe = ~c("source_file").rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)|\\")
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(c("doc_id").rlike("^[a-z0-9][a-z0-9:_-]{1,149}$") & F.length("doc_id").between(3, 100), F.lit(False)), F.lit("doc_id")),
            text("title", 200),
            text("department", 100),
            F.when(~F.coalesce(F.size("regions").between(1, 10), F.lit(False)), F.lit("regions")),
            F.when(~F.coalesce(c("policy_type").isin(POLICY_TYPES), F.lit(False)), F.lit("policy_type")),
            F.when(c("effective_date").isNull(), F.lit("effective_date")),
            text("version", 40),
            F.when(~F.coalesce(c("access_level").isin(ACCESS_LEVELS), F.lit(False)), F.lit("access_level")),
            text("owner", 100),
            F.when(~F.coalesce(F.length("source_file").between(1, 500) & safe, F.lit(False)), F.lit("source_file")),
            F.when(F.size("related_processes") > 20, F.lit("related_processes")),
            F.when(c("created_at").isNull(), F.lit("created_at")),
            F.when(c("updated_at").isNull(), F.lit("updated_at")),
            F.when(c("updated_at") < c("created_at"), F.lit("dates_reversed")),
        )
    )


def validate_metadata(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejects): rows that keep all rules; the others with error_code INVALID_METADATA and the rules they break."""
    earlier = F.col("errors") if "errors" in rows.columns else F.array().cast("array<string>")
    checked = rows.withColumn("errors", F.concat(earlier, metadata_errors()))
    good = checked.where(F.size("errors") == 0).drop("errors")
    return good, checked.where(F.size("errors") > 0).withColumn("error_code", F.lit("INVALID_METADATA"))


def sections_and_chunks(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs (doc_id, content) with an exploded section: the columns of SECTION, its text, and ids. One pass, no shuffle."""
    text_batches(docs)
    rows = docs.withColumn("s", F.explode(parsed_sections(F.col("content"), settings)))
    path = F.when(F.col("s.whole"), X.short_hash(F.lit("Document Body"))).otherwise(X.short_hash(F.array_join("s.section_path", " > ")))
    occurrence = F.lpad(F.col("s.heading_occurrence").cast("string"), 2, "0")
    tail = F.when(F.col("s.whole"), X.short_hash(F.lit("document-body"))).otherwise(path)
    return rows.select(
        *docs.columns,
        F.col("s.title").alias("section_title"),
        "s.heading_level",
        "s.heading_occurrence",
        "s.section_path",
        path.alias("section_path_hash"),
        F.concat_ws(":", F.lit("sec"), "doc_id", X.slugify(F.col("s.title")), occurrence, tail).alias("section_id"),
        F.concat_ws(":", F.lit("chk"), "doc_id", X.slugify(F.col("s.title")), occurrence, path).alias("chunk_prefix"),
        F.col("s.start_char").alias("section_start"),
        F.col("s.end_char").alias("section_end"),
        F.col("s.spans").alias("spans"),
    )


def sections(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The section table."""
    rows = sections_and_chunks(docs.select("doc_id", "content"), settings)
    text = F.expr("substring(content, section_start + 1, section_end - section_start)")
    return rows.select("section_id", "doc_id", F.col("section_title").alias("title"), "heading_level", "heading_occurrence", "section_path", "section_path_hash", text.alias("text"), F.col("section_start").alias("start_char"), F.col("section_end").alias("end_char"))


def chunks(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The chunk table: every column of docs but content, and the chunk's own. chunk_index counts over the document."""
    parsed = parsed_sections(F.col("content"), settings)
    at = docs.withColumn("s", parsed)
    at = at.select(*docs.columns, F.posexplode("s").alias("k", "z"))
    path = X.short_hash(F.array_join("z.section_path", " > "))
    prefix = F.concat_ws(":", F.lit("chk"), "doc_id", X.slugify(F.col("z.title")), F.lpad(F.col("z.heading_occurrence").cast("string"), 2, "0"), path)
    at = at.select(*docs.columns, F.col("z.title").alias("z_title"), "z.section_path", "z.heading_occurrence", path.alias("section_path_hash"), prefix.alias("prefix"), "z.before", F.posexplode("z.spans").alias("local", "span"))
    text = F.expr("substring(content, span.start + 1, span.stop - span.start)")
    out = at.withColumn("chunk_text", text)
    own = [c for c in docs.columns if c not in ("content", "doc_id")]
    return out.select(
        F.concat(F.col("prefix"), F.lit(":"), F.lpad((F.col("local") + 1).cast("string"), 3, "0")).alias("chunk_id"),
        "doc_id",
        *own,
        F.col("z_title").alias("section_title"),
        "section_path",
        "section_path_hash",
        "heading_occurrence",
        *([F.get("related_processes", F.lit(0)).alias("related_process")] if "related_processes" in own else []),
        (F.col("before") + F.col("local") + 1).alias("chunk_index"),
        F.col("chunk_text").alias("text"),
        F.col("span.tokens").alias("token_count"),
        F.col("span.start").alias("start_char"),
        F.col("span.stop").alias("end_char"),
        X.sha256(F.col("chunk_text")).alias("text_sha256"),
    )


def classify_ingest(parsed: DataFrame, registry: DataFrame) -> DataFrame:
    """parsed (doc_id, content_sha256, path) with status and error_code against registry (doc_id, content_sha256).

    Files act in path order: the first of an unknown doc_id is ingested and the later ones are compared
    with it; the same hash is skipped, another fails. Only keys and hashes are shuffled.
    """
    known = registry.select("doc_id", F.col("content_sha256").alias("known_sha"))
    rows = parsed.join(known, "doc_id", "left")
    order = Window.partitionBy("doc_id").orderBy("path")
    first = F.first("content_sha256").over(order)
    is_first = (F.row_number().over(order) == 1) & F.col("known_sha").isNull()
    same = F.col("content_sha256") == F.coalesce(F.col("known_sha"), first)
    status = F.when(is_first, "ingested").when(same, "skipped").otherwise("failed")
    return rows.withColumn("status", status).withColumn("error_code", F.when(F.col("status") == "failed", F.lit("DUPLICATE_DOCUMENT"))).drop("known_sha")


def upsert_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with the rows of new by doc_id; ingested_at stays where the hash did not change.

    Of rows of new that repeat a doc_id the one ingested last counts, then that with the greatest hash.
    """
    latest = Window.partitionBy("doc_id").orderBy(F.desc("ingested_at"), F.desc("content_sha256"))
    new = new.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n")
    before = old.select("doc_id", F.col("content_sha256").alias("old_sha"), F.col("ingested_at").alias("old_at"))
    merged = new.join(before, "doc_id", "left")
    at = F.when(F.col("old_sha") == F.col("content_sha256"), F.col("old_at")).otherwise(F.col("ingested_at"))
    merged = merged.withColumn("ingested_at", at).select(*old.columns)
    return old.join(new.select("doc_id"), "doc_id", "left_anti").select(*old.columns).unionByName(merged)


def replace_parts(old: DataFrame, new: DataFrame, docs: DataFrame) -> DataFrame:
    """Sections or chunks: those of docs' doc_ids come from new, all others stay."""
    ids = docs.select("doc_id").distinct()
    return old.join(ids, "doc_id", "left_anti").select(*old.columns).unionByName(new.join(ids, "doc_id", "left_semi").select(*old.columns))


def ingest_summary(results: DataFrame) -> DataFrame:
    """One row: totals by status, and failures by error code as a map."""
    codes = results.where("error_code is not null").groupBy("error_code").agg(F.count("*").alias("n"))
    codes = codes.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("error_code", "n")))).alias("by_error_code"))
    totals = results.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("ingested", "skipped", "failed")])
    return totals.join(codes, how="cross")  # one row by one row
