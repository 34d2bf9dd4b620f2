"""Secret scan over an incremental ledger of text blobs.

Texts are addressed by their SHA-256. A ledger row says that one blob was scanned under one version of
one rule and what was found; only pairs that the ledger does not hold are scanned. Findings are then
joined back to every row that holds the blob. All of it is DataFrame and SQL functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govdocs.llm.common import Scratch, small_side, text_or_empty


@dataclass(frozen=True)
class Rule:
    """pattern is matched leftmost and without overlap; a match stays if group `group` has `least` characters or more. quick: a pattern that every match holds, to pass over other texts."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    version: int = 1
    quick: str = ""


BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 1, quick=r"(?i:(?:passw|secr|toke|api_?k)[a-z]+)[\"']?\x20*[:=]"),
    Rule("access", r"AKIA[A-Z0-9]+", 18, quick="AKIA[A-Z0-9]{14}"),
    Rule("hex", r"[0-9a-f]{16,}", 16),
)
#: What this method adds to the base kinds.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", quick="PRIVATE KEY"),
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]{36,}", quick="gh[pousr]_"),
)
RULES = BASE_RULES + MORE_RULES
SPANS = "array<struct<start:int,stop:int>>"


def spans(text: Column, rule: Rule) -> Column:
    """Spans of the rule in text, in code points, end exclusive: the pieces between the matches and the matches give the offsets."""
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    rows = F.arrays_zip(between.alias("gap"), F.transform(found, F.length).alias("size"), F.transform(held, F.length).alias("held"))
    empty = F.array().cast("array<struct<start:int,stop:int,held:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        one = F.struct(start.alias("start"), (start + x["size"]).alias("stop"), x["held"].alias("held"))
        keep = x["held"].isNotNull() & (x["held"] >= rule.least)
        return F.struct((start + F.coalesce(x["size"], F.lit(0))).alias("at"), F.when(keep, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    walked = F.aggregate(rows, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    quick = text.rlike(rule.quick or rule.pattern)
    return F.when(quick, F.transform(walked, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))).otherwise(F.array().cast(SPANS))


LEDGER = f"blob binary, kind string, version int, spans {SPANS}"


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def read_ledger(spark, path: str) -> DataFrame:
    """The ledger stored at path; empty where none was written yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty_ledger(spark)


def paths_of(docs: DataFrame) -> DataFrame:
    """doc_id and the blob that it holds."""
    return docs.select("doc_id", F.unhex(F.sha2(text_or_empty(), 256)).alias("blob"))


def scan_unseen(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(paths, new): doc_id and blob of every row; ledger rows of the blobs and rule versions that the ledger does not hold.

    Each version of a document is a row of docs, so that historical versions are blobs like others. The
    texts of rows that only repeat a blob, or whose blob was scanned under all rules, are not scanned.
    """
    scratch = scratch or Scratch(docs.sparkSession, "secrets")
    paths = scratch.put("paths", paths_of(docs))
    first = paths.groupBy("blob").agg(F.min("doc_id").alias("first_id"))
    extra = paths.join(scratch.put("first", first), "blob").where(F.col("doc_id") != F.col("first_id")).select("doc_id", "blob")
    done = None
    if ledger is not None:
        known = ledger.select("blob", "kind", "version").where(F.concat_ws(":", "kind", "version").isin([f"{r.kind}:{r.version}" for r in rules])).distinct()
        done = scratch.put("done", known.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("done")))
        extra = extra.unionByName(paths.join(done.where(F.size("done") == len(rules)), "blob").select("doc_id", "blob"))
    extra = scratch.put("extra", extra.distinct()).select(F.col("doc_id").alias("x_id"), F.col("blob").alias("x_blob"))
    extra = small_side(extra, extra.count(), 72)
    texts = docs.select("doc_id", text_or_empty().alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))
    unseen = texts.join(extra, (texts["doc_id"] == F.col("x_id")) & (texts["blob"] == F.col("x_blob")), "left_anti")
    if done is not None:
        unseen = unseen.join(done.withColumnRenamed("blob", "d_blob"), F.col("blob") == F.col("d_blob"), "left")
    todo = lambda r: F.lit(True) if done is None else F.coalesce(~F.array_contains("done", f"{r.kind}:{r.version}"), F.lit(True))
    found = F.array(*[F.when(todo(r), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans(F.col("text"), r).alias("spans"))) for r in rules])
    new = scratch.put("new", unseen.select("blob", F.array_compact(found).alias("found")))
    return paths, new.dropDuplicates(["blob"]).select("blob", F.inline("found"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(paths, ledger): doc_id and blob of every row; the ledger with what was new."""
    paths, new = scan_unseen(docs, rules, ledger, scratch)
    return paths, new if ledger is None else ledger.select("blob", "kind", "version", "spans").unionByName(new)


def update_ledger(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(paths, ledger) with the ledger stored at path: only what it does not hold is scanned, and added to it when the scan is whole.

    A scan that fails adds nothing and can be repeated. One writer at a time.
    """
    spark = docs.sparkSession
    ledger = read_ledger(spark, path)
    paths, new = scan_unseen(docs, rules, ledger)
    new.write.mode("append").parquet(path)
    return paths, read_ledger(spark, path)


def findings(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """doc_id and found (array of start, rank of the rule, stop, kind; in that order) for every row of docs.

    ledger: what was scanned before; path: where it is stored, read and added to (one of the two at most).
    Null and empty texts have no findings. Rows that repeat a doc_id or a text each get their blob's
    findings; a null doc_id keeps its row. An empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    paths, whole = update_ledger(docs, path, rules) if path else scan(docs, rules, ledger, scratch)
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    now = whole.where(F.concat_ws(":", "kind", "version").isin([f"{r.kind}:{r.version}" for r in rules]) & (F.size("spans") > 0))
    flat = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.element_at(rank, F.col("kind")).alias("rank"), s["stop"].alias("stop"), F.col("kind").alias("kind")))
    per = now.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(flat))).alias("found"))
    per = scratch.put("per", per).withColumnRenamed("blob", "p_blob")
    return paths.join(per, F.col("blob") == F.col("p_blob"), "left").select("doc_id", F.coalesce("found", F.array().cast(per.schema["found"].dataType)).alias("found"))


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: counts, base spans hashed, and all spans in one string."""
    base = [r.kind for r in BASE_RULES]
    rows = findings(docs)
    line = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    of = lambda *kinds: F.filter("found", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return rows.select("doc_id", *counts, F.sha2(line(of(*base)), 256).alias("base_sha256"), line(F.col("found")).alias("spans"))
