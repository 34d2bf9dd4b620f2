"""Listings, pages, distributions and counts over the document and chunk tables."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govdocs.functions.text import list_match, text_match
from govdocs.settings import CODEC, ROW_GROUP


def written(path: str | None) -> Callable[[DataFrame, str], DataFrame]:
    """put(df, name): df as written below path and read back, so that several steps read it; without a path, df itself."""

    def put(df: DataFrame, name: str) -> DataFrame:
        if path is None:
            return df
        df.write.option("parquet.block.size", ROW_GROUP).option("compression", CODEC).parquet(f"{path}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")

    return put


#: Tables up to this size are sent to all tasks.
SENT_BYTES = 8 << 20


def sent(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, best stored, for a join: sent to all tasks if its rows of so many bytes are few, so that a large table is not dealt out for it."""
    return F.broadcast(df) if df.count() * row_bytes <= SENT_BYTES else df


def matching(docs: DataFrame, department=None, region=None, policy_type=None, access_level=None, owner=None) -> DataFrame:
    """Documents that match."""
    return docs.where(text_match(F.col("department"), department) & list_match(F.col("regions"), region) & text_match(F.col("policy_type"), policy_type) & text_match(F.col("access_level"), access_level) & text_match(F.col("owner"), owner))


def list_documents(docs: DataFrame, sections: DataFrame, chunks: DataFrame, **wanted) -> DataFrame:
    """Documents that match (as `matching` takes it), with section_count and chunk_count, by doc_id. sections and chunks may be those of the matching documents alone."""
    kept = matching(docs, **wanted)
    for name, table in (("section_count", sections), ("chunk_count", chunks)):
        kept = kept.join(table.groupBy("doc_id").agg(F.count("*").alias(name)), "doc_id", "left").fillna(0, [name])
    return kept.orderBy("doc_id")


def list_chunks(chunks: DataFrame, doc_id=None, section_title=None, department=None, region=None, policy_type=None, access_level=None, owner=None) -> DataFrame:
    """Chunks that match, by chunk_id; doc_id is exact, section_title is contained."""
    exact = F.lit(True) if doc_id is None else F.col("doc_id") == doc_id
    kept = exact & text_match(F.col("section_title"), section_title, contains=True) & text_match(F.col("department"), department) & list_match(F.col("regions"), region)
    return chunks.where(kept & text_match(F.col("policy_type"), policy_type) & text_match(F.col("access_level"), access_level) & text_match(F.col("owner"), owner)).orderBy("chunk_id")


def page(df: DataFrame, order: list[Column | str], offset: int = 0, limit: int = 100, max_limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """(total, rows): the row count as a one-row frame, and the rows after offset in a total order; limit is held to 1..max_limit."""
    rows = df.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), max_limit))
    return df.agg(F.count("*").alias("total")), rows


@dataclass(frozen=True)
class RankDirectory:
    """A table in a total order, as sorted range partitions, and how many rows stand before each of them."""

    rows: DataFrame
    names: list[str]
    parts: list[int]
    before: list[int]
    total: int

    def placed(self, rows: DataFrame, parts: list[int]) -> DataFrame:
        """rows of these partitions with rank (from 1)."""
        known = dict(zip(self.parts, self.before))
        starts = rows.sparkSession.createDataFrame([(p, known[p]) for p in parts], "s_part int, s_before long")  # a row for each range partition
        rank = (F.col("s_before") + F.col("rank_place") + 1).alias("rank")
        return rows.join(F.broadcast(starts), F.col("rank_part") == F.col("s_part")).select(*self.names, rank)

    def ranked(self) -> DataFrame:
        """All rows with their rank."""
        return self.placed(self.rows, self.parts)

    def page(self, offset: int = 0, limit: int = 100, max_limit: int = 200) -> DataFrame:
        """The rows after offset, in order; limit is held to 1..max_limit. Only the partitions that hold them are opened, and only those rows are sorted."""
        first = max(0, offset)
        last = min(first + min(max(1, limit), max_limit), self.total)
        lo, hi = bisect_right(self.before, first) - 1, bisect_right(self.before, last - 1)
        parts = self.parts[max(lo, 0) : hi] if first < last else []
        rows = self.placed(self.rows.where(F.col("rank_part").isin(parts) if parts else F.lit(False)), parts)
        return rows.where((F.col("rank") > first) & (F.col("rank") <= last)).orderBy("rank").drop("rank")


def rank_directory(df: DataFrame, order: list[Column | str], path: str) -> RankDirectory:
    """Writes df to path in range partitions of `order`, a total order of its rows, with the place of each row in its partition.

    Rows are dealt by sampled bounds and sorted where they arrive, so that no task sees more than its range;
    pages and ranks afterwards need no sort of the table. Only a count for each partition is collected.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sorted_rows.withColumns({"rank_place": place, "rank_part": F.spark_partition_id()}).write.partitionBy("rank_part").parquet(path)
    schema = T.StructType([*df.schema.fields, T.StructField("rank_place", T.LongType()), T.StructField("rank_part", T.IntegerType())])
    rows = df.sparkSession.read.schema(schema).parquet(path)
    counts = sorted((r.rank_part, r.n) for r in rows.groupBy("rank_part").agg(F.count("*").alias("n")).collect())
    ends = list(accumulate((n for _, n in counts), initial=0))
    return RankDirectory(rows, df.columns, [p for p, _ in counts], ends[:-1], ends[-1])


def distributions(docs: DataFrame) -> DataFrame:
    """dimension, value, n for department, region, policy_type, owner and access_level, in one aggregation."""
    plain = [F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in ("department", "policy_type", "owner", "access_level")]
    regions = F.transform("regions", lambda r: F.struct(F.lit("region").alias("dimension"), r.alias("value")))
    return docs.select(F.inline(F.concat(F.array(*plain), regions))).groupBy("dimension", "value").agg(F.count("*").alias("n"))


def facets(docs: DataFrame) -> DataFrame:
    """dimension, values: the distinct values of each dimension, sorted."""
    return distributions(docs).groupBy("dimension").agg(F.array_sort(F.collect_list("value")).alias("values"))


def workspace_counts(**tables: DataFrame) -> DataFrame:
    """name, n of each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out
