"""Filters by query: distinct filters meet distinct combinations of chunk attributes, once.

A profile is a distinct combination of what filters look at, but for the document; chunks and postings
carry its number. A class is a distinct filter of a table of queries. Both meet dimension by dimension over
equal values, so that classes and profiles are never paired with all others, and the result is a bitmap of
profiles for each class, in rows of 64. What a search needs beside it (how many chunks a class lets pass,
and which fill short results) is kept by class too. Lists of documents are met by the chunks of these alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from govdocs.operators.registry import rank_directory, written

#: Filter name -> column. Scalars match a listed value, arrays share one, titles contain one.
SCALARS = {"doc_ids": "doc_id", "departments": "department", "policy_types": "policy_type", "owners": "owner", "access_levels": "access_level"}
ARRAYS = {"regions": "regions", "related_processes": "related_processes"}
TITLES = "section_titles"
FILTERS = [*SCALARS, *ARRAYS, TITLES]
#: What makes a profile.
ATTRIBUTES = [*[c for n, c in SCALARS.items() if n != "doc_ids"], *ARRAYS.values(), "section_title"]
DIMENSIONS = [n for n in FILTERS if n != "doc_ids"]
#: Bitmaps up to this size are sent to all tasks; larger ones meet the rows by a shuffle.
BROADCAST_BYTES, BITMAP_ROW = 8 << 20, 160


def profiles_of(chunks: DataFrame, path: str) -> DataFrame:
    """profile (a number from 0), ATTRIBUTES and n_chunks of the distinct combinations of chunks, written to path."""
    distinct = chunks.groupBy(*ATTRIBUTES).agg(F.count("*").alias("n_chunks"))
    return rank_directory(distinct, ATTRIBUTES, path).ranked().withColumn("profile", F.col("rank") - 1).drop("rank")


def with_profile(chunks: DataFrame, profiles: DataFrame) -> DataFrame:
    """chunks with the number of their profile."""
    own = F.xxhash64(*ATTRIBUTES)  # deals rows out; equality decides
    known = profiles.select("profile", own.alias("p_key"), *[F.col(c).alias(f"p_{c}") for c in ATTRIBUTES])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in ATTRIBUTES], F.col("own_key") == F.col("p_key"))
    return chunks.withColumn("own_key", own).join(known, same).select(*chunks.columns, "profile")


def constraint(filters: Column) -> Column:
    """A filter struct with sorted distinct lists; an empty one of the input constrains nothing and becomes null."""
    return F.struct(*[F.when(F.size(filters[n]) > 0, F.array_sort(F.array_distinct(filters[n]))).alias(n) for n in FILTERS])


def allowance(**lists: Column | None) -> Column:
    """A filter struct of allowed lists: null constrains nothing, an empty list lets nothing pass."""
    none = F.lit(None).cast("array<string>")
    of = lambda c: none if c is None else F.when(c.isNotNull(), F.array_sort(F.array_distinct(c)))
    return F.struct(*[of(lists.get(n)).alias(n) for n in FILTERS])


def with_class(queries: DataFrame, constraints: Column) -> DataFrame:
    """queries with class: the digest of their constraint (constraint or allowance), which is kept as `wanted`."""
    rows = queries.withColumn("wanted", constraints)
    return rows.withColumn("class", F.sha2(F.to_json("wanted"), 256))


def dimension_pairs(classes: DataFrame, profiles: DataFrame, name: str) -> DataFrame:
    """class, profile where the class's list for one dimension lets the profile pass."""
    wanted = classes.where(F.col(f"wanted.{name}").isNotNull()).select("class", F.explode(f"wanted.{name}").alias("value"))
    if name in SCALARS:
        pairs = wanted.join(profiles.select("profile", F.col(SCALARS[name]).alias("value")), "value")
    elif name in ARRAYS:
        pairs = wanted.join(profiles.select("profile", F.explode(F.array_distinct(ARRAYS[name])).alias("value")), "value")
    else:
        # a title that holds a value holds the first three characters of it, or all of a shorter one
        low = F.lower("section_title")
        piece = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - n + 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(n)))
        pieces = [piece(n) for n in (1, 2, 3)]
        titles = profiles.where("section_title is not null").select("profile", low.alias("title"), F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *pieces))).alias("key"))
        value = F.lower("value")
        pairs = wanted.select("class", value.alias("value"), F.substring(value, 1, 3).alias("key")).join(titles, "key").where(F.col("title").contains(F.col("value")))
    return pairs.select("class", "profile").distinct()


def passing(classes: DataFrame, profiles: DataFrame) -> DataFrame:
    """class, profile for all classes that constrain a dimension of the profile: as many dimensions pass as are constrained."""
    asked = sum(F.col(f"wanted.{n}").isNotNull().cast("int") for n in DIMENSIONS)
    met = reduce(DataFrame.unionByName, [dimension_pairs(classes, profiles, n) for n in DIMENSIONS])
    met = met.groupBy("class", "profile").agg(F.count("*").alias("n"))
    return met.join(classes.select("class", asked.alias("asked")), "class").where(F.col("n") == F.col("asked")).select("class", "profile")


@dataclass(frozen=True)
class Scopes:
    """classes: class, open (no dimension of the profile is constrained), listed (documents are), n_chunks that pass; pairs: class, profile of
    classes that are not open; bitmaps: class, word, bits, the same; of_docs: class, chunk_id of classes that list documents; fill: class, chunk_id, the smallest ids that pass."""

    classes: DataFrame
    pairs: DataFrame
    bitmaps: DataFrame
    of_docs: DataFrame
    fill: DataFrame
    any_closed: bool
    any_listed: bool

    def by_profile(self, rows: DataFrame) -> DataFrame:
        """rows (class, profile) whose profile the class lets pass."""
        if not self.any_closed:
            return rows
        bits = self.bitmaps.select(F.col("class").alias("b_class"), F.col("word").alias("b_word"), "bits")
        named = self.classes.select(F.col("class").alias("o_class"), "open")
        small = self.bitmaps.count() * BITMAP_ROW <= BROADCAST_BYTES
        bits, named = (F.broadcast(bits), F.broadcast(named)) if small else (bits, named)
        met = rows.join(named, F.col("class") == F.col("o_class"))
        met = met.join(bits, (F.col("class") == F.col("b_class")) & (F.shiftright("profile", 6) == F.col("b_word")), "left")
        passes = F.col("open") | F.coalesce(F.getbit("bits", F.col("profile") % 64) == 1, F.lit(False))
        return met.where(passes).select(*rows.columns)

    def by_document(self, rows: DataFrame) -> DataFrame:
        """rows (class, chunk_id) whose document the class lists, or that list none."""
        if not self.any_listed:
            return rows
        listed = self.classes.where("listed").select("class")
        return rows.join(listed, "class", "left_anti").unionByName(rows.join(listed, "class", "left_semi").join(self.of_docs, ["class", "chunk_id"], "left_semi"))

    def within(self, rows: DataFrame, places: DataFrame) -> DataFrame:
        """rows (class, chunk_id) that pass; places: chunk_id, profile."""
        placed = rows.join(places.select("chunk_id", "profile"), "chunk_id")
        return self.by_document(self.by_profile(placed)).select(*rows.columns)


def scopes(queries: DataFrame, profiles: DataFrame, places: DataFrame, fill: int, path: str) -> Scopes:
    """What the classes of queries (class, wanted) let pass. places: chunk_id, doc_id, profile of each chunk; fill: how many ids
    a class keeps for short results. The tables are written below path, as searches read them several times."""
    put = written(path)
    closed = reduce(Column.__or__, [F.col(f"wanted.{n}").isNotNull() for n in DIMENSIONS])
    classes = put(queries.select("class", "wanted").dropDuplicates(["class"]).select("class", "wanted", (~closed).alias("open"), F.col("wanted.doc_ids").isNotNull().alias("listed")), "wanted")
    kinds = classes.agg(F.coalesce(F.bool_or(~F.col("open")), F.lit(False)), F.coalesce(F.bool_or("listed"), F.lit(False))).first()
    pairs = put(passing(classes.where("not open"), profiles), "pairs")
    bitmaps = put(pairs.groupBy("class", F.shiftright("profile", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(profile % 64 as int))")).alias("bits")), "bitmaps")
    asked = classes.where("listed").select("class", "open", F.explode("wanted.doc_ids").alias("doc_id")).join(places, "doc_id")
    of_docs = asked.where("open").select("class", "chunk_id").unionByName(asked.where("not open").join(pairs, ["class", "profile"], "left_semi").select("class", "chunk_id"))
    of_docs = put(of_docs, "documents")
    first = lambda df, by: df.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy("chunk_id"))).where(F.col("n") <= fill).drop("n")
    least = put(first(places.select("profile", "chunk_id"), "profile"), "least")  # of each profile, so that a class reads few
    plain = classes.where("not listed").select("class", "open")
    free = plain.where("open").select("class").join(least.orderBy("chunk_id").limit(fill).select(F.collect_list("chunk_id").alias("ids")), how="cross").select("class", F.explode("ids").alias("chunk_id"))  # one class, one row
    own = plain.where("not open").join(pairs, "class").join(least, "profile").select("class", "chunk_id")
    filled = put(free.unionByName(first(own.unionByName(of_docs), "class")), "fill")
    counts = plain.where("not open").join(pairs, "class").join(profiles.select("profile", "n_chunks"), "profile").groupBy("class").agg(F.sum("n_chunks").alias("n_chunks"))
    counts = counts.unionByName(of_docs.groupBy("class").agg(F.count("*").alias("n_chunks")))
    total = plain.where("open").select("class").join(profiles.agg(F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n_chunks")), how="cross")  # one class, one row
    counted = classes.select("class", "open", "listed").join(counts.unionByName(total), "class", "left").fillna(0, ["n_chunks"])
    return Scopes(put(counted, "classes"), pairs, bitmaps, of_docs, filled, kinds[0], kinds[1])
