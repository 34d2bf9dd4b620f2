"""BM25 over chunk tables, for whole tables of queries."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from govdocs.functions.helpers import index_terms, text_batches
from govdocs.functions.text import bm25_tokens
from govdocs.operators import scans
from govdocs.operators.profiles import Scopes
from govdocs.operators.registry import written
from govdocs.settings import Settings


def indexable_text(chunks: DataFrame, out: str = "indexable") -> DataFrame:
    """chunks with the text that is indexed: titles, department, regions, owner, processes and the chunk's text, by line."""
    spaced = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), " ")
    plain = lambda c: F.coalesce(F.col(c), F.lit(""))
    return chunks.withColumn(out, F.concat_ws("\n", plain("title"), plain("section_title"), plain("department"), spaced("regions"), plain("owner"), spaced("related_processes"), plain("text")))


@dataclass(frozen=True)
class Index:
    """postings: token, chunk_id, tf, length, part (of a score, before idf); chunks: chunk_id, length; terms: token, df, idf, peak (the
    largest part); n and mean_length of the corpus; short: chunk_id, length, token of the shortest chunks. With profiles
    (profiles_of), postings, chunks and short have a profile and chunks a doc_id, so that searches can be filtered. rows: the
    terms that postings are made of by chunk (term_rows), from which chunks are scored where they are read."""

    postings: DataFrame
    chunks: DataFrame
    terms: DataFrame
    n: int
    mean_length: float
    short: DataFrame
    profiles: DataFrame | None = None
    rows: DataFrame | None = None


#: Chunks without a term of a query prove that the least score is zero; so many of the shortest are looked at, of each profile and for each class.
SHORT, LOOKED_AT = 4, 16
#: Postings of a query's rarest terms that give the first bound of its k-th score, by k.
OPENING = 20
#: Postings of a table of queries from which on bounds pay for their passes over the index; the rows are the same either way.
BOUNDED_FROM = 100_000_000
#: Queries for each distinct text of a table of scoped queries from which on texts are scored for all their queries at once.
SHARED_FROM = 2
#: Terms of texts up to this size are sent to all tasks; more meet the postings by a shuffle.
BROADCAST_BYTES, TERM_ROW = 8 << 20, 160
#: Share of that bound which the most frequent terms may make up, so that chunks are ruled out without them.
WEAK = 0.5
#: Rows of terms that are handed on at once; those of one text stay together.
TERM_ROWS = 1 << 16
#: Terms that a worker counts before it hands them on.
COUNTED_TERMS = 1 << 18


def counted_terms(texts: DataFrame) -> DataFrame:
    """token, chunk_id, tf, length of texts (chunk_id, indexable), and doc_id and profile if texts have them; the length counts all terms, n-grams too. A row without a token says that the chunk is there, and in which document.

    A text is cut into terms once and counted where it is read, so that nothing is shuffled; built-in
    functions can't count inside a row. Terms are handed on by TERM_ROWS, as a batch of texts has a
    thousand times its rows of them. `bm25_tokens` gives the same terms.
    """
    placed = "profile" in texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, tokens, counts, sizes, lengths = 0, [], [], [], []
            for at, text in enumerate(batch["indexable"], 1):
                terms = index_terms(text.as_py() or "")
                seen = Counter(terms)
                tokens += [None, *seen]
                counts += [0, *seen.values()]
                sizes.append(len(seen) + 1)
                lengths.append(len(terms))
                if len(tokens) < TERM_ROWS and at < batch.num_rows:
                    continue
                own = np.repeat(np.arange(first, at), sizes)
                later = np.ones(len(own), dtype=bool)
                later[np.cumsum(sizes) - sizes] = False
                out = {"token": pa.array(tokens, pa.string()), "chunk_id": batch["chunk_id"].take(pa.array(own)), "tf": pa.array(counts, pa.int64()), "length": pa.array(np.repeat(np.array(lengths, dtype=np.int32), sizes))}
                if placed:
                    out |= {"doc_id": batch["doc_id"].take(pa.array(own, mask=later)), "profile": batch["profile"].take(pa.array(own))}
                yield pa.RecordBatch.from_pydict(out)
                first, tokens, counts, sizes, lengths = at, [], [], [], []

    text_batches(texts)
    more = ", doc_id string, profile long" if placed else ""
    return texts.select("chunk_id", "indexable", *(["doc_id", "profile"] if placed else [])).mapInArrow(run, "token string, chunk_id string, tf long, length int" + more)


def asked_list(queries: DataFrame) -> list[str] | None:
    """The terms of queries (text), or None if they are too many to be sent to all tasks."""
    tokens = queries.select(F.explode(bm25_tokens(F.col("text"))).alias("token")).distinct()
    if tokens.count() * TERM_ROW > BROADCAST_BYTES:
        return None
    return sorted(r.token for r in tokens.collect())  # bounded above


def term_rows(texts: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """chunk_id, length, tokens, tfs, and doc_id and profile if texts have them: a row for each text (chunk_id, indexable), with those of its terms that are among `terms` (null: all).

    A table of queries needs no others: all terms of all texts are counted, but only the asked ones are
    handed on, so that what is written grows with them and not with all windows of two and three words.
    """
    own, wanted = [c for c in ("doc_id", "profile") if c in texts.columns], None if terms is None else frozenset(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, tokens, counts, ends, lengths = 0, [], [], [0], []
            for at, text in enumerate(batch["indexable"], 1):
                found = index_terms(text.as_py() or "")
                seen = Counter(found if wanted is None else filter(wanted.__contains__, found))
                tokens += seen
                counts += seen.values()
                ends.append(len(tokens))
                lengths.append(len(found))
                if len(tokens) < TERM_ROWS and at < batch.num_rows:
                    continue
                lists = {"tokens": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens, pa.string())), "tfs": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(counts, pa.int64()))}
                yield pa.RecordBatch.from_pydict({"chunk_id": batch["chunk_id"].slice(first, at - first), "length": pa.array(lengths, pa.int32()), **lists, **{c: batch[c].slice(first, at - first) for c in own}})
                first, tokens, counts, ends, lengths = at, [], [], [0], []

    text_batches(texts)
    kinds = "".join({"doc_id": ", doc_id string", "profile": ", profile long"}[c] for c in own)
    return texts.select("chunk_id", "indexable", *own).mapInArrow(run, "chunk_id string, length int, tokens array<string>, tfs array<long>" + kinds)


def counted_of(rows: DataFrame) -> DataFrame:
    """What counted_terms gives, of term_rows."""
    own = [c for c in ("doc_id", "profile") if c in rows.columns]
    none = F.array(F.struct(F.lit(None).cast("string").alias("token"), F.lit(0).cast("long").alias("tf")))
    each = F.transform(F.arrays_zip("tokens", "tfs"), lambda x: F.struct(x["tokens"].alias("token"), x["tfs"].alias("tf")))
    return rows.select(F.inline(F.concat(none, each)), "chunk_id", "length", *own).select("token", "chunk_id", "tf", "length", *own)


def postings_of(counted: DataFrame) -> DataFrame:
    return counted.where("token is not null").drop("doc_id")


def lengths_of(counted: DataFrame) -> DataFrame:
    return counted.where("token is null").drop("token", "tf")


def term_part(mean_length: float, settings: Settings) -> Column:
    """What tf occurrences in a chunk of this length add to a score, before idf."""
    k1, b, tf = settings.bm25_k1, settings.bm25_b, F.col("tf")
    long = 1 - b + b * F.greatest(F.col("length"), F.lit(1)) / mean_length
    return tf * (k1 + 1) / (tf + k1 * long)


def frequencies(texts: DataFrame) -> DataFrame:
    """token, df of texts (indexable). Terms are counted where texts are read, by up to COUNTED_TERMS of them, and no posting is handed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch["indexable"]:
                seen.update(set(index_terms(text.as_py() or "")))
                if len(seen) >= COUNTED_TERMS:
                    yield from counts_of(seen)
                    seen.clear()
        yield from counts_of(seen)

    text_batches(texts)
    return texts.select("indexable").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("df"))


def counts_of(seen: Counter) -> Iterator[pa.RecordBatch]:
    tokens, counts = list(seen), list(seen.values())
    for at in range(0, len(tokens), TERM_ROWS):
        yield pa.RecordBatch.from_pydict({"token": pa.array(tokens[at : at + TERM_ROWS], pa.string()), "n": pa.array(counts[at : at + TERM_ROWS], pa.int64())})


def weighed(frequencies: DataFrame, n: int) -> DataFrame:
    """frequencies (token, df) with idf among n chunks."""
    df = F.col("df")
    return frequencies.withColumn("idf", F.log(1 + (n - df + 0.5) / (df + 0.5)))


def terms_of(counted: DataFrame, n: int, mean_length: float, settings: Settings) -> DataFrame:
    sums = postings_of(counted).groupBy("token").agg(F.count("*").alias("df"), F.max(term_part(mean_length, settings)).alias("peak"))
    return weighed(sums, n).select("token", "df", "idf", "peak")


def shortest(counted: DataFrame, lengths: DataFrame) -> DataFrame:
    """chunk_id, length, token (null: none at all), profile: the SHORT shortest chunks of each profile with their terms."""
    by = ["profile"] if "profile" in lengths.columns else []
    order = Window.partitionBy(*by).orderBy("length", "chunk_id")
    if by:
        few = lengths.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SHORT).select("chunk_id")
    else:
        few = lengths.orderBy("length", "chunk_id").limit(LOOKED_AT).select("chunk_id")
    return counted.join(few, "chunk_id", "left_semi").select("chunk_id", "length", "token", *by)


def build_index(counted: DataFrame, lengths: DataFrame | None = None, terms: DataFrame | None = None, short: DataFrame | None = None, profiles: DataFrame | None = None, rows: DataFrame | None = None, settings: Settings = Settings()) -> Index:
    """The index of counted terms, best stored. lengths, terms and short: parts of it that are stored, too; rows: the term_rows that counted is made of, if it is."""
    lengths = lengths_of(counted) if lengths is None else lengths
    total = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    mean = total.mean or 1.0
    terms = terms_of(counted, total.n, mean, settings) if terms is None else terms
    short = shortest(counted, lengths) if short is None else short
    return Index(postings_of(counted).withColumn("part", term_part(mean, settings)), lengths, terms, total.n, mean, short, profiles, rows)


def asked_terms(queries: DataFrame, index: Index) -> DataFrame:
    """query_id (and class), token, weight (idf by occurrences in the query), df, bound (the most that it adds to a score) of the terms that are in the index."""
    by = ["query_id", *(["class"] if "class" in queries.columns else [])]
    asked = queries.select(*by, F.explode(bm25_tokens(F.col("text"))).alias("token")).groupBy(*by, "token").agg(F.count("*").alias("qtf"))
    known = index.terms.join(asked.select("token").distinct(), "token", "left_semi")
    weight = F.col("idf") * F.col("qtf")
    return asked.join(known, "token").select(*by, "token", weight.alias("weight"), "df", (weight * F.col("peak")).alias("bound"))


def hits_of(asked: DataFrame, index: Index, scope: Scopes | None) -> DataFrame:
    """query_id (and class), chunk_id, added of the postings of asked terms that the query's class lets pass."""
    by = [c for c in ("query_id", "class") if c in asked.columns]
    hits = index.postings.join(asked.select(*by, "token", "weight"), "token")
    hits = hits.select(*by, "chunk_id", *(["profile"] if scope else []), (F.col("weight") * F.col("part")).alias("added"))
    return scope.by_profile(hits).drop("profile") if scope else hits


def summed(hits: DataFrame, scope: Scopes | None) -> DataFrame:
    by = [c for c in ("query_id", "class") if c in hits.columns]
    sums = hits.groupBy(*by, "chunk_id").agg(F.sum("added").alias("score"))
    return scope.by_document(sums) if scope else sums


def scores(queries: DataFrame, index: Index, scope: Scopes | None = None) -> DataFrame:
    """query_id, chunk_id, score of all chunks that share a term with a query (query_id, text). With a scope queries have a class, and only what it lets pass is scored; the statistics stay those of the whole corpus.

    Only the queries' terms are joined to the postings; frequencies of terms are known from those rows.
    """
    asked = asked_terms(queries, index)
    known = known_where_read(asked, index, scope)
    if known is not None:
        return scans.all_scores(index.rows, known, index.mean_length)
    return summed(hits_of(asked, index, scope), scope).select("query_id", "chunk_id", "score")


def known_where_read(asked: DataFrame, index: Index, scope: Scopes | None) -> scans.Known | None:
    """What chunks are scored by where they are read, if the index has rows and it is not too much for the tasks."""
    if index.rows is None:
        return None
    return scans.known_of(asked, scope, index.profiles.count() if scope else 0)


def normalized_scores(queries: DataFrame, index: Index) -> DataFrame:
    """scores with normalized, settled. Where chunks are scored as they are read, that is done once for the ranges and once for the rows, and nothing is kept between."""
    found = settled(scores(queries, index))
    ranges = score_range(found, index.n)
    return normalized(found, F.broadcast(ranges) if index.rows is not None and queries.count() * TERM_ROW <= BROADCAST_BYTES else ranges)


def settled(scored: DataFrame) -> DataFrame:
    """Scores of nine digits, so that equal texts tie whatever the order of addition."""
    return scored.withColumn("score", F.round("score", 9))


def score_range(scored: DataFrame, n_filtered: int | DataFrame) -> DataFrame:
    """r_query_id, least, most of each query's scores over all n_filtered chunks (a number, or query_id, n_chunks); those without a row count as zero."""
    return range_over(scored.groupBy(F.col("query_id").alias("r_query_id")).agg(F.max("score").alias("most"), F.min("score").alias("low"), F.count("*").alias("n_hit")), n_filtered)


def range_over(ranges: DataFrame, n_filtered: int | DataFrame) -> DataFrame:
    """score_range of the ranges (r_query_id, most, low, n_hit) of chunks that have a row."""
    if isinstance(n_filtered, int):
        ranges = ranges.withColumn("n_chunks", F.lit(n_filtered))
    else:
        ranges = ranges.join(n_filtered, F.col("r_query_id") == F.col("query_id")).drop("query_id")
    least = F.when(F.col("n_hit") < F.col("n_chunks"), F.lit(0.0)).otherwise(F.col("low"))
    return ranges.select("r_query_id", "most", least.alias("least"))


def normalized(scored: DataFrame, ranges: DataFrame) -> DataFrame:
    """Adds normalized: min-max by query (score_range). All equal gives one if above zero."""
    rows = scored.join(ranges, F.col("query_id") == F.col("r_query_id"))
    same = F.col("most") == F.col("least")
    value = F.when(same, (F.col("most") > 0).cast("double")).otherwise((F.col("score") - F.col("least")) / (F.col("most") - F.col("least")))
    return rows.withColumn("normalized", value).drop("most", "least", "r_query_id")


def best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def completed(found: DataFrame, rest: DataFrame, index: Index) -> DataFrame:
    """found (query_id, class, chunk_id, score) with what the terms of rest (query_id, token, weight) add to it; only these chunks' postings of the terms are summed."""
    by = [c for c in found.columns if c != "score"]
    posts = index.postings.join(rest.select("token").distinct(), "token", "left_semi").select("token", "chunk_id", "part")
    added = found.select(*by).join(rest, "query_id").join(posts, ["token", "chunk_id"]).select(*by, (F.col("weight") * F.col("part")).alias("score"))
    return found.unionByName(added).groupBy(*by).agg(F.sum("score").alias("score"))


def likely(asked: DataFrame, index: Index, k: int, scope: Scopes | None, put: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """query_id (and class), chunk_id, score of all chunks that may be among the k best of a query, by bounds.

    Some chunks that share a query's rarest terms are scored in full; the k-th of them is a lower bound
    of its k-th score. The most frequent terms whose bounds together stay below WEAK of it can't lift a
    chunk on their own: only chunks with another term are met, and of these only such as can still reach
    the bound with all of them get the rest of their score.
    """
    mine = Window.partitionBy("query_id")
    before = F.coalesce(F.sum("df").over(mine.orderBy("df", "token").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    split = asked.withColumn("early", before < OPENING * k)
    terms = lambda flag: split.where(flag).drop("df", "bound", "early")
    first = best(summed(hits_of(terms("early"), index, scope), scope), 4 * k).drop("rank")
    first = best(completed(first, terms("not early").select("query_id", "token", "weight"), index), k).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    common = F.sum("bound").over(mine.orderBy(F.desc("df"), "token").rowsBetween(Window.unboundedPreceding, 0))
    ranked = asked.withColumn("common", common).join(first, "query_id", "left").fillna(0.0, ["kth"])
    reach = F.col("kth") * (1 - 1e-9) - 1e-8  # scores are rounded to nine digits
    ranked = put(ranked.withColumn("weak", F.col("common") < WEAK * reach), "ranked")
    met = summed(hits_of(ranked.where("not weak"), index, scope), scope)
    rest = ranked.groupBy("query_id").agg(F.max("kth").alias("kth"), F.coalesce(F.sum(F.when(F.col("weak"), F.col("bound"))), F.lit(0.0)).alias("rest"))
    able = put(met.join(rest, "query_id").where(F.col("score") + F.col("rest") >= reach).select(*met.columns), "able")
    return completed(able, ranked.where("weak").select("query_id", "token", "weight"), index)


def proven_zero(queries: DataFrame, asked: DataFrame, index: Index, scope: Scopes | None) -> DataFrame:
    """query_id of queries for which some of the shortest chunks that may be found has none of their terms."""
    order = Window.partitionBy("class").orderBy("length", "chunk_id")
    here = index.short.groupBy("chunk_id", "length", *(["profile"] if scope else [])).agg(F.count("token").alias("n"))
    if scope is None:
        looked = queries.select("query_id").join(F.broadcast(here.orderBy("length", "chunk_id").limit(LOOKED_AT)), how="cross")  # LOOKED_AT rows
    else:
        free = scope.classes.where("open and not listed").select("class").join(F.broadcast(here.orderBy("length", "chunk_id").limit(LOOKED_AT)), how="cross")  # one class
        closed = scope.pairs.join(scope.classes.where("not listed").select("class"), "class", "left_semi").join(here, "profile")
        few = free.select("class", "chunk_id", "length").unionByName(closed.select("class", "chunk_id", "length"))
        few = few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= LOOKED_AT)
        looked = queries.select("query_id", "class").join(few.select("class", "chunk_id"), "class")
    shared = asked.select("query_id", "token").join(index.short.where("token is not null").select("token", "chunk_id"), "token").select("query_id", "chunk_id").distinct()
    return looked.select("query_id", "chunk_id").join(shared, ["query_id", "chunk_id"], "left_anti").select("query_id").distinct()


def by_text(queries: DataFrame, index: Index, k: int, scope: Scopes, put: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(query_id, class, chunk_id, score of the k best; r_query_id, most, low, n_hit) of scoped queries that list no documents.

    A score depends on the text alone, so that a text is scored once for all its queries, within what any
    of them lets pass. Its k best chunks of each profile and the range of the profile's scores are kept;
    a query takes those of the profiles that it lets pass.
    """
    texts = put(queries.select("text").distinct().withColumn("query_id", F.monotonically_increasing_id()), "texts")
    units = put(queries.select(F.col("query_id").alias("u_query_id"), "class", "text").join(texts.withColumnRenamed("query_id", "text_id"), "text").drop("text"), "units")
    kinds = units.join(scope.classes.select("class", "open"), "class").groupBy(F.col("text_id").alias("class")).agg(F.bool_or("open").alias("open"))
    bitmaps = units.select("class", "text_id").distinct().join(scope.bitmaps, "class").groupBy(F.col("text_id").alias("class"), "word").agg(F.bit_or("bits").alias("bits"))
    within = replace(scope, classes=put(kinds, "text_classes"), bitmaps=put(bitmaps, "text_bitmaps"))
    asked = put(asked_terms(texts.withColumn("class", F.col("query_id")), index), "text_terms").select("class", "token", "weight")
    known = known_where_read(asked.withColumnRenamed("class", "query_id"), index, None)
    first = lambda df, *by: df.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "chunk_id"))).where(F.col("n") <= k).drop("n")
    if known is not None:
        found = within.by_profile(scans.best_and_ranges(index.rows, known, k, index.mean_length, by_profile=True).withColumnRenamed("query_id", "class"))
        kept, sums = scans.parted(put(found.withColumnRenamed("class", "query_id"), "text_found"))
        kept, sums = kept.withColumnRenamed("query_id", "text_id"), sums.withColumnRenamed("query_id", "text_id")
        kept = first(kept, "text_id", "profile")  # of a profile that several tasks share
    else:
        asked = F.broadcast(asked) if asked.count() * TERM_ROW <= BROADCAST_BYTES else asked
        hits = within.by_profile(index.postings.join(asked, "token").select("class", "profile", "chunk_id", (F.col("weight") * F.col("part")).alias("added")))
        hits = put(settled(hits.groupBy(F.col("class").alias("text_id"), "profile", "chunk_id").agg(F.sum("added").alias("score"))), "text_hits")
        kept = put(first(hits, "text_id", "profile"), "text_best")
        sums = put(hits.groupBy("text_id", "profile").agg(F.max("score").alias("most"), F.min("score").alias("low"), F.count("*").alias("n_hit")), "text_ranges")
    range_of = lambda df, *by: df.groupBy(*by).agg(F.max("most").alias("most"), F.min("low").alias("low"), F.sum("n_hit").alias("n_hit"))
    closed = units.join(scope.pairs, "class")
    free = units.join(scope.classes.where("open").select("class"), "class")
    meet = lambda rows, whole: closed.join(rows, ["text_id", "profile"]).drop("profile").unionByName(free.join(whole, "text_id")).drop("text_id").withColumnRenamed("u_query_id", "query_id")
    top = best(meet(kept, first(kept.drop("profile"), "text_id")), k).drop("rank")
    ranges = range_of(meet(sums, range_of(sums, "text_id")), F.col("query_id").alias("r_query_id"))
    return top, ranges


def search(queries: DataFrame, index: Index, k: int, scope: Scopes | None = None, path: str | None = None) -> DataFrame:
    """query_id, chunk_id, raw_score, normalized_score, rank: the k best chunks of each query, by score and chunk_id.

    Chunks without a common term have score zero and fill up short results; a query without terms has no
    rows. With a scope, queries have a class (with_class), and only chunks that it lets pass are found and
    normalised over. With an index that has rows, and queries that all tasks can hold, chunks are scored where
    they are read. Else, from BOUNDED_FROM postings on only what may be among the best is scored in full; then the
    best of a query is the top of its range, and the bottom is zero where a chunk without a term of the
    query is known, else all its scores are looked at. To fill k places, the k smallest of the
    ids that are not among fewer than k matches are enough, which the 2k smallest ids hold. With a path,
    what several steps read is written below it once. Scoped queries that share their texts are scored by
    text (by_text), whatever their number.
    """
    put = written(path)
    by = ["query_id", *(["class"] if scope else [])]
    n_chunks = index.n if scope is None else queries.select(*by).join(scope.classes.select("class", "n_chunks"), "class").select("query_id", "n_chunks")
    if path is not None and scope is not None and not scope.any_listed and shared(queries):
        top, ranges = by_text(queries, index, k, scope, put)
        return filled(queries, normalized(top, range_over(ranges, n_chunks)), index, k, scope)
    asked = put(asked_terms(queries.select(*by, "text"), index), "asked")
    known = known_where_read(asked, index, scope)
    if known is not None:
        kept, parts = scans.parted(put(scans.best_and_ranges(index.rows, known, k, index.mean_length), "found"))
        top = best(kept.drop("profile"), k).drop("rank")
        ranges = parts.groupBy(F.col("query_id").alias("r_query_id")).agg(F.max("most").alias("most"), F.min("low").alias("low"), F.sum("n_hit").alias("n_hit"))
        ranges = range_over(ranges, n_chunks)
    elif (asked.agg(F.sum("df")).first()[0] or 0) < BOUNDED_FROM:
        hits = put(settled(summed(hits_of(asked, index, scope), scope)), "hits")
        top, ranges = best(hits, k).drop("rank"), score_range(hits, n_chunks)
    else:
        top = put(best(settled(likely(asked, index, k, scope, put)), k).drop("rank"), "top")
        proven = put(proven_zero(queries, asked, index, scope), "proven")
        tops = top.groupBy("query_id").agg(F.max("score").alias("most"))
        ranges = tops.join(proven, "query_id", "left_semi").select(F.col("query_id").alias("r_query_id"), "most", F.lit(0.0).alias("least"))
        rest = settled(scores(queries.join(proven, "query_id", "left_anti"), index, scope))
        ranges = ranges.unionByName(score_range(rest, n_chunks).select("r_query_id", "most", "least"))
    return filled(queries, normalized(top, ranges), index, k, scope)


def shared(queries: DataFrame) -> bool:
    """Whether a text has SHARED_FROM queries and more."""
    n = queries.agg(F.count("*").alias("queries"), F.count_distinct("text").alias("texts")).first()
    return n.texts > 0 and n.queries >= SHARED_FROM * n.texts


def filled(queries: DataFrame, top: DataFrame, index: Index, k: int, scope: Scopes | None) -> DataFrame:
    """What search gives, of the normalised matches: the k smallest ids that pass and match nothing fill up short results."""
    by = ["query_id", *(["class"] if scope else [])]
    asking = queries.where(F.size(bm25_tokens(F.col("text"))) > 0).select(*by)
    short = asking.join(top.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k), "query_id", "left_anti")
    if scope is None:
        fill = [r.chunk_id for r in index.chunks.select("chunk_id").orderBy("chunk_id").limit(2 * k).collect()]  # 2k ids, however large the corpus
        spare = short.select("query_id", F.explode(F.array(*map(F.lit, fill)) if fill else F.array().cast("array<string>")).alias("chunk_id"))
    else:
        spare = short.join(scope.fill, "class").select("query_id", "chunk_id")
    spare = spare.join(top, ["query_id", "chunk_id"], "left_anti").withColumns({"score": F.lit(0.0), "normalized": F.lit(0.0)})
    both = best(top.select("query_id", "chunk_id", "score", "normalized").unionByName(spare), k)
    return both.select("query_id", "chunk_id", F.col("score").alias("raw_score"), F.col("normalized").alias("normalized_score"), "rank")
