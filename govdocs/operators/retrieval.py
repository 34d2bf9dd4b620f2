"""Metadata filters, vector search, fusion, citations and retrieval evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from govdocs.functions import text as X
from govdocs.operators import bm25, profiles
from govdocs.operators.nearest import nearest
from govdocs.operators.profiles import ARRAYS, FILTERS, SCALARS, TITLES
from govdocs.operators.registry import sent, written
from govdocs.settings import Settings

def filter_checks(filters: Column) -> dict[str, tuple[Column, Column]]:
    """name -> (is active, matches) for a struct of string arrays; null or empty means no constraint."""
    active = lambda n: F.coalesce(F.size(filters[n]) > 0, F.lit(False))
    out = {n: (active(n), F.array_contains(filters[n], F.col(c))) for n, c in SCALARS.items()}
    out |= {n: (active(n), F.arrays_overlap(filters[n], F.col(c))) for n, c in ARRAYS.items()}
    out[TITLES] = (active(TITLES), F.exists(filters[TITLES], lambda v: F.lower(F.col("section_title")).contains(F.lower(v))))
    return out


def filter_struct(**values: Column | list[str] | None) -> Column:
    """A filter struct of literals or of array columns."""

    def listed(value: Column | list[str] | None) -> Column:
        return value if isinstance(value, Column) else F.array(*map(F.lit, value or [])).cast("array<string>")

    return F.struct(*[listed(values.get(n)).alias(n) for n in FILTERS])


def matches(filters: Column) -> Column:
    """All active filters match."""
    out = F.lit(True)
    for on, ok in filter_checks(filters).values():
        out &= ~on | F.coalesce(ok, F.lit(False))
    return out


def apply_filters(df: DataFrame, filters: Column) -> DataFrame:
    return df.where(matches(filters))


def metadata_boost(filters: Column) -> Column:
    """Matching active filters by active filters; 0 without any."""
    checks = filter_checks(filters).values()
    on = sum((a.cast("int") for a, _ in checks), F.lit(0))
    ok = sum(((a & F.coalesce(m, F.lit(False))).cast("int") for a, m in checks), F.lit(0))
    return F.when(on > 0, ok / on).otherwise(F.lit(0.0))


def vector_search(queries: DataFrame, vectors: DataFrame, k: int, overfetch: int = 4, scope: profiles.Scopes | None = None, places: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """query_id, chunk_id, raw_score, normalized_score, rank by cosine.

    With a scope (queries have a class, places: chunk_id, profile) overfetch times k are found over all
    vectors and then filtered, so that a narrow filter may leave fewer than k.
    """
    ids = vectors.select(F.col("chunk_id").alias("id"), "vector")
    found = nearest(ids, queries.select("query_id", "vector"), k * overfetch, put=written(path)).withColumnRenamed("id", "chunk_id").drop("rank")
    if scope is not None:
        found = scope.within(found.join(queries.select("query_id", "class"), "query_id"), places)
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "chunk_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("cosine")))
    return found.select("query_id", "chunk_id", F.col("cosine").alias("raw_score"), score.alias("normalized_score"), "rank")


def weights(bm25_available: bool = True, vector_available: bool = True) -> dict[str, float]:
    """Fusion weights; with one side missing the other takes its share."""
    if not bm25_available and not vector_available:
        raise ValueError("INDEX_UNAVAILABLE: neither index can be read")
    if bm25_available and vector_available:
        return {"vector": 0.55, "bm25": 0.35, "metadata": 0.05, "recency": 0.05}
    return {"vector": 0.0 if bm25_available else 0.9, "bm25": 0.9 if bm25_available else 0.0, "metadata": 0.05, "recency": 0.05}


def fuse(found_bm25: DataFrame | None, found_vector: DataFrame | None, chunks: DataFrame, k: int, filters: DataFrame | None = None, minimum_score: float = 0.0, settings: Settings = Settings()) -> DataFrame:
    """query_id, chunk_id, bm25_score, vector_score, metadata_boost, recency_boost, hybrid_score, rank over the union of both sides' candidates. filters: query_id and the filter struct of each query that has one."""
    share = weights(found_bm25 is not None, found_vector is not None)
    k = min(max(k, 1), settings.top_k_max)
    sides = [(found_bm25, "bm25_score"), (found_vector, "vector_score")]
    parts = [df.select("query_id", "chunk_id", F.col("normalized_score").alias(name)) for df, name in sides if df is not None]
    pool = parts[0] if len(parts) == 1 else parts[0].join(parts[1], ["query_id", "chunk_id"], "full")
    for _, name in sides:
        if name not in pool.columns:
            pool = pool.withColumn(name, F.lit(None).cast("double"))
    meta = ["chunk_id", "doc_id", "department", "policy_type", "owner", "access_level", "regions", "related_processes", "section_title"]
    pool = pool.join(chunks.select(*[c for c in meta if c in chunks.columns]), "chunk_id")
    if filters is not None:
        pool = pool.join(filters.select("query_id", "filters"), "query_id", "left")
    boost = metadata_boost(F.col("filters")) if filters is not None else F.lit(0.0)
    pool = pool.withColumns({"metadata_boost": boost, "recency_boost": F.lit(1.0)})
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    raw = share["vector"] * zero("vector_score") + share["bm25"] * zero("bm25_score") + share["metadata"] * F.col("metadata_boost") + share["recency"] * F.col("recency_boost")
    pool = pool.withColumn("hybrid_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).where(F.col("hybrid_score") >= minimum_score)
    order = Window.partitionBy("query_id").orderBy(F.desc("hybrid_score"), "chunk_id")
    pool = pool.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return pool.select("query_id", "chunk_id", "bm25_score", "vector_score", "metadata_boost", "recency_boost", "hybrid_score", "rank")


def pool_size(k: int) -> int:
    """Candidates that each side gives to the fusion."""
    return min(4 * k, 80)


def search(queries: DataFrame, chunks: DataFrame, mode: str, k: int, index: bm25.Index | None = None, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, filters: Column | None = None, path: str | None = None, minimum_score: float = 0.0, settings: Settings = Settings(), rerank: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Ranked results of one mode: bm25, vector or hybrid. A single mode gives its normalised score as the final one.

    filters: a filter struct over the columns of queries, so that each query may have its own; it needs an
    index with profiles and a path for the tables of what they let pass. rerank takes and returns the
    result table; by default nothing changes.
    """
    k = min(max(k, 1), settings.top_k_max)
    wanted = {"bm25": k, "vector": k, "hybrid": pool_size(k)}[mode]
    scope = places = own = None
    if filters is not None:
        if index is None or index.profiles is None or path is None:
            raise ValueError("filters need an index with profiles and a path")
        places = index.chunks.select("chunk_id", "doc_id", "profile")
        queries = profiles.with_class(queries, profiles.constraint(filters))
        scope = profiles.scopes(queries, index.profiles, places, 2 * wanted, path)
        own = queries.select("query_id", filters.alias("filters"))
        query_vectors = None if query_vectors is None else query_vectors.join(queries.select("query_id", "class"), "query_id")
    by_words = bm25.search(queries, index, wanted, scope, path and f"{path}/bm25") if mode != "vector" and index is not None else None
    by_vector = vector_search(query_vectors, vectors, wanted, scope=scope, places=places, path=path and f"{path}/vectors") if mode != "bm25" and vectors is not None else None
    if mode == "hybrid":
        out = fuse(by_words, by_vector, chunks, k, own, minimum_score, settings)
    else:
        found = by_words if mode == "bm25" else by_vector
        if found is None:
            raise ValueError("INDEX_UNAVAILABLE: the index of this mode can't be read")
        none, score = F.lit(None).cast("double"), F.col("normalized_score")
        out = found.select("query_id", "chunk_id", (score if mode == "bm25" else none).alias("bm25_score"), (score if mode == "vector" else none).alias("vector_score"), F.lit(0.0).alias("metadata_boost"), F.lit(1.0).alias("recency_boost"), score.alias("hybrid_score"), "rank")
    return out.transform(rerank) if rerank else out


#: Characters of a page of content, and bytes of a search result that is sent to all tasks.
PAGE, RESULT_ROW = 2048, 200


def cited_documents(results: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The documents (doc_id, content) that results, best stored, come from: all that their citations need pages of."""
    own = chunks.select("chunk_id", "doc_id").join(sent(results.select("chunk_id").distinct(), RESULT_ROW), "chunk_id", "left_semi")
    return documents.join(sent(own.select("doc_id").distinct(), RESULT_ROW), "doc_id", "left_semi")


def content_pages(documents: DataFrame, size: int = PAGE) -> DataFrame:
    """doc_id, page (from 0), part: the content of documents in pages of so many characters, in the order of both, so that a file holds neighbours."""
    last = F.floor((F.greatest(F.length("content"), F.lit(1)) - 1) / size).cast("int")
    pages = documents.select("doc_id", "content", F.explode(F.sequence(F.lit(0), last)).alias("page"))
    return pages.select("doc_id", "page", F.substring("content", F.col("page") * size + 1, F.lit(size)).alias("part")).repartitionByRange("doc_id", "page").sortWithinPartitions("doc_id", "page")


def build_citations(results: DataFrame, chunks: DataFrame, pages: DataFrame, size: int = PAGE) -> tuple[DataFrame, DataFrame]:
    """(ok, invalid): results with citation id, quote, offsets and quote hash. A quote must equal its slice of the document.

    pages: content_pages of the documents. A citation meets only the pages that its offsets span, after the
    top k, so that what is moved grows with the quotes and not with the documents. results are best stored, as they
    are counted: few are sent to the chunks.
    """
    cited = sent(results, RESULT_ROW).join(chunks.select("chunk_id", "doc_id", "title", "section_title", F.col("text").alias("quote"), "start_char", "end_char"), "chunk_id")
    first, last = F.floor(F.col("start_char") / size).cast("int"), F.floor((F.greatest("end_char", F.col("start_char") + 1) - 1) / size).cast("int")
    spans = cited.where((F.col("start_char") >= 0) & (F.col("end_char") >= F.col("start_char"))).select("doc_id", "chunk_id", F.explode(F.sequence(first, last)).alias("page")).distinct()
    bodies = spans.join(pages, ["doc_id", "page"]).groupBy("doc_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("page", "part"))).alias("parts"))  # the pages of a chunk
    bodies = bodies.select("doc_id", "chunk_id", F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("body"))
    cited = cited.join(bodies, ["doc_id", "chunk_id"], "left")
    slice_ = F.substring("body", F.col("start_char") - first * size + 1, F.col("end_char") - F.col("start_char"))
    cited = cited.withColumn("valid", F.coalesce(slice_ == F.col("quote"), F.lit(False)) & (F.col("quote") != ""))
    clean = X.strip(F.regexp_replace("quote", r"\r\n?", "\n"))
    cited = cited.withColumns({"citation_id": F.concat(F.lit("CIT-"), F.col("rank").cast("string")), "quote_hash": X.sha256(clean)}).drop("body")
    return cited.where("valid").drop("valid"), cited.where("not valid").drop("valid").withColumn("error_code", F.lit("CITATION_VALIDATION_FAILED"))


def retrieval_eval(cases: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, rates): mode, case_id, hit for each case (case_id, expected_doc_ids, expected_chunk_ids) and mode of results (mode, query_id, doc_id, chunk_id); mode, hit_rate, n."""
    got = results.groupBy("mode", "query_id").agg(F.collect_set("doc_id").alias("docs"), F.collect_set("chunk_id").alias("ids"))
    modes = results.select("mode").distinct()
    pairs = cases.join(F.broadcast(modes), how="cross").join(got, (F.col("case_id") == F.col("query_id")) & (modes["mode"] == got["mode"]), "left").select(modes["mode"], "case_id", "expected_doc_ids", "expected_chunk_ids", "docs", "ids")
    hit = F.coalesce(F.arrays_overlap("expected_doc_ids", "docs"), F.lit(False)) | F.coalesce(F.arrays_overlap("expected_chunk_ids", "ids"), F.lit(False))
    hits = pairs.select("mode", "case_id", hit.alias("hit"))
    return hits, hits.groupBy("mode").agg(F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.count("*").alias("n"))


def hybrid_gate(rates: DataFrame, least: float = 0.8) -> DataFrame:
    """One row: whether the hybrid rate reaches `least` and both baselines."""
    of = lambda m: F.max(F.when(F.col("mode") == m, F.col("hit_rate")))
    row = rates.agg(of("bm25").alias("bm25"), of("vector").alias("vector"), of("hybrid").alias("hybrid"))
    return row.withColumn("passed", (F.col("hybrid") >= least) & (F.col("hybrid") >= F.col("bm25")) & (F.col("hybrid") >= F.col("vector")))
