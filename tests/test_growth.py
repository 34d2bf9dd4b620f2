"""What queries leave out of their work, with the same results."""

from pyspark.sql import functions as F

from govdocs.functions import text as X
from govdocs.operators import graph
from govdocs.plans import demo, workspace


def test_stats_and_sources_of_the_graph_take_no_quotes(spark, sf_dir):
    source = sf_dir + "/."  # a source of its own, so that nothing is stored of it yet
    made = lambda: {name for _, s, name in workspace._made if s == source}
    n = demo.g9_node_sources(spark, source).count()
    assert n > 0 and not made() & {"nodes", "edges", "bare_edges"}
    got = demo.g14_stats(spark, source).first()
    demo.f6_readiness(spark, source).count()
    assert "edges" not in made()
    nodes, sources, edges = demo.demo_graph(spark, source)
    assert graph.graph_stats(nodes, sources, edges).first() == got and sources.count() == n


def test_a_pair_of_another_document_keeps_its_mention(spark):
    schema = "edge_id string, source_node_id string, target_node_id string, relation_type string, source_doc_id string, source_chunk_id string, hint string, confidence double"
    rows = [("e1", "a", "b", "MENTIONS", "d", "c1", "q", 0.8), ("e2", "a", "b", "REQUIRES", "d", "c2", "q", 0.8), ("e3", "a", "b", "MENTIONS", "e", "c3", "q", 0.8), ("e4", "b", "a", "MENTIONS", "d", "c1", "q", 0.8)]
    edges = spark.createDataFrame(rows, schema).withColumn("hint", F.concat("hint", F.lit("")))
    kept = graph.merge_edges(edges)
    assert {r.edge_id for r in kept.collect()} == {"e2", "e3", "e4"}
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1  # edges are made once


def test_words_before_patterns_lose_nothing(spark):
    texts = ["5 MINUTES", "5 mınutes", "2 buſineſſ days", "2 worKing days", "FIRST week", "uſd 5", "more than 3 consecutive WORKING days", "no time at all", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r for r in rows.select("i", X.time_requirements(F.col("t")).alias("times"), X.thresholds(F.col("t")).alias("amounts")).collect()}
    plain = rows.select("i", F.size(F.regexp_extract_all("t", F.lit(X.TIME_REQUIREMENT), F.lit(0))).alias("times"), F.size(F.regexp_extract_all("t", F.lit(X.THRESHOLD), F.lit(0))).alias("amounts")).collect()
    for r in plain[:-1]:
        assert (len(got[r.i].times), len(got[r.i].amounts)) == (r.times, r.amounts)
    assert sum(r.times for r in plain[:-1]) >= 5 and sum(r.amounts for r in plain[:-1]) >= 2 and got[8].times is None


def test_sections_of_a_listing_are_cut_from_its_documents(spark, sf_dir):
    plan = demo.r1_documents(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("ArrowEvalPython")[1].split("Join")[0]
    assert "Filter" in below and "exists(" in below


def test_stored_tables_have_small_row_groups(spark, monkeypatch):
    import pathlib

    import pyarrow.parquet as pq

    monkeypatch.setattr(workspace, "ROW_GROUP", 1 << 16)
    path = workspace.stored(spark, "row groups", "numbers", lambda: spark.range(0, 200_000, 1, 1).select(F.sha2(F.col("id").cast("string"), 256).alias("s"))).inputFiles()[0]
    assert pq.ParquetFile(pathlib.Path(path.removeprefix("file://"))).metadata.num_row_groups > 4


def test_texts_go_to_python_in_bounded_batches(spark, monkeypatch):
    from govdocs.functions import helpers
    from govdocs.operators import bm25, ingest

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    monkeypatch.setattr(helpers, "BATCH_BYTES", 4 << 10)
    texts = spark.range(0, 400, 1, 1).select(F.col("id").cast("string").alias("chunk_id"), F.repeat(F.lit("word "), 40).alias("indexable"))
    try:
        rows = texts.select("chunk_id", F.col("indexable").alias("text"), F.col("indexable").alias("content"), F.col("chunk_id").alias("doc_id"))
        for make in (lambda: bm25.counted_terms(texts), lambda: helpers.embed(rows, "text"), lambda: ingest.sections(rows.select("doc_id", "content"))):
            spark.conf.set(key, "64m")
            got = make()  # plans run later, with the session's setting of then
            sizes = {r.n for r in texts.mapInPandas(lambda parts: (p.assign(n=len(p))[["n"]] for p in parts), "n long").distinct().collect()}
            assert max(sizes) <= 50 and got.count() >= 400
    finally:
        spark.conf.set(key, before)
