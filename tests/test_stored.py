"""What is written between steps: how, and how often."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from govdocs.operators import registry
from govdocs.plans import questions, workspace


def test_tables_between_steps_are_compressed_well(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 1).select(F.sha2(F.col("id").cast("string"), 256).alias("s"))
    made = [workspace.stored(spark, "codec", "hashes", lambda: rows), registry.written(str(tmp_path))(rows, "hashes")]
    kinds = {pq.ParquetFile(f.removeprefix("file://")).metadata.row_group(0).column(0).compression for df in made for f in df.inputFiles()}
    assert kinds == {"ZSTD"} and {df.count() for df in made} == {1000}


def test_both_depths_share_an_adjacency(spark, tmp_path):
    edges = spark.createDataFrame([("e1", "a", "b", "d1"), ("e2", "b", "c", "d2"), ("e3", "x", "y", "d3")], "edge_id string, source_node_id string, target_node_id string, source_doc_id string")
    nodes = spark.createDataFrame([(n,) for n in "abcxy"], "node_id string")
    matched = spark.createDataFrame([(1, "a"), (2, "a")], "query_id int, node_id string")
    routes = spark.createDataFrame([(1, 1), (2, 2)], "query_id int, graph_depth int")
    ranks = spark.createDataFrame([(1, "d3", 1)], "query_id int, doc_id string, doc_rank int")
    found = questions.evidence_candidates(matched, routes, nodes, edges, ranks, str(tmp_path / "hoods"))
    assert [sorted(map(tuple, df.collect())) for df in found] == [[(1, n) for n in "abxy"] + [(2, n) for n in "abc"], [(1, "e1"), (1, "e3"), (2, "e1"), (2, "e2")]]
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("adjacency")) == ["hoods/adjacency"]
