"""Chunks scored where their terms are read, against the joins over postings."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_search import asks, built  # noqa: F401

from govdocs.operators import bm25, nearest, profiles, registry, retrieval, scans
from govdocs.plans import demo, workspace


@pytest.fixture(scope="module")
def read(built, tmp_path_factory):  # noqa: F811
    """The index of the asked terms with rows."""
    _, chunks, index, queries, _ = built
    path = str(tmp_path_factory.mktemp("rows") / "rows")
    bm25.term_rows(bm25.indexable_text(profiles.with_profile(chunks, index.profiles)), bm25.asked_list(queries)).write.parquet(path)
    rows = chunks.sparkSession.read.parquet(path)
    return bm25.build_index(bm25.counted_of(rows), rows.select("chunk_id", "length", "doc_id", "profile"), profiles=index.profiles, rows=rows)


def test_rows_have_the_asked_terms_alone_and_count_all(built, read):  # noqa: F811
    _, _, index, queries, _ = built
    asked = set(bm25.asked_list(queries))
    kept = {(r.token, r.chunk_id): (r.tf, r.length, r.profile) for r in read.postings.collect()}
    assert kept == {(r.token, r.chunk_id): (r.tf, r.length, r.profile) for r in index.postings.collect() if r.token in asked}
    assert len(kept) < index.postings.count() and (read.n, read.mean_length) == (index.n, index.mean_length)
    assert {r.token: (r.df, r.idf) for r in read.terms.collect()} == {r.token: (r.df, r.idf) for r in index.terms.collect() if r.token in asked}


@pytest.mark.parametrize("cells", [1, 1 << 20])
def test_scores_where_read_equal_joins(built, read, tmp_path, monkeypatch, cells):  # noqa: F811
    monkeypatch.setattr(scans, "CELLS", cells)
    monkeypatch.setattr(scans, "PRODUCTS", min(cells, 1 << 16))
    rows, chunks, index, queries, scores = built
    found = bm25.scores(queries, read)
    assert {(r.query_id, r.chunk_id): round(r.score, 9) for r in found.collect()} == {k: round(s, 9) for k, s in scores.items()}
    assert "Exchange hashpartitioning(query_id" not in found._jdf.queryExecution().executedPlan().toString()
    show = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.raw_score, 6), round(r.normalized_score, 6)) for r in df.collect())
    for k in (1, 4, 200):
        assert show(bm25.search(queries.select("query_id", "text"), read, k, path=str(tmp_path / f"a{k}"))) == show(bm25.search(queries.select("query_id", "text"), index, k))
    own = [retrieval.search(queries, chunks, "bm25", 5, index=i, filters=F.col("filters"), path=str(tmp_path / f"own{n}")) for n, i in enumerate((read, index))]
    assert [sorted(map(str, df.collect())) for df in own][0] == sorted(map(str, own[1].collect()))


def test_texts_of_many_queries_where_read(built, read, tmp_path, monkeypatch):  # noqa: F811
    _, chunks, index, queries, _ = built
    rows = [(f"{i}-{q}", t, {**f, "doc_ids": None} if i else dict.fromkeys(profiles.FILTERS)) for q, t, f in asks()[:12] for i in range(3)]
    asked = profiles.with_class(chunks.sparkSession.createDataFrame(rows, "query_id string, text string, filters " + queries.schema["filters"].dataType.simpleString()), profiles.constraint(F.col("filters")))
    scope = profiles.scopes(asked, index.profiles, index.chunks, 8, str(tmp_path / "scopes"))
    units, got = asked.select("query_id", "text", "class"), []
    for n, i in enumerate((read, index)):
        found = bm25.search(units, i, 4, scope, str(tmp_path / f"found{n}")).collect()
        got.append(sorted((r.query_id, r["rank"], r.chunk_id, round(r.raw_score, 6), round(r.normalized_score, 6)) for r in found))
    assert got[0] == got[1] and len(got[0]) > 60
    assert (tmp_path / "found0" / "text_found").exists() and not (tmp_path / "found0" / "text_hits").exists()


def test_terms_of_many_queries_meet_postings(built, read, monkeypatch):  # noqa: F811
    _, _, index, queries, scores = built
    monkeypatch.setattr(scans, "SENT_BYTES", scans.SENT_ROW)
    assert bm25.known_where_read(bm25.asked_terms(queries, read), read, None) is None
    assert {(r.query_id, r.chunk_id) for r in bm25.scores(queries, read).collect()} == set(scores)
    monkeypatch.setattr(bm25, "BROADCAST_BYTES", bm25.TERM_ROW)
    assert bm25.asked_list(queries) is None
    assert replace(read, rows=None).rows is None


def test_equal_scores_of_slices_are_ranked_by_id():
    kept = scans.Best(1, 3)
    for ids in (["d", "a"], ["c", "e"], ["b"]):
        kept.add(np.array(ids, dtype=object), np.array([[1.0 + 1e-12]] * len(ids)))
    kept.add(np.array(["z", "0"], dtype=object), np.array([[2.0], [0.0]]))
    assert kept.ids[:, 0].tolist() == ["z", "a", "b"] and kept.n_hit.tolist() == [6] and (kept.low[0], kept.most[0]) == (1.0, 2.0)


def test_searches_store_asked_terms_and_no_pairs(spark, sf_dir):
    source = sf_dir + "/./."  # a source of its own, so that nothing is stored of it yet
    demo.t6_search(spark, source).count()
    assert {name for _, s, name in workspace._made if s == source} == {"chunks", "profiles", "term_rows", "terms", "short", "found5"}
    known = set(bm25.asked_list(demo.asked(spark, source)))
    assert {r.token for r in demo.index(spark, source).terms.select("token").collect()} <= known
    demo.t3_index(spark, source).count()
    assert not {name for _, s, name in workspace._made if s == source} & {"counted", "lengths"}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_blocks_meet_few_queries_where_they_are_read(spark, tmp_path, monkeypatch, kind):
    rng = np.random.default_rng(8)
    x = np.repeat(rng.integers(-9, 9, size=(40, 6)), 8, axis=0) + rng.integers(0, 2, size=(320, 6))
    frame = lambda m, name: spark.createDataFrame([(f"v{i:03}", [float(c) for c in v]) for i, v in enumerate(m)], f"{name} string, vector array<{kind}>")
    vectors, queries, found = frame(x, "id").repartition(5), frame(np.concatenate([x[:9], np.zeros((1, 6))]), "query_id"), []
    for held, sent in ((1, nearest.SENT_BYTES), (90, nearest.SENT_BYTES), (1 << 18, nearest.SENT_BYTES), (1 << 18, 0)):
        monkeypatch.setattr(nearest, "HELD", max(held, 10 * 7))
        monkeypatch.setattr(nearest, "MEETING", 4)
        monkeypatch.setattr(nearest, "SENT_BYTES", sent)
        got = nearest.nearest(vectors, queries, 7, block=8, pivots=6, put=registry.written(str(tmp_path / f"{held}-{sent}")))
        assert ("q_cell" in got._jdf.queryExecution().optimizedPlan().toString()) == (sent == 0)  # blocks are not dealt out
        found.append(sorted((r.query_id, r["rank"], r.id, round(r.cosine, 9)) for r in got.collect()))
    assert found[0] == found[1] == found[2] == found[3] and len(found[0]) == 70
    at = nearest.pivots_of(vectors, 6)
    assert {len(r.matrix) for r in nearest.blocks_of(vectors, at, 8).where("n = 8").collect()} == {8 * 6 * (4 if kind == "float" else 8)}


def test_tasks_hand_on_the_best_alone(spark):
    rng = np.random.default_rng(9)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 4)))], "id int, vector array<double>").coalesce(2)
    at = nearest.pivots_of(vectors, 3)
    blocks = nearest.blocks_of(vectors, at, 10)
    cells = [tuple(r) for r in blocks.groupBy("cell").agg(F.sum("n"), F.min("low"), F.max("high")).collect()]
    q = nearest.unit(rng.normal(size=(3, 4)))
    met = nearest.best_where_read(blocks, at, cells, [0, 1, 2], q, 5, np.full(3, 4.0), "query_id int, id int, cosine double")
    assert met.groupBy("query_id", F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 5


def test_citations_read_the_pages_of_their_documents(spark, sf_dir):
    source = sf_dir + "/././."
    cited = demo.t13_citations(spark, source)
    assert cited.count() > 0 and "pages" not in {name for _, s, name in workspace._made if s == source}
    results = demo.found_bm25(spark, source)
    own = {r.doc_id for r in results.join(demo.chunks(spark, source), "chunk_id").select("doc_id").collect()}
    kept = retrieval.cited_documents(results, demo.chunks(spark, source), demo.documents(spark, source))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(own) and len(own) < demo.documents(spark, source).count()
