"""Filtered and bounded search, scoped requests, pivots and rank directories against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from govdocs.operators import access, bm25, nearest, profiles, registry, retrieval, segments
from govdocs.sources import files

WORDS = ["red", "blue", "apple", "pear", "sky", "the", "of", "license", "token", "rare", "odd", "sea-side"]
CHUNK = "chunk_id string, doc_id string, title string, section_title string, department string, regions array<string>, owner string, related_processes array<string>, policy_type string, access_level string, text string"


def corpus(n=160):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        words = rng.choices(WORDS, weights=[8, 8, 4, 4, 2, 30, 30, 1, 1, 0.3, 0.3, 1], k=rng.choice([1, 3, 20, 60]))
        regions = rng.choice([["EU"], ["EU", "US"], [], None])
        rows.append((f"c{i:03}", f"d{i // 3:02}", "T", rng.choice(["Scope", "Purpose of it", "", None]), rng.choice(["Fin", "HR", None]), regions, rng.choice(["o1", "o2"]), ["p1"] if i % 2 else ["p2", "p3"], rng.choice(["policy", "sop"]), rng.choice(["public", "internal", "restricted"]), " ".join(words)))
    return rows


def asks():
    rng = random.Random(7)
    rows = []
    for q in range(40):
        f = {n: [] for n in profiles.FILTERS} | {n: None for n in profiles.FILTERS if rng.random() < 0.2}
        for name, values in (("departments", ["Fin", "HR", "none"]), ("policy_types", ["policy"]), ("regions", ["US", "EU"]), ("section_titles", ["PURP", "", "o", "scope of"]), ("owners", ["o2"]), ("related_processes", ["p3", "p1"]), ("doc_ids", ["d01", "d02", "d40", "gone"]), ("access_levels", ["public", "restricted"])):
            if rng.random() < 0.25:
                f[name] = rng.sample(values, rng.randint(1, len(values)))
        rows.append((q, " ".join(rng.choices([*WORDS, "unknown"], k=rng.randint(0, 8))), f))
    return rows


def passes(row, f):
    c = dict(zip([x.split(" ")[0] for x in CHUNK.split(", ")], row))
    for name, column in profiles.SCALARS.items():
        if f[name] and c[column] not in f[name]:
            return False
    for name, column in profiles.ARRAYS.items():
        if f[name] and not set(f[name]) & set(c[column] or []):
            return False
    titles = f[profiles.TITLES]
    return not titles or (c["section_title"] is not None and any(t.lower() in c["section_title"].lower() for t in titles))


def plain(rows, allowed, scores, asking, k):
    """query -> (chunk, score, normalised) of the k best of the allowed chunks."""
    out = {}
    for q, text in asking:
        if not text.strip():
            continue
        scored = sorted(((-round(scores.get((q, r[0]), 0.0), 9), r[0]) for r in rows if allowed(q, r)))
        most, least = (-scored[0][0], -scored[-1][0]) if scored else (0, 0)
        norm = lambda s: (1.0 if most > 0 else 0.0) if most == least else (s - least) / (most - least)  # noqa: B023, E731
        out[q] = [(c, -s, norm(-s)) for s, c in scored[:k]]
    return out


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    rows = corpus()
    put = registry.written(path)
    chunks = put(spark.createDataFrame(rows, CHUNK).repartition(3), "chunks")
    kinds = put(profiles.profiles_of(chunks, f"{path}/ranks"), "profiles")
    counted = put(bm25.counted_terms(bm25.indexable_text(profiles.with_profile(chunks, kinds))), "counted")
    index = bm25.build_index(counted, profiles=kinds)
    queries = put(spark.createDataFrame([(q, t, f) for q, t, f in asks()], "query_id int, text string, filters struct<" + ", ".join(f"{n}: array<string>" for n in profiles.FILTERS) + ">"), "queries")
    scores = {(r.query_id, r.chunk_id): r.score for r in bm25.scores(queries, index).collect()}
    return rows, chunks, index, queries, scores


def test_profiles_are_numbered_from_zero_and_cover_all_chunks(built):
    rows, chunks, index, *_ = built
    numbers = sorted(r.profile for r in index.profiles.collect())
    assert numbers == list(range(len(numbers))) and index.profiles.agg(F.sum("n_chunks")).first()[0] == len(rows)
    placed = profiles.with_profile(chunks, index.profiles)
    assert placed.count() == len(rows) and placed.join(index.profiles.select("profile", F.col("department").alias("own")), "profile").where(~F.col("own").eqNullSafe(F.col("department"))).isEmpty()


@pytest.mark.parametrize("bounded", [0, 1 << 60])
def test_filters_by_query_equal_plain_loops(built, tmp_path, monkeypatch, bounded):
    monkeypatch.setattr(bm25, "BOUNDED_FROM", bounded)
    rows, chunks, index, queries, scores = built
    got = retrieval.search(queries, chunks, "bm25", 5, index=index, filters=F.col("filters"), path=str(tmp_path / "s")).collect()
    filters = {q: f for q, _, f in asks()}
    want = plain(rows, lambda q, r: passes(r, filters[q]), scores, [(q, t) for q, t, _ in asks()], 5)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.chunk_id, r.bm25_score))
    assert {q: [c for c, _ in v] for q, v in found.items()} == {q: [c for c, *_ in v] for q, v in want.items() if v}
    assert all(abs(s - n) < 1e-6 for q, v in found.items() for (_, s), (*_, n) in zip(v, want[q]))


@pytest.mark.parametrize("bounded", [0, 1 << 60])
def test_bounds_change_no_row(built, tmp_path, monkeypatch, bounded):
    monkeypatch.setattr(bm25, "BOUNDED_FROM", bounded)
    rows, _, index, queries, scores = built
    got = bm25.search(queries.select("query_id", "text"), index, 4, path=str(tmp_path / "b")).collect()
    want = plain(rows, lambda q, r: True, scores, [(q, t) for q, t, _ in asks()], 4)
    assert {(r.query_id, r["rank"]): (r.chunk_id, round(r.normalized_score, 6)) for r in got} == {(q, i + 1): (c, round(n, 6)) for q, v in want.items() for i, (c, _, n) in enumerate(v)}


def test_bounds_leave_most_chunks_of_common_terms_alone(built, monkeypatch):
    monkeypatch.setattr(bm25, "OPENING", 2)
    spark, index = built[1].sparkSession, built[2]
    asked = bm25.asked_terms(spark.createDataFrame([(1, "the of rare odd")], "query_id int, text string"), index)
    kept = bm25.likely(asked, index, 2, None, registry.written(None))
    assert kept.count() < bm25.summed(bm25.hits_of(asked, index, None), None).count() / 3


def test_filters_need_an_index_with_profiles(built):
    _, chunks, index, queries, _ = built
    with pytest.raises(ValueError, match="profiles"):
        retrieval.search(queries, chunks, "bm25", 5, index=index, filters=F.col("filters"))


def test_texts_of_many_queries_are_scored_once(built, tmp_path, monkeypatch):
    _, chunks, index, queries, _ = built
    spark = chunks.sparkSession
    rows = [(f"{i}-{q}", t, {**f, "doc_ids": None, "policy_types": ["sop"] if i == 1 else f["policy_types"]} if i else dict.fromkeys(profiles.FILTERS)) for q, t, f in asks()[:12] for i in range(3)]
    asked = profiles.with_class(spark.createDataFrame(rows, "query_id string, text string, filters " + queries.schema["filters"].dataType.simpleString()), profiles.constraint(F.col("filters")))
    scope = profiles.scopes(asked, index.profiles, index.chunks, 8, str(tmp_path / "scopes"))
    units, got, joined = asked.select("query_id", "text", "class"), {}, []
    met = bm25.asked_terms
    monkeypatch.setattr(bm25, "asked_terms", lambda q, i: joined.append(q.count()) or met(q, i))
    for least in (2, 1 << 60):
        monkeypatch.setattr(bm25, "SHARED_FROM", least)
        found = bm25.search(units, index, 4, scope, str(tmp_path / f"found{least}")).collect()
        got[least] = sorted((r.query_id, r["rank"], r.chunk_id, round(r.raw_score, 6), round(r.normalized_score, 6)) for r in found)
    assert got[2] == got[1 << 60] and len(got[2]) > 60
    assert joined == [len({t for _, t, _ in rows}), len(rows)]


def test_requests_find_only_what_they_may_see(built, tmp_path):
    rows, chunks, index, queries, scores = built
    spark = chunks.sparkSession
    personas = [("p", "internal", ["Fin", "HR"], ["EU"], None, None), ("q", "restricted", None, ["EU", "US"], ["sop"], ["o1"]), ("none", "public", [], ["EU"], None, None)]
    asking = [(i, ["p", "q", "none", "who"][i % 4], ["hr"] if i % 3 == 0 else None, None, None, None, None) for i in range(24)]
    resolved = access.resolve_access(spark.createDataFrame(asking, "request_id int, persona_id string, requested_departments array<string>, requested_regions array<string>, requested_policy_types array<string>, requested_access_levels array<string>, requested_owners array<string>"), spark.createDataFrame(personas, "persona_id string, max_access_level string, department_scope array<string>, regions array<string>, allowed_policy_types array<string>, owner_scope array<string>"))
    texts = [t for _, t, _ in asks() if t.strip()][:6]
    asked = [(i, texts[i % 6]) for i, *_ in asking]
    found = access.search_as(resolved, spark.createDataFrame(asked, "request_id int, text string"), index, 3, str(tmp_path / "a")).collect()
    seen = {(r.request_id, r.chunk_id) for r in access.authorize(chunks, resolved).collect()}
    of = {t: q for q, t, _ in asks()}
    by_text = {(i, c): s for i, t in asked for (q, c), s in scores.items() if q == of[t]}
    want = plain(rows, lambda i, r: (i, r[0]) in seen, by_text, asked, 3)
    assert sorted((r.request_id, r["rank"], r.chunk_id) for r in found) == sorted((i, n + 1, c) for i, v in want.items() for n, (c, *_) in enumerate(v))
    assert not {r.request_id for r in found} & {i for i, p, *_ in asking if p in ("none", "who")}


def test_vector_search_filters_what_it_overfetched(built, tmp_path):
    rows, chunks, index, queries, _ = built
    spark, rng = chunks.sparkSession, np.random.default_rng(2)
    v = {r[0]: rng.normal(size=6) for r in rows}
    q = {i: rng.normal(size=6) for i, *_ in asks()}
    frame = lambda d, name, kind: spark.createDataFrame([(k, x.tolist()) for k, x in d.items()], f"{name} {kind}, vector array<double>")
    got = retrieval.search(queries, chunks, "vector", 5, index=index, vectors=frame(v, "chunk_id", "string"), query_vectors=frame(q, "query_id", "int"), filters=F.col("filters"), path=str(tmp_path / "v")).collect()
    want = set()
    for i, _, f in asks():
        near = sorted(rows, key=lambda r: (-round(float(v[r[0]] @ q[i] / np.linalg.norm(v[r[0]]) / np.linalg.norm(q[i])), 12), r[0]))[:20]  # noqa: B023
        want |= {(i, n + 1, r[0]) for n, r in enumerate([r for r in near if passes(r, f)][:5])}
    assert {(r.query_id, r["rank"], r.chunk_id) for r in got} == want


@pytest.mark.parametrize("kind", ["clusters", "noise", "ties", "zeros"])
def test_pivots_find_the_nearest_of_all(spark, tmp_path, kind):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 5))
    x = {"clusters": np.repeat(centres, 50, axis=0) + rng.normal(size=(400, 5)) / 50, "noise": rng.normal(size=(400, 5)), "ties": np.repeat(centres[:2], 200, axis=0), "zeros": np.zeros((400, 5))}[kind]
    x[7] = 0
    q = np.concatenate([x[:6], rng.normal(size=(6, 5)), np.zeros((1, 5))])
    frame = lambda m, name: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(10_000, None)], f"{name} int, vector array<double>")
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    cosine = np.round(unit(q) @ unit(x).T, 12)
    got = nearest.nearest(frame(x, "id").repartition(3), frame(q, "query_id"), 5, block=16, pivots=8, put=registry.written(str(tmp_path / kind)))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()
    found = {(r.query_id, r["rank"]): (r.id, round(r.cosine, 9)) for r in got.collect()}
    assert found == {(i, n + 1): (int(j), round(float(c[j]), 9)) for i, c in enumerate(cosine) for n, j in enumerate(sorted(range(len(x)), key=lambda j: (-c[j], j))[:5])}  # noqa: B023


def test_far_cells_are_never_met(spark):
    rng = np.random.default_rng(4)
    centres = np.eye(8)
    x = np.repeat(centres, 40, axis=0) + rng.normal(size=(320, 8)) / 100
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vector array<double>")
    at = nearest.pivots_of(vectors, 24)
    blocks = nearest.blocks_of(vectors, at, 64)
    cells = [tuple(r) for r in blocks.groupBy("cell").agg(F.sum("n"), F.min("low"), F.max("high")).collect()]
    queries = spark.createDataFrame([(0, x[0].tolist(), 0.05)], "query_id int, vector array<double>, kth double")
    assert nearest.visits(queries, at, cells, 5).count() + nearest.visits(queries.drop("kth"), at, cells, 5).count() < len(cells) / 2


def test_no_vectors_find_nothing(spark):
    none = spark.createDataFrame([], "id int, vector array<double>")
    assert nearest.nearest(none, spark.createDataFrame([(1, [1.0])], "query_id int, vector array<double>"), 3).collect() == []


def test_rank_directory_pages_and_ranks(spark, tmp_path):
    rows = [(i * 7919 % 1000, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    directory = registry.rank_directory(df, [F.desc("a"), "b"], str(tmp_path / "ranks"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert [(r.a, r.b) for r in directory.ranked().orderBy("rank").collect()] == want and directory.total == 3000
    for offset, limit in ((0, 5), (1499, 200), (2990, 100), (3000, 10), (10**9, 5), (-3, 0)):
        page = directory.page(offset, limit)
        assert [(r.a, r.b) for r in page.collect()] == want[max(0, offset) :][: min(max(1, limit), 200)]
    plan = directory.page(1499, 50)._jdf.queryExecution().executedPlan().toString()
    assert "GlobalLimit" not in plan and "rank_part" in plan and len(directory.parts) > 1
    empty = registry.rank_directory(df.limit(0), ["a", "b"], str(tmp_path / "none"))
    assert empty.total == 0 and empty.page(0, 5).collect() == [] and empty.ranked().collect() == []


def test_segments_equal_a_rebuild(spark, tmp_path, monkeypatch):
    """Three upserts (added, changed, removed, changed back), merged, and compacted; only what differs is counted."""
    table = lambda rows: spark.createDataFrame([(c, str(hash(t)), t) for c, t in rows.items()], "chunk_id string, text_sha256 string, indexable string")
    rows = {r[0]: r[-1] for r in corpus(60)}
    index = segments.first_segments(table(rows), 8, str(tmp_path / "0"))
    real, counted = bm25.counted_terms, []
    monkeypatch.setattr(bm25, "counted_terms", lambda texts: counted.append(texts.count()) or real(texts))
    old = dict(rows)
    steps = [{"c001": "wholly new text", "c900": "the of the added", "c002": None}, {"c001": old["c001"], "c002": old["c002"], "c003": "", "c900": None}, {"c900": "back again of the", "c004": None, "c003": old["c003"]}]
    for n, step in enumerate(steps):
        rows = {c: t for c, t in (rows | step).items() if t is not None}
        index = segments.with_changes(index, table(rows), 8, str(tmp_path / f"s{n}"))
        want = bm25.build_index(real(table(rows)))
        for now in (index, segments.compacted(index, str(tmp_path / f"c{n}"))):
            got = segments.index_of(now)
            assert (got.n, round(got.mean_length, 9)) == (want.n, round(want.mean_length, 9))
            show = lambda df, *cs: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cs).collect())
            assert show(got.terms, "token", "df", "idf", "peak") == show(want.terms, "token", "df", "idf", "peak")
            assert show(got.postings, "token", "chunk_id", "tf", "length", "part") == show(want.postings, "token", "chunk_id", "tf", "length", "part")
        assert files.manifest_changes(index.manifest, files.index_manifest(table(rows), 8)).isEmpty()
    assert counted == [2, 3, 2]


def test_citations_meet_only_the_pages_they_span(spark):
    text = "".join(chr(97 + i % 26) + ("é" if i % 7 == 0 else "") for i in range(500))
    pages = retrieval.content_pages(spark.createDataFrame([("d", text), ("e", ""), ("f", None)], "doc_id string, content string"), 10)
    assert "".join(r.part for r in pages.where("doc_id = 'd'").orderBy("page").collect()) == text
    spans = [(0, 5), (8, 12), (95, 230), (len(text) - 3, len(text)), (10, 20)]
    rows = [(f"c{i}", "d", text[a:b], a, b) for i, (a, b) in enumerate(spans)] + [("off", "d", text[3:9], 4, 10), ("late", "d", "x", 9000, 9001), ("gone", "g", "x", 0, 1), ("none", "e", "", 0, 0), ("odd", "d", "x", 7, 3)]
    chunks = spark.createDataFrame([(c, d, "T", "S", q, a, b) for c, d, q, a, b in rows], "chunk_id string, doc_id string, title string, section_title string, text string, start_char int, end_char int")
    results = spark.createDataFrame([(1, c, i + 1) for i, (c, *_) in enumerate(rows)] + [(2, "c2", 1)], "query_id int, chunk_id string, rank int")
    ok, bad = retrieval.build_citations(results, chunks, pages, 10)
    assert sorted((r.query_id, r.chunk_id, r.quote) for r in ok.collect()) == sorted([(1, f"c{i}", text[a:b]) for i, (a, b) in enumerate(spans)] + [(2, "c2", text[95:230])])
    assert sorted(r.chunk_id for r in bad.collect()) == ["gone", "late", "none", "odd", "off"]


def test_queries_meet_cells_in_rows_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(nearest, "MEETING", 8)
    rng = np.random.default_rng(3)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 4)))], "query_id int, vector array<double>")
    pivots = nearest.unit(rng.normal(size=(3, 4)))
    kept = []
    monkeypatch.setattr(type(frame), "mapInPandas", lambda self, run, schema: kept.append(run) or self)
    nearest.visits(frame, pivots, [(c, 20, 0.0, 2.0) for c in range(3)], 50)
    met = list(kept[0](iter([frame.toPandas()])))
    assert all(len(p) == 1 and len(p.q_ids[0]) <= 8 for p in met)
    assert sorted((p.q_cell[0], i) for p in met for i in p.q_ids[0]) == [(c, i) for c in range(3) for i in range(60)]


def test_counts_of_requests_are_those_of_their_chunks_without_pairs(built):
    _, chunks, *_ = built
    spark = chunks.sparkSession
    lists = [["Fin"], None, ["HR", "Fin"], []]
    rows = [(i, lists[i % 4], [["EU"], None, ["US"]][i % 3], None, [["public"], ["public", "internal"], []][i % 3 if i < 9 else 1], None, None) for i in range(24)]
    resolved = spark.createDataFrame(rows, "request_id int, allowed_departments array<string>, allowed_regions array<string>, allowed_policy_types array<string>, allowed_access_levels array<string>, allowed_owners array<string>, error string")
    want = access.authorize(chunks, resolved).groupBy("request_id").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first"), F.max("chunk_id").alias("last"))
    got = access.authorized_counts(chunks, resolved)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 5
