"""Reading, parsing, sections, chunks and upkeep on small fixtures."""

import datetime
import hashlib
import json
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from govdocs.functions import helpers
from govdocs.functions import text as X
from govdocs.functions.helpers import hashed_vector, section_rows, token_windows
from govdocs.operators import ingest
from govdocs.settings import Settings
from govdocs.sources import files

FRONT = """---
doc_id: {id}
title: Travel rules
department: Finance
regions: [EU, eu, APAC]
policy_type: policy
effective_date: 2024-03-01
version: "1.0"
access_level: internal
owner: Travel desk
source_file: /spoofed.md
content_sha256: spoofed
created_at: 2024-01-01T00:00:00Z
updated_at: {updated}
---
{body}"""


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "c string").select(expr(F.col("c")).alias("v")).first().v


def test_normalize_text(spark):
    for raw in ("a \r\nb\t\rc  \n\n", "", "  \n ", "x \ny", " lead\n\n\n  keep\ttab "):
        lines = "\n".join(x.rstrip() for x in raw.replace("\r\n", "\n").replace("\r", "\n").split("\n")).strip()
        assert one(spark, X.normalize_text, raw) == (lines + "\n" if lines else "")


def test_read_raw(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_bytes(b"\xef\xbb\xbfhello \r\nworld")
    (tmp_path / "sub" / "B.TXT").write_text("text")
    (tmp_path / "c.pdf").write_text("no")
    (tmp_path / "d.md").write_text(" \n")
    (tmp_path / "e.md").write_text("x" * 100)
    good, bad = files.read_raw(spark, str(tmp_path), Settings(max_file_bytes=50))
    assert [tuple(r) for r in good.collect()] == [("a.md", "hello\nworld\n"), ("sub/B.TXT", "text\n")]
    assert {tuple(r) for r in bad.collect()} == {("c.pdf", "UNSUPPORTED_FILE_TYPE"), ("d.md", "EMPTY_DOCUMENT"), ("e.md", "FILE_TOO_LARGE")}


def test_front_matter_and_validation(spark):
    good = FRONT.format(id="travel", updated="2024-01-02T00:00:00Z", body="# T\n\nBody")
    rows = [
        ("ok.md", good),
        ("rev.md", FRONT.format(id="rev", updated="2023-01-02T00:00:00Z", body="Body")),
        ("none.md", "no front matter"),
        ("open.md", "---\ntitle: x\n"),
        ("blank.md", "---\ntitle: x\n---\n \n"),
        ("list.md", "---\n- a\n---\nBody"),
        ("enum.md", good.replace("policy_type: policy", "policy_type: memo")),
    ]
    parsed = ingest.parse_metadata(ingest.split_front_matter(spark.createDataFrame(rows, "path string, content string")))
    kept, bad = ingest.validate_metadata(parsed)
    row = kept.first()
    assert kept.count() == 1 and row.doc_id == "travel" and row.regions == ["EU", "APAC"]
    assert row.source_file == "ok.md" and row.content_sha256 == hashlib.sha256(b"# T\n\nBody").hexdigest()
    errors = {r.path: r.errors for r in bad.collect()}
    assert errors["rev.md"] == ["dates_reversed"] and errors["enum.md"] == ["policy_type"]
    assert errors["none.md"][0] == "missing_front_matter" and errors["blank.md"][0] == "empty_body" and errors["list.md"][0] == "not_a_mapping"


def test_sections_keep_paths_and_count_kept_slugs(spark):
    text = "before\n# Top\n\n## Empty\n\n## Part\n\nfirst 😀\n\n## Part\n\nsecond\n### Deep\n\nthird\n"
    rows = section_rows(text, Settings())
    assert [(r[0], r[2], r[3]) for r in rows] == [("Part", 1, ["Top", "Part"]), ("Part", 2, ["Top", "Part"]), ("Deep", 1, ["Top", "Part", "Deep"])]
    docs = spark.createDataFrame([("d", text)], "doc_id string, content string")
    for r in ingest.sections(docs).collect():
        assert r.text == text[r.start_char : r.end_char]
    for r in ingest.chunks(docs).collect():
        assert r.text == text[r.start_char : r.end_char] and r.text_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    assert [r.chunk_index for r in ingest.chunks(docs).orderBy("chunk_index").collect()] == [1, 2, 3]
    assert section_rows("plain text", Settings())[0][0] == "Document Body"


def test_windows():
    s = Settings()
    assert token_windows(800, s) == [(0, 800)] and token_windows(801, s) == [(0, 600), (500, 801)]
    assert token_windows(1600, s) == [(0, 600), (500, 1100), (1000, 1600)] and token_windows(0, s) == []


def test_ingest_decisions_follow_path_order(spark):
    new = spark.createDataFrame([("a", "1", "p1"), ("a", "1", "p2"), ("a", "2", "p3"), ("b", "9", "p0"), ("c", "3", "p4")], "doc_id string, content_sha256 string, path string")
    old = spark.createDataFrame([("b", "9"), ("c", "x")], "doc_id string, content_sha256 string")
    got = {r.path: r.status for r in ingest.classify_ingest(new, old).collect()}
    assert got == {"p0": "skipped", "p1": "ingested", "p2": "skipped", "p3": "failed", "p4": "failed"}
    row = ingest.ingest_summary(ingest.classify_ingest(new, old)).first()
    assert (row.total, row.ingested, row.skipped, row.failed, row.by_error_code) == (5, 1, 2, 2, {"DUPLICATE_DOCUMENT": 2})


def test_feedback_log_quarantine(spark, tmp_path):
    ok = {"feedback_id": "f1", "query": "q", "user_rating": "negative", "feedback_type": "answer", "issue_category": "other", "timestamp": "2024-01-01T00:00:00Z"}
    lines = [json.dumps(ok), "{broken", json.dumps(ok | {"user_rating": "bad"}), "", json.dumps(ok | {"feedback_id": "f2", "review_status": "open"})]
    (tmp_path / "log.jsonl").write_text("\n".join(lines) + "\n")
    valid, corrupt = files.read_feedback(spark, str(tmp_path / "log.jsonl"))
    assert [(r.feedback_id, r.line_number, r.review_status) for r in valid.orderBy("line_number").collect()] == [("f1", 1, "open"), ("f2", 5, "open")]
    assert {(r.line_number, r.error_type) for r in corrupt.collect()} == {(2, "json_decode_error"), (3, "validation_error")}


def test_audit_is_redacted_and_versions_replace(spark, tmp_path):
    events = spark.createDataFrame([("e", {"text": "secret", "a": "b"})], "event_id string, metadata map<string,string>")
    files.write_audit(events, str(tmp_path / "audit"))
    assert "secret" not in "".join(p.read_text() for p in (tmp_path / "audit").glob("*.json"))
    files.write_versioned({"t": spark.range(2).toDF("id")}, str(tmp_path / "v"))
    files.write_versioned({"t": spark.range(5).toDF("id")}, str(tmp_path / "v"))
    assert files.read_versioned(spark, str(tmp_path / "v"), "t")["t"].count() == 5


def test_corpus_cases_and_reports_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("d", "x y z")], "doc_id string, content string")
    files.write_corpus({"chunks": ingest.chunks(docs)}, str(tmp_path))
    assert files.read_corpus(spark, str(tmp_path), "chunks")["chunks"].first().text == "x y z"
    doc = {"metadata": {"doc_id": "d", "title": "T"}, "content": "x y", "chunks": [{"chunk_id": "c1", "doc_id": "d", "text": "x", "metadata": {"section_title": "S", "chunk_index": 1}}]}
    (tmp_path / "p.json").write_text(json.dumps(doc))
    row = files.read_processed(spark, str(tmp_path / "p.json")).first()
    assert (row.chunk_id, row.title, row.section_title) == ("c1", "T", "S")
    (tmp_path / "cases.json").write_text(json.dumps({"dataset_version": "v", "cases": [{"case_id": "c-1", "query": "q"}]}))
    case = files.read_cases(spark, str(tmp_path / "cases.json")).first()
    assert (case.split, case.top_k) == ("core", 5)
    files.write_report(spark.createDataFrame([("r1", 0.5)], "run_id string, pass_rate double"), str(tmp_path / "h"))
    files.write_report(spark.createDataFrame([("r2", 0.7)], "run_id string, pass_rate double"), str(tmp_path / "h"))
    assert files.read_history(spark, str(tmp_path / "h")).count() == 2
    assert files.index_manifest(ingest.chunks(docs), 8).first().n_chunks == 1


def test_hashed_vectors_equal_a_plain_loop():
    """Every feature's digest, bucket and sign by hand; counts and unit length."""
    text = "Some words here, some_words-here again: ÉTÉ 12 12"
    low = text.lower()
    words, packed = re.findall(r"[a-z0-9]+(?:[-_][a-z0-9]+)*", low), " ".join(low.split())
    features = [f"tok:{w}" for w in words] + [f"bi:{a}_{b}" for a, b in zip(words, words[1:])] + [f"tri:{packed[i : i + 3]}" for i in range(len(packed) - 2)]
    for digest, make in (("blake2b", lambda f: hashlib.blake2b(f.encode(), digest_size=8).digest()), ("md5", lambda f: hashlib.md5(f.encode()).digest())):
        want = [0] * 384
        for f in features:
            d = make(f)
            want[(d[0] << 24 | d[1] << 16 | d[2] << 8 | d[3]) % 384] += -1 if d[4] % 2 else 1
        length = sum(x * x for x in want) ** 0.5
        assert hashed_vector(text, 384, {}, digest, unit=False).tolist() == want
        assert all(abs(a - b / length) < 1e-6 for a, b in zip(hashed_vector(text, 384, {}, digest), want))


def test_hashed_vectors():
    v = hashed_vector("Some words here", 64, {})
    assert abs(float(v @ v) - 1) < 1e-5 and not hashed_vector("", 64, {}).any()
    assert (hashed_vector("Some words here", 64, {}) == v).all()


def test_bad_bytes_and_odd_folders_are_no_failures(spark, tmp_path):
    top = tmp_path / "it's a (folder)"
    top.mkdir()
    (top / "good.md").write_bytes(b"\xef\xbb\xbftext \n")
    (top / "bad.txt").write_bytes(b"caf\xe9")
    (top / "blank.txt").write_bytes(b" \n")
    good, bad = files.read_raw(spark, str(top))
    assert [tuple(r) for r in good.collect()] == [("good.md", "text\n")]
    assert {tuple(r) for r in bad.collect()} == {("bad.txt", "INVALID_ENCODING"), ("blank.txt", "EMPTY_DOCUMENT")}


def test_roots_may_have_schemes_dots_and_blanks(spark, tmp_path, monkeypatch):
    top = tmp_path / "my raw files"
    (top / "sub dir").mkdir(parents=True)
    (top / "sub dir" / "a%20b+c.md").write_text("text")
    monkeypatch.chdir(tmp_path)
    for root in (str(top), f"{top}/", f"file://{top}", f"file:{top}", f"{tmp_path}/./my raw files", f"{tmp_path}/other/../my raw files//"):
        assert [r.path for r in files.read_raw(spark, root)[0].collect()] == ["sub dir/a%20b+c.md"], root
    with pytest.raises(ValueError, match="pattern"):
        files.read_raw(spark, f"{tmp_path}/my*")


def test_manifest_tells_what_changed(spark):
    chunks = lambda *rows: spark.createDataFrame(rows, "chunk_id string, text_sha256 string")
    old = files.index_manifest(chunks(("a", "1"), ("b", "2"), ("c", "3")), 8)
    new = files.index_manifest(chunks(("a", "1"), ("b", "9"), ("d", "4")), 8)
    assert {tuple(r) for r in files.manifest_changes(old, new).collect()} == {("b", "changed"), ("c", "removed"), ("d", "added")}
    assert files.manifest_changes(old, old).isEmpty()


def test_newest_whole_version_is_read_and_a_failed_one_is_not(spark, tmp_path):
    path = str(tmp_path / "index")
    for i in (1, 2):
        files.write_versioned({"t": spark.range(i)}, path)
    broken = spark.range(3).select(F.raise_error(F.lit("broken")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        files.write_versioned({"t": broken}, path)
    assert files.read_versioned(spark, path, "t")["t"].count() == 2


def test_corpus_is_written_over_what_it_reads(spark, tmp_path):
    path = str(tmp_path / "corpus")
    files.write_corpus({"a": spark.range(3)}, path)
    files.write_corpus({"a": files.read_corpus(spark, path, "a")["a"].where("id > 0")}, path)
    assert sorted(r.id for r in files.read_corpus(spark, path, "a")["a"].collect()) == [1, 2]
    broken = spark.range(3).select(F.raise_error(F.lit("broken")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        files.write_corpus({"a": broken}, path)
    assert files.read_corpus(spark, path, "a")["a"].count() == 2  # a crash leaves the table that was there
    for n in (4, 5, 6):
        files.write_corpus({"a": spark.range(n)}, path)
    assert files.read_corpus(spark, path, "a")["a"].count() == 6
    assert len([p for p in (tmp_path / "corpus" / "versions").iterdir() if any(p.rglob("*.parquet"))]) <= 3  # two whole ones, and what the crash left


def test_report_of_a_run_is_replaced(spark, tmp_path):
    path = str(tmp_path / "runs")
    for run, n in (("r1", 1), ("r2", 2), ("r1", 3)):
        files.write_report(spark.createDataFrame([(run, n)], "run_id string, total int"), path)
    assert {(r.run_id, r.total) for r in files.read_history(spark, path).collect()} == {("r1", 3), ("r2", 2)}


def test_upsert_takes_one_row_of_an_id(spark):
    schema = "doc_id int, content_sha256 string, ingested_at timestamp"
    rows = lambda *xs: spark.createDataFrame([(d, h, datetime.datetime(2024, 1, day)) for d, h, day in xs], schema)
    got = ingest.upsert_documents(rows((1, "a", 1), (2, "b", 1)), rows((1, "a", 5), (3, "c", 5), (3, "d", 6), (3, "d", 6)))
    assert sorted((r.doc_id, r.content_sha256, r.ingested_at.day) for r in got.collect()) == [(1, "a", 1), (2, "b", 1), (3, "d", 6)]


def test_parts_of_given_documents_only_are_replaced(spark):
    rows = lambda *xs: spark.createDataFrame(xs, "chunk_id string, doc_id string, more int")
    docs = spark.createDataFrame([("a",), ("a",), ("gone",)], "doc_id string")
    got = ingest.replace_parts(rows(("a1", "a", 1), ("a2", "a", 1), ("b1", "b", 1), ("g1", "gone", 1)).drop("more"), rows(("a9", "a", 2), ("b9", "b", 2)), docs)
    assert sorted(map(tuple, got.collect())) == [("a9", "a"), ("b1", "b")]


def test_long_lists_are_normalised_in_order(spark):
    xs = [" b", "A", "", "a ", None, "B", "c"] + [f"w{i % 500}" for i in range(5000)]
    got = spark.createDataFrame([(xs,), (None,), ([],)], "xs array<string>").select(X.normalize_list(F.col("xs")).alias("n")).collect()
    assert got[0].n == ["b", "A", "c"] + [f"w{i}" for i in range(500)] and got[1].n is None and got[2].n == []


def test_features_of_a_batch_are_not_all_remembered(monkeypatch):
    sizes, real = [], helpers.hashed_vector
    monkeypatch.setattr(helpers, "FEATURES", 100)
    monkeypatch.setattr(helpers, "hashed_vector", lambda text, dims, cache, *more: (sizes.append(len(cache)), real(text, dims, cache, *more))[1])
    texts = pd.Series([f"alpha{i} beta{i} gamma{i}" for i in range(200)] + [None])
    got = pd.concat(helpers.hashed_vectors(iter([texts]), 384, "md5", False))
    assert max(sizes) <= 100 and len(got) == 201
    assert all((v == real(t or "", 384, {}, "md5", False)).all() for t, v in zip(texts, got))


def test_rejected_files_are_listed_once_and_read_once(spark, tmp_path):
    for name, body in (("a.txt", b"good"), ("b.txt", b" \n"), ("c.txt", b"\xff\xfe"), ("d.bin", b"x"), ("e.md", b"y" * 30), ("f.bin", b"z" * 30)):
        (tmp_path / name).write_bytes(body)
    good, bad = files.read_raw(spark, str(tmp_path), Settings(max_file_bytes=20))
    assert [tuple(r) for r in good.collect()] == [("a.txt", "good\n")]
    assert dict(map(tuple, bad.collect())) == {"b.txt": "EMPTY_DOCUMENT", "c.txt": "INVALID_ENCODING", "d.bin": "UNSUPPORTED_FILE_TYPE", "e.md": "FILE_TOO_LARGE", "f.bin": "UNSUPPORTED_FILE_TYPE"}
    assert bad._jdf.queryExecution().sparkPlan().toString().count("FileScan binaryFile") == 2
