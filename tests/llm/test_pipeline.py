"""The pipeline's stages against brute force on small tables, and on odd rows."""

import hashlib
import re

import corpus_pipeline
import pytest
import xxhash
from pyspark.sql import functions as F
from test_copies import brute_stays
from test_filters import brute_share
from test_near_copies import brute_kept

from govdocs.llm import mixing, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length int, gid string, comp long, copies int"
NAMES = [n for n, _ in corpus_pipeline.STAGES]


def odd_documents():
    base = [f"word{i}" for i in range(60)]
    near = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(0, 60, 9)]
    rows = [(i, t, "en", "src1") for i, t in enumerate(near)]
    rows += [(100, "a b c", "fr", "src2"), (100, "a  b c", "fr", "src2"), (100, "quite another text", "fr", "src2"), (101, "abc", "fr", "src2"), (102, None, None, None), (103, "", "de", "src3"), (None, "no id here", "es", "src4"), (None, "no id here", "es", "src4")]
    rows += [(200, "the same row", "en", "src5")] * 5 + [(300 + i, f"own{i} text{i} number{i} of{i} some{i} words{i} " * (i % 5 + 1), ["en", "de"][i % 2], f"src{i % 6}") for i in range(60)]
    rows += [(400, "very long text " * 40_000, "en", "src1")]
    return [(*r, 1, 2, "x", 3, 4) for r in rows]


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(odd_documents(), SCHEMA).repartition(4).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (100, 1, 0), (None, 0, 1), (300, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top


def test_names():
    assert NAMES == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"] and corpus_pipeline.ORACLE_SQL is None


def test_toxicity_stage_drops_what_is_predicted(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    one = corpus_pipeline.drop_toxic(spark, docs, d)
    want = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 0").collect()}
    assert one.columns == docs.columns and {r.doc_id for r in one.select("doc_id").collect()} == want and len(want) < docs.count()


def brute_mixed(rows, fraction=0.9):
    """(doc_id, text) of the rows that stay, by plain loops."""
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    number = lambda s: int(m[1]) if (m := re.search("([0-9]+)$", s or "")) else 0
    leaf = lambda r: (f"domain{number(r[3]) % 4}", r[2] or "", r[3] or "")
    avail = {}
    for r in rows:
        avail[leaf(r)] = avail.get(leaf(r), 0) + words(r[1])
    budgets = {(): int(sum(avail.values()) * fraction)}
    for k, level in enumerate(mixing.LEVELS):
        caps = {}
        for x, n in avail.items():
            caps[x[: k + 1]] = caps.get(x[: k + 1], 0) + n
        for parent in {x[:k] for x in avail}:
            own = {x: n for x, n in caps.items() if x[:k] == parent}
            weight = {x: mixing.WEIGHTS[level].get(x[-1], 1) for x in own}
            budgets |= brute_share(budgets[parent], own, weight)
    stays = set()
    for x, total in avail.items():
        whole = min(1, budgets[x] // total) if total else 1
        part, run = budgets[x] - whole * total, 0
        body = lambda t: int.from_bytes(xxhash.xxh64_digest((t or "").encode(), seed=42), "big") - (1 << 64) * (xxhash.xxh64_digest((t or "").encode(), seed=42)[0] >> 7)
        order = lambda r: (hashlib.md5(f"7-{whole + 1}-{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, words(r[1]), body(r[1]))
        for r in sorted((r for r in rows if leaf(r) == x), key=order):
            run += words(r[1])
            if whole or run <= part:
                stays.add((r[0], r[1]))
    return [(r[0], r[1]) for r in rows if (r[0], r[1]) in stays]


def test_stages_match_brute_force_on_odd_rows(spark, odd_dir):
    rows = odd_documents()
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    two = corpus_pipeline.drop_exact(spark, docs, odd_dir)
    got = [(r.doc_id, len(r.text or ""), re.sub(r"[\x20\x09-\x0D]", "", r.text or "")) for r in two.collect()]
    assert two.columns == docs.columns and len(got) == len(set(got)) and set(got) == brute_stays([r[:2] for r in rows])
    three = corpus_pipeline.drop_near(spark, docs, odd_dir)
    unique = list(dict.fromkeys((r[0] if r[0] is not None else 1 << 40, r[1]) for r in rows))
    kept = [r.doc_id if r.doc_id is not None else 1 << 40 for r in three.collect()]
    assert three.columns == docs.columns and sorted(kept) == sorted([*brute_kept(unique), 100])  # two texts of one doc_id
    four = corpus_pipeline.mix_sources(spark, docs, odd_dir)
    show = lambda xs: sorted(map(repr, xs))
    assert four.columns == docs.columns and show((r.doc_id, r.text) for r in four.collect()) == show(brute_mixed(rows))


def test_run_on_odd_and_empty_tables(spark, odd_dir, tmp_path):
    out = corpus_pipeline.run(spark, odd_dir)
    assert out.where("length > 2048").count() == 0 and out.where("doc_id = 200").count() <= 1 and out.count() > 50
    for name in ("documents", "labels"):
        spark.read.parquet(f"{odd_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_packs_what_is_left(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns[:3] == ["doc_id", "piece", "start"]
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert out.where("piece = 0").count() > 100
