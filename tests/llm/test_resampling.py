"""Importance resampling against plain counting, runs of words against their joined text, odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from govdocs.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def buckets_of(text, runs, buckets):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode("utf-8", "surrogatepass")) % buckets for n in range(1, runs + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, percent, least_words, runs, buckets):
    feats = [(i, buckets_of(t, runs, buckets), len(words_of(t))) for i, t in docs]
    s, t = Counter(b for _, f, _ in feats for b in f), Counter(b for x in target for b in buckets_of(x, runs, buckets))
    ss, tt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in range(buckets)]
    out = []
    for i, f, n in feats:
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in out]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("runs,buckets,block", [(1, 10_000, 1 << 22), (3, 70_000, 1 << 14)])
def test_whole_tables_and_odd_rows(spark, sf_dir, monkeypatch, runs, buckets, block):
    monkeypatch.setattr(resampling, "BLOCK", block)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "a" * 3000 + " b " + "é" * 1500 + " a"), (10**6 + 2, "!?\0\x7f"), (None, "Wörter 12 " * 30), (7, "same " * 25), (7, "same " * 25), (10**6 + 3, "of the long " * 100_000)]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()] + [None]
    df = spark.createDataFrame([(i, t, "s", 1.0) for i, t in docs], "doc_id long, text string, features string, score double").repartition(3)
    got = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), runs=runs, buckets=buckets).collect()
    assert ordered(got) == ordered(plain(docs, target, 10, 20, runs, buckets))


def test_ties_empty_tables_and_empty_target(spark):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(spark.createDataFrame([], "doc_id long, text string"), none).collect() == []
    docs = [(3, "x " * 30), (3, "x " * 30), (2, "y " * 30), (None, "z " * 30)]
    got = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string"), none, percent=100).collect()
    assert ordered(got) == ordered(plain(docs, [], 100, 20, 1, 10_000)) and sorted(r["rank"] for r in got) == [1, 2, 3, 4]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab1é日", min_size=1, max_size=40), max_size=8), st.integers(1, 4))
def test_crcs_of_runs_follow_from_their_words(words, most):
    payloads = np.array([resampling.payload(w.encode()) for w in words], dtype="int64")
    want = [[zlib.crc32(" ".join(words[i : i + n]).encode()) for i in range(len(words) - n + 1)] for n in range(1, most + 1)]
    got = [c.tolist() for c in resampling.run_crcs(payloads, most)]
    assert got == [w for k, w in enumerate(want) if not k or w]


def test_automaton_finds_words_between_delimiters_only():
    got = list(resampling.scanned([b"ab a  abab b", b"", b"c" * 2000 + b" a"]))
    assert [g.tolist() for g in got] == [[resampling.payload(w) for w in s] for s in ([b"ab", b"a", b"abab", b"b"], [], [b"c" * 2000, b"a"])]
