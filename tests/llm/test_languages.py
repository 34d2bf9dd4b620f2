"""Language filters against sets of n-grams, held-out accuracy, odd rows."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from govdocs.llm import languages

SCHEMA = "doc_id long, text string, lang string, score string"


def letters_of(text):
    return " " + " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split()) + " "


def grams_of(text, sizes):
    body = letters_of(text)
    return [body[i : i + n] for n in sizes for i in range(len(body) - n + 1)] if body.strip() else []


def held(doc_id):
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % 4 == 2


def plain(rows, sizes, least, part):
    """(doc_id, lang_pred, score) with sets in place of filters."""
    counts = defaultdict(Counter)
    for i, t, lang in rows:
        if lang is not None and not held(i):
            counts[lang].update(grams_of(t, sizes))
    share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    most = Counter()
    for of in share.values():
        for g, s in of.items():
            most[g] = max(most[g], s)
    sets = {lang: {g for g, s in of.items() if s >= least and s >= part * most[g]} for lang, of in share.items()}
    out = []
    for i, t, _ in rows:
        hits = {lang: sum(g in s for g in grams_of(t, sizes)) for lang, s in sorted(sets.items())}
        best = max(hits, key=hits.get)
        out.append((i, best, hits[best] / max(1, sum(hits.values()))))
    return out


def test_predictions_equal_sets_of_grams(spark, sf_dir):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: r for r in languages.identify(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)).collect()}
    assert len(got) == len(rows)
    for i, best, score in plain(rows, (2, 3), 1e-5, 0.5):
        assert got[i].lang_pred == best and abs(got[i].score - score) < 0.02 and got[i].held_out == held(i)


def test_held_out_documents_are_named_right(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = languages.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 200 and np.mean([r.lang == r.lang_pred for r in got]) >= 0.98


def test_odd_rows(spark):
    rows = [(i, f"der hund und die katze {i}", "de") for i in range(40)] + [(i, f"le chien et la souris {i}", "fr") for i in range(40, 80)] + [(i, "日本語の文章です", "ja") for i in range(80, 100)]
    rows += [(200, None, "de"), (201, "", "fr"), (202, "12 !? \n", "de"), (203, "qqqq", None), (203, "die katze", None), (None, "la souris", "fr"), (204, "文章", None), (205, "DER HUND. " * 200_000, None)]
    got = languages.identify(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(2)).collect()
    of = defaultdict(list)
    for r in got:
        of[r.doc_id].append((r.lang_pred, r.score))
    assert len(got) == len(rows) and [of[i] for i in (200, 201, 202)] == [[("und", 0.0)]] * 3
    assert sorted(x for x, _ in of[203]) == ["de", "de"] and min(s for _, s in of[203]) == 0.0  # qqqq: no language has it
    assert of[None][0][0] == "fr" and of[204][0][0] == "ja" and of[205][0][0] == "de" and all(0 <= r.score <= 1 for r in got)
    assert languages.identify(spark.createDataFrame([], SCHEMA)).collect() == []
    assert {(r.lang_pred, r.score) for r in languages.identify(spark.createDataFrame([(0, "text", None, "x")], SCHEMA)).collect()} == {("und", 0.0)}


@pytest.mark.parametrize("cut", [40, 1 << 19])
def test_pieces_of_a_text_have_its_grams(monkeypatch, cut):
    monkeypatch.setattr(languages, "PIECE", cut)
    text = "Ein längerer Satz, mit Zahlen 12 und " * 5 + "einemsehrlangenwort" * 6 + " ...  ende!"
    for n in (2, 3):
        block = [(0, c, k) for c, k in languages.code_pieces(text, 2)]
        joined = np.concatenate([c for _, c, _ in block])
        at = [i for _, a, b in languages.spans(block, n) for i in range(a, b)]
        got = Counter("".join(map(chr, joined[i : i + n])) for i in at)
        assert got == Counter(grams_of(text, (n,)))


@pytest.mark.parametrize("dense", [0, 1 << 22])
def test_numbers_of_grams(monkeypatch, dense):
    monkeypatch.setattr(languages, "DENSE", dense)
    codes = np.array([ord(c) for c in "abcabcab日本abc"])
    place, grams = languages.numbered(codes, 3)
    windows = [tuple(codes[i : i + 3]) for i in range(len(codes) - 2)]
    assert len(set(grams.tolist())) == len(set(windows)) == len(grams)
    assert [int(languages.named(np.array([w]), 3)[0]) for w in windows] == grams[place].tolist()


def test_filter_keeps_all_members_and_few_others(spark):
    rng, size = np.random.default_rng(1), 1 << 13
    member, other = rng.integers(-(1 << 62), 1 << 62, 500), rng.integers(-(1 << 62), 1 << 62, 20_000)
    table = np.zeros((size, 1), dtype="uint64")
    for at in languages.places(member, size):
        table[at, 0] |= np.uint64(5)
    f = languages.Filters(["a", "b", "c"], table, [float((table[:, 0] & np.uint64(1)).mean())], "a")
    assert (f.containing(member)[:, 0] == 5).all()
    hit = (f.containing(other)[:, 0] == 5).mean()
    assert abs(hit - f.full[0] ** languages.PROBES) < 0.004
    assert abs(languages.corrected(np.array([[1000 * hit + 200]]), np.array([1200.0]), f.full)[0, 0] - 200) < 10
