"""Quality rules, licences, n-gram quality, toxicity and mixing."""

import math
import random
import re
import textwrap
from collections import Counter

import pytest

from govdocs.llm import licenses, mixing, ngram_quality, quality_rules, toxicity

SCHEMA = "doc_id long, text string"
ODD = [None, "", " \n\t", "one two", "a b c d e a b c d e", "x y " * 30, "a b c d e f g h i j\na b c d e f g h i j\n", "# $ % & * | < >" * 5, "é ü the of and " * 4 + "end", "w" * 100_000, "a\n\na\n \na"]

TEMPLATE_LINE = licenses.TEMPLATES["apache-2.0"]
ALL_PAIRS = {p for t in licenses.TEMPLATES.values() for p in licenses.pairs_of(t)}


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_match_brute_force(spark, sf_dir):
    rows = list(enumerate(ODD)) + [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = quality_rules.quality_rules(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", words int")).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == {d: brute_rules(t) for d, t in rows}
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0


def test_quality_rules_keep_good_labels(spark):
    d = "/root/testdata/sf0.01"
    kept = quality_rules.quality_rules(spark.read.parquet(f"{d}/documents.parquet")).select("doc_id", "kept", "base_failed", "n_words")
    by = kept.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("n_words >= 10").groupBy("quality").agg({"kept": "count_if"}).collect()
    n = {r.quality: r.n for r in spark.read.parquet(f"{d}/labels.parquet").join(kept.where("n_words >= 10"), "doc_id").groupBy("quality").count().withColumnRenamed("count", "n").collect()}
    share = {r[0]: r[1] / n[r[0]] for r in by}
    assert share[1] > 0.97 and share[0] < 0.5


def test_license_lines(spark):
    rows = [
        (1, "Intro text.\nThis work is licensed under the GNU General Public License, version 3.\nmore"),
        (2, "licensed UNDER the  apache license,  version 2.0!"),
        (3, "We are licensed under nothing at all and the sky is blue"),
        (4, None), (5, ""), (6, "All rights reserved."), (7, "This work is licensed under the GNU General Public License, version 2 or 3."),
    ]
    got = licenses.license_scan(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA + ", line int")).collect()
    assert {(r.doc_id, r.line_no, r.license) for r in got} >= {(1, 1, "gpl-3.0"), (2, 0, "apache-2.0"), (6, 0, "reserved")}
    assert {r.doc_id for r in got} == {1, 2, 6, 7}

    def brute(line):
        ws = re.findall("[a-z0-9]+", line.lower())
        a = set(zip(ws, ws[1:]))
        best = None
        for name, text in licenses.TEMPLATES.items():
            ts = re.findall("[a-z0-9]+", text.lower())
            b = set(zip(ts, ts[1:]))
            score = 2 * len(a & b) / (len(a) + len(b)) if a else 0
            if score >= 0.8 and (best is None or (-score, name) < best):
                best = (-score, name)
        return best

    want = {(d, k, b[1], round(-b[0], 6)) for d, t in rows for k, line in enumerate((t or "").split("\n")) if (b := brute(line))}
    assert {tuple(r) for r in got} == want


def test_license_notices_beyond_whole_lines(spark):
    gpl = "This work is licensed under the GNU General Public License,"
    mit = licenses.bodies()["mit"]
    rows = [
        (1, "Released under the MIT License."), (2, "Licensed under CC BY-NC 4.0."), (3, f"x y\n{gpl}\nversion 3. And more"), (4, "a long line of words " * 40 + TEMPLATE_LINE + " and so on" * 50),
        (5, "// SPDX-License-Identifier: GPL-3.0-only"), (6, "SPDX-License-Identifier: none"), (7, "Copyright 2020\n\n" + "\n".join(textwrap.wrap(mit, 40)) + "\ncode"), (8, "All rights\nreserved by all"),
        (9, "mit der Lizenz und unter dem Titel"), (10, "one.\n" + licenses.bodies()["gpl-2.0"] + "\n\n" + mit),
    ]
    got = {(r.doc_id, r.line_no, r.license) for r in licenses.license_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    last = rows[-1][1].count("\n", 0, rows[-1][1].index("Permission is hereby granted, free"))
    assert got == {(1, 0, "mit"), (2, 0, "cc-by-nc-4.0"), (3, 1, "gpl-3.0"), (4, 0, "apache-2.0"), (5, 0, "gpl-3.0"), (7, 2, "mit"), (8, 0, "reserved"), (10, 1, "gpl-2.0"), (10, last, "mit")}


@pytest.mark.parametrize("short,long,version", [("gpl", "General", "2.0"), ("gpl", "General", "3.0"), ("lgpl", "Lesser General", "2.1"), ("lgpl", "Lesser General", "3.0"), ("agpl", "Affero General", "3.0")])
def test_notices_of_the_gnu_licences(short, long, version):
    """As printed, wrapped, behind comment marks, in prose, with another noun; with and without the later versions."""
    finder = licenses.Finder(licenses.TEMPLATES, licenses.bodies(), licenses.short_forms(), 0.8)
    for later, suffix in ((True, "or-later"), (False, "only")):
        which = f"either version {version.removesuffix('.0')} of the License, or\n(at your option) any later version." if later else f"version {version.removesuffix('.0')} of the License."
        notice = f"This {{}} is free software; you can redistribute it and/or\nmodify it under the terms of the GNU {long} Public License\nas published by the Free Software Foundation; {which}"
        for text in (notice.format("program"), notice.format("library"), "Copyright (C) 2020 someone\n\n" + notice.format("program") + "\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.", " * " + notice.format("program").replace("\n", "\n * "), "prose before. " + notice.format("program").replace("\n", " ") + " prose after."):
            assert [x[1] for x in finder.find(text)] == [f"{short}-{version}-{suffix}"], text


def test_titles_alternatives_and_other_notices():
    finder = licenses.Finder(licenses.TEMPLATES, licenses.bodies(), licenses.short_forms(), 0.8)
    find = lambda t: sorted(x[1] for x in finder.find(t))
    assert find("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/") == ["apache-2.0"]
    for text in ("license = \"MIT OR Apache-2.0\"", "Licensed under either of the MIT License or the\nwords", "SPDX-License-Identifier: MIT OR Apache-2.0", "dual: Apache 2.0 or MIT.", "You may use it under the MIT License or Apache License, Version 2.0, as you like"):
        assert find(text) == (["mit"] if "words" in text else ["apache-2.0", "mit"]), text
    assert find("we came with the committee or not, and mit or ohne") == []
    assert find("Distributed under the Boost Software License, Version 1.0. (See\naccompanying file LICENSE_1_0.txt or copy at\nhttps://www.boost.org/LICENSE_1_0.txt)") == ["bsl-1.0"]
    assert find("This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/") == ["epl-2.0"]
    assert find("under EPL 2.0") == ["epl-2.0"] and find("BSD-3-Clause or GPLv2") == ["bsd-3-clause", "gpl-2.0"]


def test_license_windows_match_brute_force():
    """Every window of every size is scored; the finder reaches the same best coefficient, and passes over no text that holds one."""
    rng = random.Random(1)
    finder = licenses.Finder(licenses.TEMPLATES, {}, {}, 0.8)
    for _ in range(12):
        ws = licenses.words_of(licenses.TEMPLATES[rng.choice(sorted(licenses.TEMPLATES))])
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(ws))
            ws[at : at + 1] = rng.choice([[], ["other"], [ws[at], "more"]])
        text = " ".join(["some", "text", "before"] * 20 + ws + ["and", "after", "it"] * 20)
        pairs = licenses.pairs_of(text)
        best = 0.0
        for a in range(len(pairs)):
            for b in range(a + 1, min(len(pairs), a + 45) + 1):
                own = set(pairs[a:b])
                best = max(best, *(2 * len(own & set(licenses.pairs_of(t))) / (len(own) + len(set(licenses.pairs_of(t)))) for t in licenses.TEMPLATES.values())) if own & ALL_PAIRS else best
        got = [d for _, _, d in finder.find(text)]
        assert bool(got) == (best >= 0.8) and (not got or max(got) <= best + 1e-9)


def brute_scan(text, templates):
    """Whole lines and every window of every size, chosen as license_scan says."""
    ws, starts = [], []
    for line in text.lower().split("\n"):
        starts.append(len(ws))
        ws += re.findall("[a-z0-9]+", line)
    pairs = list(zip(ws, ws[1:]))
    sets = {k: set(zip(t, t[1:])) for k, v in templates.items() for t in [re.findall("[a-z0-9]+", v.lower())]}
    line_of = lambda i: max(k for k, s in enumerate(starts) if s <= i)
    lines, found = [], []
    for a, b in zip(starts, [s - 1 for s in starts[1:]] + [len(ws) - 1]):
        own = set(pairs[a:b])
        if own:
            dice, name = min((-2 * len(own & s) / (len(own) + len(s)), k) for k, s in sets.items())
            if dice <= -0.8:
                lines.append((-len(own & sets[name]), dice, name, a, b))
    for name, s in sets.items():
        for a in range(len(pairs)):
            if pairs[a] in s:
                best, own, shared = None, set(), 0
                for b in range(a, min(len(pairs), a + 3 * len(s))):
                    shared += pairs[b] in s and pairs[b] not in own
                    own.add(pairs[b])
                    dice = 2 * shared / (len(own) + len(s))
                    if best is None or dice > best[0]:
                        best = (dice, shared, b + 1)
                if best[0] >= 0.8 and not any(x[3] <= a and best[2] <= x[4] for x in lines):
                    found.append((-best[1], -best[0], name, a, best[2]))
    out, taken = [], []
    for _, lost, name, a, b in sorted(lines + found):
        if all(b < x or y < a for x, y in taken):
            taken.append((a, b))
            out.append((line_of(a), name, round(-lost, 6)))
    return sorted(out)


def test_license_scan_matches_brute_force(spark, sf_dir):
    rng, rows = random.Random(2), []
    docs = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r.text]
    for i, text in enumerate(docs):
        ws = text.split(" ")[:60]
        if i % 2:
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = rng.choice(sorted(licenses.TEMPLATES.values())).replace(" ", rng.choice([" ", "\n", "  "])).split(" ")
        rows.append((i, " ".join(ws)))
    rows += [(1000, None), (1001, ""), (1002, "All rights reserved.\nAll rights reserved."), (1002, "x"), (1003, " ".join(f"w{i}" for i in range(60_000)) + " " + TEMPLATE_LINE)]
    got = {}
    for r in licenses.license_scan(spark.createDataFrame([(*r, "z") for r in rows], SCHEMA + ", license string"), texts={}, forms={}).collect():
        got.setdefault(r.doc_id, []).append((r.line_no, r.license, r.dice))
    for d, t in rows[:-1]:
        assert sorted(got.get(d, [])) == (brute_scan(t or "", licenses.TEMPLATES) or (sorted(got.get(d, [])) if d == 1002 else [])), (d, t)
    assert got[1003] == [(0, "apache-2.0", 1.0)] and len(got[1002]) == 2


def test_license_scan_without_templates_or_rows(spark):
    docs = spark.createDataFrame([(1, TEMPLATE_LINE), (2, None)], SCHEMA)
    assert licenses.license_scan(docs, {}, texts={}, forms={}).count() == 0
    assert [r.license for r in licenses.license_scan(docs, {}).collect()] == ["apache-2.0"]
    assert licenses.license_scan(docs.limit(0)).count() == 0


def test_license_prefilter_loses_no_template():
    finder = licenses.Finder(licenses.TEMPLATES, licenses.bodies(), licenses.short_forms(), 0.8)
    assert [f for f, k in licenses.short_forms().items() if [x[1] for x in finder.find(" ".join(f))] != [k]] == []
    assert {k: finder.find("before\n" + t)[0][1:] for k, t in licenses.bodies().items()} == {k: (k, 1.0) for k in licenses.bodies()}


def brute_kneser_ney(texts):
    """P of a trigram from plain dictionaries; a boundary is NUL."""
    seq = ["\0\0" + re.sub(r"[\x20\x09-\x0D]", " ", t.lower()) for t in texts]
    tri = Counter(s[i : i + 3] for s in seq for i in range(len(s) - 2))
    bi = Counter(g[1:] for g in tri)
    uni = Counter(g[1:] for g in bi)

    def cuts(counts):
        k = [0] + [sum(n == i for n in counts.values()) for i in range(1, 5)]
        y = k[1] / (k[1] + 2 * k[2]) if k[1] + 2 * k[2] else None
        out = []
        for i in range(1, 4):
            d = i - (i + 1) * y * k[i + 1] / k[i] if y is not None and k[i] else 0.5 * i
            out.append(min(max(d, 0.05), float(i)))
        return lambda n: out[min(n, 3) - 1]

    d3, d2, d1 = cuts(tri), cuts(bi), cuts(uni)
    p1_total = sum(uni.values())
    back1 = sum(d1(n) for n in uni.values()) / p1_total
    p1 = lambda c: (max(uni[c] - d1(uni[c]), 0) / p1_total if uni[c] else 0) + back1 / (len(uni) + 1)

    def higher(counts, cut, lower):
        by_context = {}
        for g, n in counts.items():
            by_context.setdefault(g[:-1], []).append(n)

        def p(g):
            held = by_context.get(g[:-1])
            if not held:
                return lower(g[1:])
            own = (counts[g] - cut(counts[g])) / sum(held) if counts[g] else 0
            return own + sum(map(cut, held)) / sum(held) * lower(g[1:])

        return p

    return higher(tri, d3, higher(bi, d2, p1))


def brute_perplexity(p, text):
    s = "\0\0" + re.sub(r"[\x20\x09-\x0D]", " ", text.lower())
    return math.exp(-math.fsum(math.log(p(s[i : i + 3])) for i in range(len(s) - 2)) / (len(s) - 2))


@pytest.mark.parametrize("group_docs", [4, 4096])
def test_perplexity_quantiles_and_verdict_match_brute_force(spark, sf_dir, monkeypatch, group_docs):
    """Every document's perplexity, its language's quantiles and kept; characters and languages without a cap."""
    monkeypatch.setattr(ngram_quality, "GROUP_DOCS", group_docs)
    monkeypatch.setattr(ngram_quality, "SALT_GROUPS", 2 if group_docs == 4 else 32)
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()][:: 4 if group_docs == 4 else 1]
    rows += [(10_000 + i, f"日本語のテスト {i} 漢字 Привет {chr(0x4E00 + i)}" * 3, "ja") for i in range(40)] + [(20_000, "new language ñ 😀 ab", "zz"), (20_001, "no language at all", None), (20_002, None, "en"), (20_003, "", "en"), (20_004, "a" * 70_000, "en"), (20_005, "the same", "en"), (20_005, "the same", "en")]
    trusted = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()} | set(range(10_000, 10_030)) | {20_001, 20_003}
    labels = spark.createDataFrame([(d, 1) for d in sorted(trusted)] + [(None, 1)], "doc_id long, quality int")
    frame = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA + ", lang string, batch int, model string").repartition(3)
    got = ngram_quality.ngram_quality(frame, labels, 0.1, 0.9).collect()
    assert len(got) == len(rows)
    trusted = {d for d in trusted if not toxicity.held_out(d)}
    good = [(t, lang) for d, t, lang in rows if d in trusted and t]
    models = {lang: brute_kneser_ney([t for t, x in good if x == lang]) for lang in {x for _, x in good if x}}
    every = brute_kneser_ney([t for t, _ in good])
    perplexity = {d: brute_perplexity(models.get(lang, every), t) if t else None for d, t, lang in rows}
    quantiles = {}
    for lang in [*models, None]:
        xs = sorted(perplexity[d] for d, t, x in rows if d in trusted and t and (lang is None or x == lang))
        quantiles[lang] = [xs[max(0, math.ceil(q * len(xs)) - 1)] for q in (0.1, 0.9)]
    for r in got:
        want = perplexity[r.doc_id]
        assert (r.perplexity is None) == (want is None)
        q = quantiles[r.lang if r.lang in models else None]
        assert math.isclose(r.least, q[0], rel_tol=1e-6) and math.isclose(r.most, q[1], rel_tol=1e-6), (r, q)
        assert want is None and not r.kept or want is not None and math.isclose(r.perplexity, want, rel_tol=1e-6), (r, want)
        assert r.kept == (want is not None and q[0] * (1 - 1e-8) <= want <= q[1] * (1 + 1e-8))


def test_ngram_quality_separates_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = ngram_quality.ngram_quality(docs, labels).join(labels, "doc_id").where(ngram_quality.held_out_column()).collect()
    good, bad = ([r for r in rows if r.quality == q] for q in (1, 0))
    assert sum(r.kept for r in good) > 0.9 * len(good) and sum(r.kept for r in bad) < 0.6 * len(bad)


def test_ngram_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", 1), (2, "", None, 2), (3, "some text here", "en", 3), (3, "some text here", "qq", 3), (None, "some", None, 0)], SCHEMA + ", lang string, q int")
    labels = spark.createDataFrame([(3, 1, 0), (1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = ngram_quality.ngram_quality(docs, labels).collect()
    assert len(got) == 5 and sum(r.kept for r in got) >= 1 and not any(r.kept for r in got if r.n_symbols == 0)
    assert ngram_quality.ngram_quality(docs, labels.limit(0)).where("kept").count() == 0
    assert ngram_quality.ngram_quality(docs.limit(0), labels).count() == 0


def test_grammar_composes_negation_report_and_targets():
    g = toxicity.Grammar({"moron": 1.0, "scum": 1.0}, {"idio": 1.0})
    total = lambda t: g.features(t)[1]
    assert total("the weather is fine") == 0
    assert total("You are a moron.") > total("A moron.") > 0
    assert 0 < total("You are not a moron.") < total("You are a moron.")
    assert 0 < total("He said you moron.") < total("You moron.")
    assert total("I will kill you moron.") > total("You moron.")
    assert total("Idiotic scum.") > total("Scum.")
    assert total("He said hello. You moron.") == total("You moron.")
    assert len(toxicity.MACHINE) > 10


def brute_clause(symbols):
    """The five rules one by one, by looking back over the clause."""
    total = 0.0
    for i, (kind, weight) in enumerate(symbols):
        if not weight:
            continue
        kinds = [k for k, _ in symbols[:i]]
        added = 0.5 if kind == "insult" and "insult" in kinds else 0.0
        if "threat" in kinds and "target" in kinds[kinds.index("threat") :]:
            added += 1.0 if kind == "insult" else 0.5
        added += 0.5 if "target" in kinds[-6:] else 0.0
        total += (weight + added) * (0.5 if "negation" in kinds[-3:] else 1.0) * (0.5 if "report" in kinds[-8:] else 1.0)
    return total


def test_composed_machine_matches_the_rules_one_by_one():
    rng = random.Random(5)
    for _ in range(3000):
        kinds = [rng.choice(toxicity.SYMBOLS[:-1]) for _ in range(rng.randint(0, 25))]
        clause = [(k, round(rng.random() + 0.1, 3) if k in ("insult", "threat") else 0.0) for k in kinds]
        assert math.isclose(toxicity.clause_weight(clause), brute_clause(clause), abs_tol=1e-9), clause


def brute_toxicity(rows, labels):
    """Scores from plain loops: vocabulary, clauses, features and the logistic of the fitted rows."""
    toxic = {}
    for d, y in labels:
        if d is not None and y is not None and not toxicity.held_out(d):
            toxic[d] = max(y, toxic.get(d, 0))
    train = [(t or "", toxic[d]) for d, t in rows if d in toxic]
    n = Counter(y for _, y in train)
    counts = Counter()
    for t, y in train:
        words = {w for w in toxicity.WORDS.findall(t.lower()) if w not in toxicity.BREAKS}
        counts.update((e, y) for e in words | {w[:k] + "*" for w in words for k in range(4, 8) if len(w) > k})
    vocabulary = {}
    for e in {e for e, _ in counts}:
        ratio = (counts[e, 1] + 0.5) / (n[1] + 1) / ((counts[e, 0] + 0.5) / (n[0] + 1))
        if counts[e, 1] >= max(3, 0.02 * n[1]) and ratio >= 6:
            vocabulary[e] = math.log(ratio) / 4

    def features(text):
        clauses = [[]]
        for token in toxicity.WORDS.findall(text.lower()):
            if token in toxicity.BREAKS:
                clauses.append([])
                continue
            weight = max([vocabulary.get(token, 0.0)] + [vocabulary.get(token[:k] + "*", 0.0) for k in range(4, len(token) + 1)])
            kind = "insult" if weight else toxicity.CLASSES.get(token, "other")
            clauses[-1].append((kind, weight or (toxicity.THREAT_WEIGHT if kind == "threat" else 0.0)))
        sums = [w for w in map(brute_clause, clauses) if w > 0]
        return round(max(sums, default=0.0), 3), round(sum(sums), 3), round(math.log1p(sum(map(len, clauses))), 3)

    weights = toxicity.logistic([toxicity.inputs(*features(t)) for t, _ in train], [y > 0 for _, y in train])
    z = lambda f: max(-30.0, min(30.0, sum(w * x for w, x in zip(weights, toxicity.inputs(*f)))))
    return [(d, 1 / (1 + math.exp(-z(features(t or ""))))) for d, t in rows]


def test_toxicity_matches_brute_force(spark):
    d = "/root/testdata/sf0.01"
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{d}/labels.parquet").collect()] + [(None, 1), (7_000_001, None)]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    rows += [(7_000_000, None), (7_000_001, ""), (7_000_002, "long text of many words. " * 20_000), (7_000_003, "twice the same"), (7_000_003, "twice the same"), (None, "no id")]
    docs = spark.createDataFrame([(*r, 0.1) for r in rows], SCHEMA + ", score double").repartition(5)
    got = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for a, (doc, score) in zip(sorted([(r.doc_id, r.score) for r in got], key=key), sorted(brute_toxicity(rows, labels), key=key), strict=True):
        assert a[0] == doc and math.isclose(a[1], score, abs_tol=1e-6)
    assert all(r.predicted == (r.score >= 0.5) and r.held_out == toxicity.held_out(r.doc_id) for r in got)


@pytest.fixture(scope="module")
def toxic_tables(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    return spark.read.parquet(f"{d}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi"), labels


def test_toxicity_on_held_out_rows(spark, toxic_tables):
    docs, labels = toxic_tables
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    bad, good = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]
    area = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    assert area > 0.95 and sum(r.predicted for r in rows if r.toxic == 0) <= 0.01 * len(good) + 1
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_toxicity_never_learns_from_held_out_rows(spark):
    texts = [(i, f"clean words number {i}") for i in range(60)] + [(1000 + i, "utter zorgblatt zorgblatt") for i in range(60)]
    docs = spark.createDataFrame(texts, SCHEMA)
    labels = spark.createDataFrame([(d, 1, int(d >= 1000)) for d, _ in texts if d < 1000 or toxicity.held_out(d)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs, labels).words == {}


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0, 1), (None, 0, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, None, 0.5), (1, "", 0.5), (None, "you moron", 0.5)], SCHEMA + ", score double")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 3 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def brute_share(parent, caps, weights):
    got, names, left = {}, sorted(caps, key=lambda n: (caps[n] / weights[n], n)), parent
    open_weight = sum(weights.values())
    for k, n in enumerate(names):
        if caps[n] * open_weight <= left * weights[n]:
            got[n] = caps[n]
            left -= caps[n]
            open_weight -= weights[n]
        else:
            got |= {m: weights[m] * left // open_weight for m in names[k:]}
            break
    return got


def test_shortages_go_to_siblings_first(spark):
    leaves = [("a", "en", "s1", 10), ("a", "en", "s2", 1000), ("a", "fr", "s3", 1000), ("b", "en", "s4", 5), ("b", "fr", "s5", 5)]
    frame = spark.createDataFrame(leaves, "domain string, lang string, source string, avail long")
    got = {r.source: r.budget for r in mixing.leaf_budgets(frame, {"domain": {"a": 1, "b": 1}}, 600, 1).collect()}
    top = brute_share(600, {"a": 2010, "b": 10}, {"a": 1, "b": 1})
    assert top == {"b": 10, "a": 590}
    assert got == {"s4": 5, "s5": 5, "s1": 10, "s2": 285, "s3": 295}


def test_mix_takes_prefixes_of_whole_documents(spark):
    rows = [(i, "w " * (i % 7 + 1), "en", "src1") for i in range(200)] + [(1000, "w w", None, None), (None, None, "fr", "src2"), (2000, "a b c", "fr", "src2")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", lang string, source string, copies string")
    total = sum(len((r[1] or "").split()) for r in rows)
    for fraction, epochs in ((0.3, 1), (0.95, 2), (1.7, 2), (0.0, 1)):
        got = mixing.mix(docs, mixing.source_domain(), mixing.WEIGHTS, fraction, epochs).collect()
        assert len(got) == len(rows)
        assert sum(r.copies * r.n_tokens for r in got) <= int(total * fraction)
        assert sum(r.copies * r.n_tokens for r in got) >= int(total * fraction) - 7 * 4
    assert mixing.mix(docs.limit(0), mixing.source_domain(), mixing.WEIGHTS, 0.5).count() == 0
