"""Exact and near duplicates against brute force on small tables."""

import re
from hashlib import sha256

import pytest
import xxhash

from govdocs.llm import exact_dedup, simhash
from govdocs.llm.common import Scratch
from govdocs.llm.components import connected_components

SCHEMA = "doc_id long, text string"
LONG = "lorem ipsum dolor " * 9000


def odd_rows():
    rows = [(1, "aaa"), (2, "a a a"), (1, "bbbb"), (3, "bbbb"), (None, "cc"), (None, "c c"), (None, "ddd"), (None, "ddd"), (5, "x" * 900), (6, "x" * 900), (5, "x" * 899 + "y"), (7, "x" * 899 + "y"), (50, "q r"), (50, "qr"), (50, "q r")]
    rows += [(1, "a b c d e f g"), (2, "a  b c d e\tf g"), (3, None), (4, ""), (5, " \n"), (6, LONG), (7, LONG + "x"), (8, LONG), (9, "ab"), (9, "ab"), (None, "alone"), (None, "a b c d e f g")]
    return rows + [(100 + i, "the same words in every copy of this text") for i in range(60)] + [(300 + i, f"the same words in every copy of this text, {i} times, and a little more to it") for i in range(40)]


def brute_exact(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((d, t or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        out += [(d, keep[0], len(members), d == keep[0] and len(t) == len(keep[1]), sha256(norm.encode()).hexdigest()) for d, t in members]
    return sorted(out, key=repr)


def brute_stays(rows):
    """One (doc_id, text length, normalised text) for each group."""
    out = set()
    for norm in {re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows}:
        members = [(d, t or "") for d, t in rows if re.sub(r"[\x20\x09-\x0D]", "", t or "") == norm]
        d, t = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        out.add((d, len(t), norm))
    return out


def test_exact_duplicates_match_brute_force(spark):
    rows = odd_rows()
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA + ", kept string, digit string").repartition(5)
    got = exact_dedup.exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_exact(rows)


def test_drop_exact_duplicates_keeps_one_row_of_each_text(spark):
    rows = odd_rows()
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA + ", gid string, text_sha256 string").repartition(5)
    got = [(r.doc_id, len(r.text or ""), re.sub(r"[\x20\x09-\x0D]", "", r.text or "")) for r in exact_dedup.drop_exact_duplicates(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_stays(rows)
    same = spark.createDataFrame([(4, "one text")] * 40, SCHEMA).repartition(4)
    assert [tuple(r) for r in exact_dedup.drop_exact_duplicates(same).collect()] == [(4, "one text")]
    assert exact_dedup.drop_exact_duplicates(same.limit(0)).count() == 0


def test_exact_duplicates_of_an_empty_table(spark):
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_drop_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "ab", "y"), (3, "c", "z")], SCHEMA + ", gone_id string")
    assert sorted(map(tuple, exact_dedup.drop_exact_duplicates(docs).collect())) == [(1, "a b", "x"), (3, "c", "z")]


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    comp = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(comp[a], comp[b])
            if comp[a] != low or comp[b] != low:
                comp[a] = comp[b] = low
                changed = True
    return comp


@pytest.mark.parametrize("long_list", [1, 3, 64])
def test_near_duplicates_match_brute_force(spark, sf_dir, long_list):
    rows = [r for r in odd_rows() if r[0] is not None and r[0] > 9]
    rows += [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    prints = {d: brute_fingerprint(t) for d, t in rows}
    ids = sorted(prints)
    comp = brute_components(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2])
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), long_list=long_list).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{prints[d]:016x}", comp[d]) for d in ids}
    assert len(got) == len(rows)


@pytest.mark.parametrize("long_list", [1, 64])
def test_dense_fingerprints_lose_no_link(spark, tmp_path, long_list):
    values = sorted({(i * 0x9E3779B97F4A7C15 & 0xFF) | (i % 7) << 40 | 0xF << 60 for i in range(150)} | {1 << 63, (1 << 63) | 5, 7})
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    scratch = Scratch(spark, "test")
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), scratch, long_list)
    got = {r.node: r.comp for r in connected_components(edges, scratch).collect()}
    nodes = [v for v, in signed]
    want = brute_components(nodes, [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2])
    assert {n: got.get(n, n) for n in nodes} == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.comp for r in connected_components(edges, Scratch(spark, "test")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_near_duplicates_of_empty_and_repeated_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "x y z"), (1, "x y z"), (None, "x y z"), (3, None), (2, "")]
    got = simhash.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", fp int")).select("doc_id", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted([(1, 1), (1, 1), (None, 1), (3, 2), (2, 2)], key=repr)
