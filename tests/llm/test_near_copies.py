"""Near copies of the pipeline against brute force over all pairs."""

import corpus_pipeline
import pytest

from govdocs.llm import near_copies


def shingles(text):
    ws = (text or "").encode().lower().split()
    k = min(5, len(ws))
    return frozenset(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)) if ws else frozenset()


def brute_kept(rows):
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 10 * min(len(a), len(b)) >= 8 * max(len(a), len(b)) and len(a & b) * 10 >= 8 * len(a | b):
                comp[top(i)] = top(j)
    best = {}
    for i, r in enumerate(rows):
        best[top(i)] = min(best.get(top(i), r), r, key=lambda x: x[0])
    return {r[0] for r in best.values()}


@pytest.mark.parametrize("long_list", [1, 64])
def test_stage_matches_brute_force(spark, long_list):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    base = [f"w{i}" for i in range(60)]
    more = [(10**6 + k, " ".join(base[:k] + [f"x{k}"] + base[k + 1 :])) for k in range(0, 60, 3)] + [(2 * 10**6 + k, f"own{k} " * 3 + "one common passage of words in every text " + f"tail{k} end") for k in range(80)]
    more += [(3 * 10**6, None), (3 * 10**6 + 1, ""), (3 * 10**6 + 2, "Short text"), (3 * 10**6 + 3, "short  TEXT")]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + more
    frame = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, sid string").repartition(5)
    got = (corpus_pipeline.drop_near(spark, frame, "") if long_list == 64 else near_copies.drop_near_duplicates(frame, long_list=1)).collect()
    assert {r.doc_id for r in got} == brute_kept(rows) and {r.sid for r in got} == {"z"}


def test_large_group_of_near_copies(spark):
    """A base with many copies, some of them too far from it, and one copy repeated whole."""
    base = [f"word{i}" for i in range(120)]
    rows = []
    for k in range(260):
        copy = list(base)
        for j in range(1 + k % 6):
            copy[(k * 37 + j * 23) % 120] = f"own{k}x{j}"
        rows.append((k, " ".join(copy)))
    frame = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").repartition(6)
    got = near_copies.drop_near_duplicates(frame, long_list=16).collect()
    assert len(got) == len({r.doc_id for r in got}) and {r.doc_id for r in got} == brute_kept(rows)


def test_repeated_and_null_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, a), (2, a + " more"), (2, b), (None, a + " most"), (None, "alone"), (7, "other")]
    got = near_copies.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, a), (2, b), (None, "alone"), (7, "other")], key=repr)
    same = spark.createDataFrame([(4, "x y z"), (4, "x y z"), (None, None), (None, ""), (6, " ")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in near_copies.drop_near_duplicates(same).collect()) == [(4, "x y z"), (6, " ")]
    assert near_copies.drop_near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rounds_leave_few_pairs_of_a_large_group(spark, monkeypatch):
    """Copies of which many are linked through others only: rounds link them, so that the pairs left for the end are few."""
    base, rows = [f"word{i}" for i in range(146)], []
    for k in range(300):
        copy = list(base)
        for j in range(1 + (k % 5 > 0)):
            copy[(k * 29 + j * 71) % 146] = f"own{k}x{j}"
        rows.append((k, " ".join(copy)))
    left = []

    def put(self, name, df, *more, put=near_copies.Scratch.put):
        out = put(self, name, df, *more)
        if name == "rest-pairs":
            left.append(out.count())
        return out

    monkeypatch.setattr(near_copies.Scratch, "put", put)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_copies.drop_near_duplicates(frame)
    assert {r.doc_id for r in got.collect()} == brute_kept(rows)
    assert len(left) == 1 and left[0] < 1500


def test_wide_maps_rule_out_no_link():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 100, 250, 3000):
        for gone in (0, n // 9, n // 4, n):
            both = np.unique(rng.integers(-(2**63), 2**63, 2 * n + gone, dtype=np.int64))
            rng.shuffle(both)
            a, b = both[:n], both[gone : gone + n + n // 8]
            shared, maps = len(np.intersect1d(a, b)), [np.packbits(near_copies.wide_map(s)) for s in (a, b)]
            only = near_copies.alone(*maps)
            bound = min(len(a) - only[0], len(b) - only[1])
            assert shared <= bound <= shared + max(3, 0.3 * n)


def test_map_of_frequent_keys(spark):
    """Keys that repeat within a batch, over batches and only where the map's bits are alike."""
    import numpy as np

    twin = 5 + near_copies.MAP_BITS  # the place of 5, another key
    firsts = [[1, 2, -7], [1, 3, -7], [1, 4], [5], [twin], [], [6, 8], [9]]
    frame = spark.createDataFrame([(f,) for f in firsts], "first array<long>").repartition(3)
    places = lambda keys: sorted(k % near_copies.MAP_BITS for k in keys)
    held = lambda bits: np.nonzero(np.unpackbits(bits, bitorder="little"))[0].tolist()
    assert held(near_copies.bit_map(frame, 1)) == places([1, -7])
    assert held(near_copies.bit_map(frame, 2)) == places([1])
    assert near_copies.bit_map(frame, 3) is None
