import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brookwatch.llm import near_dedup as N
from brookwatch.llm.near_dedup import near_duplicates


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, percent=80):
    """{id: least id reachable}, rows with one id being one document; null ids are left out."""
    up = {i: i for i, _ in rows if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(i, shingles(t, n)) for i, t in rows if i is not None]
    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            both = len(x & y)
            if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in up}


def family(r, base, copies, edits, first):
    out = []
    for i in range(copies):
        w = list(base)
        for _ in range(r.randrange(edits)):
            k, kind = r.randrange(len(w)), r.randrange(3)
            if kind == 0:
                w[k] = f"x{r.randrange(60)}"
            elif kind == 1:
                del w[k]
            else:
                w.insert(k, f"y{r.randrange(60)}")
        out.append((first + i, " ".join(w)))
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    rows = family(r, [f"w{i}" for i in range(150)], 160, 9, 0)  # edits around the threshold
    shared = [f"s{i}" for i in range(230)]
    rows += [(1000 + i, " ".join(shared + [f"u{i}_{k}" for k in range(70)])) for i in range(60)]  # alike, not linked
    rows += [(1100 + i, rows[160 + i][1] + " tail") for i in range(20)]  # linked with one of them each
    rows += [(2000 + i, "The  same text of five words") for i in range(200)]  # one large group of copies
    rows += [(3000, None), (3001, ""), (3002, " \t"), (3003, "two words"), (3004, "TWO\twords"), (3005, " ".join(f"v{i}" for i in range(20000)))]
    rows += [(3006, "two words"), (3006, "quite another text of some words here"), (3007, "Quite another text of some words here")]  # one id, two texts
    rows += [(5, rows[5][1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("wide", [0, 10**9])
def test_equals_brute_force(spark, rows, wide):
    docs = spark.createDataFrame([(i, t, 1, b"x", 2, 3) for i, t in rows], "doc_id long, text string, n int, cls binary, id int, bucket int").repartition(4)
    out = near_duplicates(docs, 4, 80, wide=wide).collect()
    want = brute(rows, 4)
    assert len(out) == len(rows)
    assert [r for r in out if r.component_id != want[r.doc_id]] == []
    assert all(r.kept == (r.component_id == r.doc_id) for r in out)
    sizes = {}
    for i, t in rows:
        sizes.setdefault(i, set()).add(len(shingles(t, 4)))
    assert all(r.n_shingles in sizes[r.doc_id] for r in out)


def test_rows_without_an_id(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(None, text), (4, text), (None, "alone " + text[::-1]), (None, None)], "doc_id long, text string")
    out = sorted(((r.component_id, r.kept) for r in near_duplicates(docs).collect()), key=str)
    assert out == [(4, False), (4, True), (None, True), (None, True)]
    assert near_duplicates(docs.filter(F.lit(False))).count() == 0


def test_few_unlike_members_meet_in_pairs(spark):
    """40 members of 400 shingles have fewer pairs than differences; 900 of them, or 40 of 20 shingles, have more."""
    rows = [(bucket, i, n, hub, k - 1, k * (k - 1)) for bucket, hub, k, n in ((1, 1, 40, 400), (2, 2, 900, 400), (3, 3, 40, 20), (4, 4, 16, 20)) for i in range(k)]
    met = spark.createDataFrame(rows, "bucket long, id long, n long, hub long, others long, cost long")
    assert sorted(r.hub for r in N._crowded(met, N.WIDE).collect()) == [2, 3]
    assert sorted(r.hub for r in N._crowded(met, 0).collect()) == [2, 3, 4]


def test_differences_that_can_count():
    """A row for each added shingle, and for those lacked that at least as many follow as must be shared; each member is there."""
    x = np.arange(100, dtype="<u8")
    members = [np.arange(10, 130, dtype="<u8"), np.arange(60, 130, dtype="<u8"), np.arange(1, 100, dtype="<u8")]
    out = N._differences(80)({"a": [0] * 3, "b": [1, 2, 3], "comp": [1, 2, 3], "s_a": [x.tobytes()] * 3, "s_b": [y.tobytes() for y in members]})
    got = {b: [(bool(added), int(rest)) for i, added, rest in zip(out["b"], out["added"], out["rest"]) if i == b] for b in (1, 2, 3)}
    # 40 differences of 120: at least 10 are shared; 90 of 70: 73 of them, and the 60 that it lacks come last; 1 of 99.
    assert got == {1: [(True, 10)] * 30 + [(False, 10)], 2: [(True, 60)] * 30, 3: [(False, 1)]}


def test_many_pairs_by_the_ways_for_more_than_few(spark, rows, monkeypatch):
    """Hubs' rows repeated, texts found by filters: what tables above FEW rows take."""
    monkeypatch.setattr(N, "FEW", 0)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows, 4)
    assert [r for r in near_duplicates(docs, 4, 80).collect() if r.component_id != want[r.doc_id]] == []


def test_a_hub_of_more_pairs_than_differences_uses_its_pivot(spark):
    """211 members of 147 shingles that make 8,608 pairs, as on check_h, would have some 5,100 differences."""
    met = spark.createDataFrame([(1, i, 147, 1, 41, 8608) for i in range(211)], "bucket long, id long, n long, hub long, others long, cost long")
    assert [r.hub for r in N._crowded(met, N.WIDE).collect()] == [1]


def test_pairs_are_joined_once(spark):
    """Each side's columns, the same for few pairs and for many."""
    from brookwatch.llm.common import stored

    pairs = stored(spark.createDataFrame([(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1, 50)], "a long, b long"))
    table = spark.createDataFrame([(i, i * 3) for i in range(401)], "id long, n long")
    for few in (N.FEW, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(N, "FEW", few)
            got = sorted((r.a, r.b, r.n_a, r.n_b) for r in N._both(pairs, table, {"n": "n"}).collect())
        assert got == sorted((r.a, r.b, 3 * r.a, 3 * r.b) for r in pairs.collect())
