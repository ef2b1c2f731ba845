import zlib
from collections import Counter

import pytest

from brookwatch.llm.sharding import balanced_shards

KIND = "doc_id long, text string, gid string, shard string, best int, deal int"


@pytest.fixture(scope="module")
def rows():
    rows = [(i, f"text {i}") for i in range(300)]
    rows += [(300 + i, f"group {i // 7} of equal texts") for i in range(140)] + [(500 + i, "one large group") for i in range(250)]
    return rows + [(900, None), (901, ""), (None, "no id"), (None, None), (5, "text 5"), (5, "text 5"), (6, "another text of 6"), (902, "word " * 5000)]


def test_law_slots_and_groups(spark, rows):
    out = balanced_shards(spark.createDataFrame([(i, t, "a", "b", 1, 2) for i, t in rows], KIND).repartition(5)).collect()
    texts = {}
    for i, t in rows:
        raw = (t or "").encode()
        texts.setdefault(i, set()).add((len(raw) + 1, zlib.crc32(raw)))
    assert len(out) == len(rows) and all((r.size, r.text_crc32) in texts[r.doc_id] for r in out)
    assert {r.law for r in out} == {"rows"} and {r.grown_shard for r in out} == {None}
    sizes = Counter(r.shard for r in out)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    groups = {}
    for r in out:
        groups.setdefault(r.text_crc32, Counter())[r.shard] += 1
    small = [g for g in groups.values() if 1 < sum(g.values()) <= 7]
    assert sum(len(g) == 1 for g in small) >= 0.8 * len(small)
    large = groups[zlib.crc32(b"one large group")]
    assert sum(n for _, n in large.most_common(4)) >= 0.9 * 250 and all(r.group_size == sum(groups[r.text_crc32].values()) for r in out)


def test_few_and_no_rows(spark):
    assert balanced_shards(spark.createDataFrame([], KIND)).count() == 0
    out = balanced_shards(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string"), shards=2).collect()
    assert sorted(Counter(r.shard for r in out).values()) == [1, 2] and {r.slot for r in out} == {0, 1}
