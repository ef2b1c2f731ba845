import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brookwatch.llm import common


def least(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in up}


def test_components_of_a_shuffled_chain_and_a_random_graph(spark):
    r = random.Random(3)
    ids = list(range(1000))
    r.shuffle(ids)
    edges = [(ids[i], ids[i + 1]) for i in range(999)] + [(2000 + r.randrange(300), 2000 + r.randrange(300)) for _ in range(200)] + [(5000, 5000), (-7, 6000), (6000, -7)]
    got = {x.id: x.component for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == least(edges)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("few", [0, 10**6])
def test_components_on_the_driver_and_in_tables(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW", few)
    r = random.Random(5)
    edges = [(r.randrange(-300, 300) * 2**53, r.randrange(300)) for _ in range(250)] + [(2**62 + 1, 2**62 + 2), (2**62 + 2, 2**62 + 3)]
    got = {x.id: x.component for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == least(edges)


def test_narrowed_is_exact(spark):
    keys = common.stored(spark.createDataFrame([(i * 7,) for i in range(100)], "k long"))
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit(1).alias("bucket"), F.lit(2).alias("flag"), F.lit(3).alias("slot"), F.lit(4).alias("bitmap"))
    out = common.narrowed(rows, "k", keys)
    assert out.columns == rows.columns and {r.k for r in out.collect()} == {i * 7 for i in range(100)}
    flags = common.flagged(rows, "k", keys, "maybe").filter("maybe")
    assert 100 <= flags.count() < 300
    assert common.narrowed(rows, "k", common.stored(keys.limit(0))).count() == 0


@pytest.mark.parametrize("few", [0, 10**6])
def test_lookups_give_the_same_by_both_ways(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW", few)
    table = common.stored(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"))
    rows = spark.createDataFrame([(1, 5), (2, 6), (3, 7), (None, 8)], "k long, flag int")
    got = {(r.k, r.flag, r.v) for r in common.looked_up(rows, "k", table).collect()}
    assert got == {(1, 5, "a"), (2, 6, "b"), (3, 7, None), (None, 8, None)}
    assert common.joined(rows, table, "k", "left_anti").count() == 2


def test_filter_of_hashes(spark):
    h = np.random.default_rng(1).integers(-(2**63), 2**63, 500)
    packed = common.bit_filter(common.stored(spark.createDataFrame([(int(x),) for x in h], "h long")))
    assert common.in_filter(packed, h).all()
    assert common.in_filter(packed, np.random.default_rng(2).integers(-(2**63), 2**63, 10_000)).mean() < 0.2


def test_words_as_patterns_find_them():
    import re

    r, letters = random.Random(5), "abcXYZ019_ .,é²ßÉ“” \n\tǅ½٣-中"
    for digits, pattern in ((True, re.compile(r"\w+")), (False, re.compile(r"[^\W\d_]+"))):
        seen: dict = {}
        for _ in range(500):
            t = "".join(r.choice(letters) for _ in range(r.randrange(40)))
            found, hashes = pattern.findall(t.lower()), common.letter_words(t, digits).tolist()
            assert len(found) == len(hashes) and all(seen.setdefault(h, w) == w for w, h in zip(found, hashes))
        assert len(set(seen.values())) == len(seen)
    assert len(common.space_words(" a\tb\x0bc  A b ")) == 4 and len(common.space_words(None)) == 0


def test_a_shared_folder_is_asked_for(spark, monkeypatch):
    class Context:
        master = "spark://somewhere"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
