"""Extra columns with the operators' own names come through, or change nothing."""

import pytest
from pyspark.sql import functions as F

from brookwatch.llm.context_tree import context_tree_scores
from brookwatch.llm.decontaminate import contaminated, decontaminate
from brookwatch.llm.exact_dedup import exact_dedup
from brookwatch.llm.line_dedup import line_dedup
from brookwatch.llm.near_dedup import near_duplicates
from brookwatch.llm.packing import pack
from brookwatch.llm.sharding import balanced_shards
from brookwatch.llm.span_dedup import span_dedup

NAMES = ["key", "_key", "gone", "_gone", "KEY", "flag", "bucket", "slot", "bitmap", "lines_removed", "pos", "line", "site", "h", "doc", "maybe", "cls", "n", "regs", "digest", "fp", "part", "norm", "gid", "rank", "place", "class", "value", "held_out", "block", "word"]


@pytest.fixture(scope="module")
def plain(spark):
    shared = " ".join(f"s{i}" for i in range(60)) + "."
    rows = [(i, f"own {i} of it.\n  shared line \n\nend {i}\n" + (shared if i % 3 == 0 else ""), f"site{i % 6}") for i in range(12)]
    rows += [(12, None, None), (13, "", "site1"), (3, rows[3][1], "site2"), (14, "before " + " ".join(f"q{i}" for i in range(20)) + " after", "site3"), (None, "no id here", "site4")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).cache()


@pytest.fixture(scope="module")
def wide(plain):
    # A frame may not hold two names that differ by case alone where they are read, so KEY stands for key.
    return plain.select("*", *[F.concat(F.lit(f"{n}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in NAMES if n != "KEY"])


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(20)), "x", 1), (1, "", "x", 1), (2, None, "x", 1), (None, "own", "x", 1)], "item_id long, text string, key string, h int")


def same(a, b, columns=None):
    columns = columns or a.columns
    assert sorted(map(str, a.select(columns).collect())) == sorted(map(str, b.select(columns).collect()))


@pytest.mark.parametrize("operator", [exact_dedup, near_duplicates, span_dedup, balanced_shards, context_tree_scores])
def test_results_do_not_change(plain, wide, operator):
    columns = None if operator is not balanced_shards else ["doc_id", "size", "text_crc32", "group_size"]
    same(operator(plain), operator(wide), columns)


def test_pieces_do_not_change(plain, wide):
    same(pack(plain), pack(wide), ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])


def test_lines(plain, wide):
    a, b = line_dedup(plain), line_dedup(wide)
    same(a, b, ["doc_id", "text", "source", "lines_removed"])
    assert b.columns.count("lines_removed") == 1 and a.filter("lines_removed > 0").count() == 13
    others = [n for n in NAMES if n not in ("KEY", "lines_removed")]
    assert all(r[n] == f"{n}-{'-' if r.doc_id is None else r.doc_id}" for r in b.collect() for n in others)
    odd = line_dedup(plain.withColumn("KEY", F.lit(7)).withColumn("Gone", F.lit(8)))
    assert {(r.KEY, r.Gone) for r in odd.collect()} == {(7, 8)}


def test_decontamination(plain, wide, bench):
    same(contaminated(plain, bench), contaminated(wide, bench))
    left = decontaminate(wide, bench)
    assert left.columns == wide.columns and left.count() == wide.count() - 1 and left.filter("doc_id = 14").isEmpty()
    assert all(r.key == f"key-{'-' if r.doc_id is None else r.doc_id}" for r in left.collect())
    same(decontaminate(wide, bench.limit(0)), wide)
