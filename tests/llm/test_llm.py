import hashlib
import re

import numpy as np
import pytest

from brookwatch.llm import packing
from brookwatch.llm.decontaminate import align, contaminated, tokens
from brookwatch.llm.exact_dedup import exact_dedup, rice_decode, rice_encode
from brookwatch.llm.line_dedup import line_dedup
from brookwatch.llm.near_dedup import near_duplicates, registers
from brookwatch.llm.quality import isotonic, quality_scores
from brookwatch.llm.span_dedup import span_dedup
from brookwatch.llm.toxicity import toxicity_scores

KIND = "doc_id long, text string, source string, key int, id int, n int"
LONG = " ".join(f"w{i}" for i in range(3000))
TEXTS = [None, "", " ", "a  b", "a\tb", "a b", "x", LONG, LONG + " tail", "One two three four five. Six seven eight nine. Ten eleven twelve thirteen."]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None if i % 3 else "s", 1, 2, 3) for i, t in enumerate(TEXTS)] + [(9, TEXTS[9], "s", 1, 2, 3)], KIND)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def test_rice_round_trip():
    v = np.unique(np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64))
    k, blob = rice_encode(v)
    assert (rice_decode(len(v), k, blob) == v).all()


def test_exact_dedup(docs, empty):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in enumerate(TEXTS)}
    for r in exact_dedup(docs).collect():
        same = [i for i in norm if norm[i] == norm[r.doc_id]]
        assert (r.keep_id, r.text_sha256) == (min(same), hashlib.sha256(norm[r.doc_id].encode()).hexdigest())
        assert r.group_size == len(same) + (9 in same)
    assert exact_dedup(empty).count() == 0


def test_packing_is_gapless(docs, empty):
    rows = packing.pack(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r.length for r in rows) == sum(len(packing.encode(t)) for t in [*TEXTS, TEXTS[9]])
    assert packing.pack(empty).count() == 0


def test_near_duplicates(docs, empty):
    out = {r.doc_id: r for r in near_duplicates(docs).collect()}
    assert out[8].component_id == 7 and out[0].component_id == 0 and out[0].n_shingles == 0 and out[4].component_id == 3
    assert near_duplicates(empty).count() == 0
    assert (registers(np.zeros(0, np.uint64)) == 0).all()


def test_line_dedup(spark, empty):
    rows = [(i, f"own {i}\n  shared line \n\nend {i}", f"s{i % 6}") for i in range(8)] + [(8, None, None)]
    out = {r.doc_id: (r.text, r.lines_removed) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[3] == ("own 3\n\nend 3", 1) and out[8] == (None, 0)
    assert line_dedup(empty).count() == 0


def test_span_dedup(docs, empty):
    assert span_dedup(docs).count() == 11 and span_dedup(empty).count() == 0


def test_decontamination(spark, docs, empty):
    item = " ".join(f"q{i}" for i in range(20))
    edited = item.replace("q7", "other").replace("q13 ", "")
    score, start, end = align(tokens("before it " + edited + " after"), tokens(item))
    assert (start, end) == (2, 21) and 0.8 < score < 1
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    rows = spark.createDataFrame([(1, "before it " + edited + " after"), (2, "clean text"), (3, None)], "doc_id long, text string")
    assert [r.item_id for r in contaminated(rows, bench).collect()] == [1]
    assert contaminated(docs, bench).count() == 0 and contaminated(empty, bench).count() == 0


@pytest.mark.parametrize("copies", [0, 1, 5])
def test_decontamination_of_edited_copies_beside_exact_ones(spark, copies):
    words = [f"q{i}" for i in range(30)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    edited = [" ".join(f"new{i}" if i % 6 == k else w for i, w in enumerate(words)) for k in (0, 5)]
    texts = [*edited, *(f"copy {c} of it " + " ".join(words) for c in range(copies))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert contaminated(rows, bench).select("key").distinct().count() == len(texts)


def test_isotonic():
    assert isotonic(np.array([0.0, 1, 2]), np.array([0.0, 2, 0]), np.array([1.0, 2, 2]))[1].tolist() == [0.0, 0.5]


@pytest.mark.parametrize("scores", [quality_scores, toxicity_scores])
def test_classifiers(spark, docs, empty, scores):
    name = "quality" if scores is quality_scores else "toxic"
    rows = spark.createDataFrame([(i, ("awful vile words " if i % 2 else "good kind phrases ") * (3 + i % 5)) for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], f"doc_id long, {name} int")
    out = scores(rows, labels).collect()
    assert len(out) == 80 and all(0 <= r.score <= 1 for r in out)
    if scores is toxicity_scores:
        assert all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in out)
    assert scores(docs, labels).count() == 11 and scores(empty, labels).count() == 0
    assert scores(docs, labels.limit(0)).count() == 11
