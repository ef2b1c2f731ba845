import random
import zlib

import numpy as np
import pytest

from brookwatch.llm import toxicity as T
from brookwatch.llm.common import byte_hashes


def test_beginnings_of_words():
    h, pieces = T.spelled("Vile Éclairs, oaf")
    assert h.tolist() == T.tokens("vile éclairs oaf").tolist() and T.spelled(None)[1].shape == (0, 4)
    whole = np.frombuffer("vile".encode() + "éclairs".encode(), np.uint8)
    want = [byte_hashes(whole, np.array([a]), np.array([a + n]))[0] for a, n in ((0, 4), (4, 4), (4, 5), (4, 6), (4, 7))]
    assert pieces.tolist() == [[want[0], 0, 0, 0], want[1:], [0] * 4]


def test_beginnings_without_a_fold():
    """The ratio against its definition; what leans to ordinary text, or too few hold, has none."""
    rows = {11: {(0, 1): 20, (1, 1): 9, (3, 0): 2}, 12: {(0, 0): 30, (1, 1): 1, (3, 0): 200}, 13: {(0, 1): 4}, 14: {(3, 1): 30, (1, 0): 8}}
    import pyarrow as pa

    cells = [f"k{f}{y}" for f in T.FOLDS for y in (0, 1)]
    k = {c: [r.get((int(c[1]), int(c[2])), 0) for r in rows.values()] for c in cells}
    totals = {c: sum(v) for c, v in k.items()}
    for without in (None, 3):
        got = T.Beginnings(pa.table({"piece": list(rows), **k}), totals, without).ratios(np.array([[11, 12], [12, 13], [14, 99]], np.uint64))
        all_y = [sum(totals[f"k{f}{y}"] for f in T.FOLDS if f != without) for y in (0, 1)]

        def ratio(piece):
            n = [sum(v for (f, y), v in rows[piece].items() if f != without and y == c) for c in (0, 1)]
            like = [sum(n) * t / sum(all_y) for t in all_y]
            r = np.log((n[1] + 4) / (like[1] + 4)) - np.log((n[0] + 4) / (like[0] + 4))
            return r if sum(n) >= 8 and r >= 1 else 0.0

        assert got == pytest.approx([ratio(11), 0.0, ratio(14)], abs=1e-6)
    assert ratio(11) > 0 == ratio(14)


def test_new_endings_of_toxic_words(spark):
    """No inflected word occurs twice, so only its beginning can tell."""
    r = random.Random(4)
    new = iter(range(10**6))

    def ending():
        return "".join(chr(97 + int(d)) for d in str(1000 + next(new)))

    rows = []
    for i in range(600):
        words = [r.choice(("carol", "bremen", "tulip", "amber")) + ending() for _ in range(40)]
        for at in r.sample(range(40), 3 if i % 5 == 0 else 0):
            words[at] = r.choice(("grobian", "schurke")) + ending()
        rows.append((i, " ".join(words)))
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)], "doc_id long, toxic int")
    out = T.toxicity_scores(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    held = [x for x in out if x.held_out]
    assert {x.doc_id for x in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2} and len(out) == 600
    assert [x for x in held if x.predicted != int(x.doc_id % 5 == 0)] == []
