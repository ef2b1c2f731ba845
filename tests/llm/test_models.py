import random
from collections import Counter

import numpy as np
import pytest

from brookwatch.llm import toxicity as T
from brookwatch.llm.common import stored
from brookwatch.llm.quality import quality_scores


def test_kneser_ney_equals_its_definition(spark):
    """Both levels, and the model without a fold, against dictionaries of words."""
    r = random.Random(6)
    docs = [(f, y, [r.choice("the of bad vile kind good idiot x y z".split() + ["you"] * 3) for _ in range(r.randrange(1, 30))]) for f in T.FOLDS for y in (0, 1) for _ in range(12)]
    name = {}

    def hashes(words):
        h = T.tokens(" ".join(words))
        name.update(zip(words, h.tolist()))
        return h

    rows = []
    for f, y, words in docs:
        h = hashes(words)
        before, _ = T.bigrams(h)
        rows += [(f, y, int(np.uint64(b).astype(np.int64)), int(np.uint64(w).astype(np.int64))) for b, w in set(zip(before.tolist(), h.tolist()))]
    *tables, sums = T.counted(stored(spark.createDataFrame(rows, "fold int, y int, before long, word long")))
    tables, sums = [t.toArrow() for t in tables], sums.first().asDict()
    d = T.DISCOUNT
    every = [Counter(), Counter()]
    for _, y, words in docs:
        every[y].update(set(zip([None, *words], words)))
    for without in (None, 1):
        pair = [Counter(), Counter()]
        for f, y, words in docs:
            if f != without:
                pair[y].update(set(zip([None, *words], words)))
        follows = [Counter(w for _, w in c) for c in pair]
        shared = Counter(w for _, w in set(pair[0]) | set(pair[1]))
        base = {w: (n + 0.5) / sum(x + 0.5 for x in shared.values()) for w, n in shared.items()}
        whole = [Counter(w for _, w in c) for c in ({p for f, y, words in docs if y == k for p in zip([None, *words], words)} for k in (0, 1))]

        def p(y, v, w):
            total = max(1, sum(follows[y].values()))
            uni = max(0, follows[y][w] - d) / total + max(sum(min(d, x) for x in follows[y].values()) / total, 1e-6) * base.get(w, 0.5 / sum(x + 0.5 for x in shared.values()))
            of = [(n, x) for (a, x), n in pair[y].items() if a == v]
            n = sum(x for x, _ in of)
            lam = sum(min(d, x) for x, _ in of) / n if n else 1.0
            return (max(0, pair[y][v, w] - d) / n if n else 0.0) + lam * uni

        model = T.KneserNey(*tables, sums, without)
        for words in (docs[0][2], docs[-1][2], ["idiot", "new", "the", "you"]):
            got = model.ratios(hashes(words))
            for i, (v, w) in enumerate(zip([None, *words], words)):
                known = max(whole[0][w], whole[1][w]) > d or any(n > d for c in every for (_, x), n in c.items() if x == w)
                assert got[i] == pytest.approx(np.log(p(1, v, w) / p(0, v, w)) if known else 0.0, abs=1e-5)


def test_statistics_of_ratios():
    r = np.array([0.0] * 20 + [3.0] * 12 + [0.0] * 8)
    assert T.normalised(r) == pytest.approx([0.9, 18 / np.sqrt(40), 3.0, np.log1p(18)]) and T.normalised(r[:0]) == [0.0] * 4


@pytest.mark.parametrize("scores, name", [(quality_scores, "quality"), (T.toxicity_scores, "toxic")])
def test_labels_with_nulls_and_repeats(spark, scores, name):
    rows = [(i, ("awful vile words " if i % 2 else "good kind phrases ") * (3 + i % 5), 1, 2.0) for i in range(120)] + [(7, "good kind phrases", 1, 2.0), (None, None, 1, 2.0), (None, "awful vile words", 1, 2.0), (9, "awful vile words awful", 1, 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int, f double")
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(120)] + [(3, 1, "x"), (5, None, "x"), (None, 1, "x"), (8, 7, "x"), (4, 1, "x")], f"doc_id long, {name} int, text string")
    out = scores(docs, labels).collect()
    assert sorted(map(str, (r.doc_id for r in out))) == sorted(str(r[0]) for r in rows) and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (r.held_out is True) and r.predicted in (0, 1) for r in out)
    one = scores(docs, labels.filter(f"{name} = 1")).collect()
    assert {r.score for r in one} == {1.0} and {r.predicted for r in one} == {1}
