import math
import zlib
from collections import Counter

import numpy as np
import pytest

from brookwatch.llm.context_tree import context_tree_scores, keys, log_kt, stream

DEPTH = 5
TEXTS = [None, "", " \t", "\x00", "The  cat\nsat", "the cat sat on the mat", "é cat", "the cat ran " * 30, "on the mat the cat sat", "Zebra"] + [f"the {w} sat on {w} mats" for w in ("cat", "dog", "hen", "cow", "pig", "rat", "bat", "ant", "owl", "fox", "elk", "yak")]


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0


def decisions(s):
    """(context newest byte first, decision, bit) of every byte."""
    padded = bytes(DEPTH) + s
    for i in range(len(s)):
        context, node = padded[i : i + DEPTH][::-1], 1
        for j in range(7, -1, -1):
            bit = padded[i + DEPTH] >> j & 1
            yield context, node, bit
            node = node * 2 + bit


def brute(rows):
    """Weighted probabilities by recursion over explicit trees."""
    trees = {}
    for i, t in rows:
        if not held(i):
            for context, node, bit in decisions(stream(t)):
                for d in range(DEPTH + 1):
                    trees.setdefault((node, context[:d]), [0, 0])[bit] += 1
    children = {}
    for node, s in trees:
        if s:
            children.setdefault((node, s[:-1]), []).append((node, s))
    memo = {}

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def product(key):
        return sum(weighted(c) for c in children.get(key, []))

    def weighted(key):
        if key not in memo:
            own = kt(*trees[key])
            memo[key] = own if len(key[1]) == DEPTH else np.logaddexp(own, product(key)) - math.log(2)
        return memo[key]

    def p(context, node, bit, d=0):
        key = (node, context[:d])
        a, b = trees.get(key, (0, 0))
        own = ((a, b)[bit] + 0.5) / (a + b + 1)
        if d == DEPTH or (node, context[: d + 1]) not in trees:
            return own
        share = 1 / (1 + math.exp(product(key) - kt(a, b)))
        return share * own + (1 - share) * p(context, node, bit, d + 1)

    return [sum(math.log10(p(*x)) for x in decisions(stream(t))) for _, t in rows]


def words_of(t):
    return (t or "").encode().lower().split() + [b"\n"]


@pytest.mark.parametrize("block_bytes", [1 << 24, 200])
def test_matches_brute_force(spark, block_bytes):
    rows = list(enumerate(TEXTS)) + [(4, TEXTS[4]), (None, "the cat")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, block long, word string")
    got = sorted(context_tree_scores(docs, block_bytes=block_bytes).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.n_tokens))
    want = sorted(zip(rows, brute(rows)), key=lambda r: (r[0][0] is None, r[0][0]))
    count = Counter(w for i, t in rows if not held(i) for w in words_of(t))
    total = sum(count.values())
    assert len(got) == len(rows)
    for r, ((i, t), score) in zip(got, want):
        w = words_of(t)
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i, held(i), len(w), sum(count[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 0.1) / (total + 0.1 * (len(count) + 1))) for x in w))
        assert r.score == pytest.approx(score, rel=1e-5)


def test_empty_and_untrained(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert context_tree_scores(none).count() == 0
    only = next(i for i in range(100) if held(i))
    r = context_tree_scores(spark.createDataFrame([(only, "ab")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (2, 0, 0, 0.0)
    assert r.score == pytest.approx(-24 * math.log10(2), rel=1e-5)


def test_keys_and_estimates():
    assert keys([b"ab", b"", b"c"], 4).tolist() == [ord("a"), ord("a") << 32 | ord("b"), ord("c")]
    a, b = np.array([0, 3, 200_000]), np.array([0, 2, 5])
    want = [math.lgamma(x + 0.5) + math.lgamma(y + 0.5) - math.lgamma(x + y + 1) - math.log(math.pi) for x, y in zip(a, b)]
    assert log_kt(a, b) == pytest.approx(want, abs=1e-6)
