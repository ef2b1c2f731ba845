import random
import re

import numpy as np
import pytest

from brookwatch.llm import span_dedup as S

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def pieces(text):
    """[(start, end, words)] of a text's sentences by its definition; a word's hash decides only whether it cuts."""
    raw = text.encode()
    words = list(WORD.finditer(raw))
    cuts = S.byte_hashes(np.frombuffer(raw.lower(), np.uint8), np.array([w.start() for w in words], int), np.array([w.end() for w in words], int)) % np.uint64(S.CUT) == 0 if words else []
    out, held = [], []
    for k, w in enumerate(words):
        held.append(w.group().lower())
        gap = raw[w.end() : words[k + 1].start()] if k + 1 < len(words) else b""
        if w.group()[-1:] in (b".", b"!", b"?") or b"\n" in gap or cuts[k] or k + 1 == len(words):
            out.append(held)
            held = []
    return out


def brute(rows, least, within=False):
    """{(id, text): numbers removed} by comparing the words of runs themselves."""
    runs, first = {}, {}
    for i, t in rows:
        p = pieces(t or "")
        found = set()
        for a in range(len(p)):
            for b in range(a + 1, len(p) + 1):
                n = sum(map(len, p[a:b]))
                if n >= least and (n - len(p[a]) < least or n - len(p[b - 1]) < least):
                    found.add((a, b, b" ".join(w for x in p[a:b] for w in x)))
                if n - len(p[a]) >= least and n - len(p[b - 1]) >= least and n > 3 * least:
                    break
        minimal = set()
        for a, b, key in found:
            forward = sum(map(len, p[a : b - 1])) < least
            backward = sum(map(len, p[a + 1 : b])) < least
            if forward or backward:
                minimal.add((a, b, key))
        runs[i, t] = minimal
        place = -(1 << 63) if i is None else i
        for _, _, key in minimal:
            first[key] = min(first.get(key, place), place)
    out = {}
    for (i, t), found in runs.items():
        place = -(1 << 63) if i is None else i
        out[i, t] = sorted({k for a, b, key in found if first[key] < place for k in range(a, b)})
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)

    def words(n, marks=0.15):
        return " ".join(r.choice(["the", "of", "and", "Zeit", "été", "a"]) + str(r.randrange(200)) + (r.choice([".", "!", "?", ",", "\n"]) if r.random() < marks else "") for _ in range(n))

    passage, plain, shout = words(60), words(70, 0), words(60, 0.9)
    rows = [(i, words(20 + 3 * i) + " " + x + " " + words(15)) for i, x in enumerate([passage, plain, shout, passage.upper(), plain, shout, passage + " " + passage, ""])]
    short = words(20)
    rows += [(20, short + ". " + words(30)), (21, short + ". " + words(30)), (22, None), (23, ""), (24, " \n "), (None, words(9) + ". " + plain), (25, plain + " " + plain)]
    return rows + [(3, rows[3][1]), (26, rows[0][1]), (2, words(40) + " " + shout)]


def test_equals_brute_force(spark, rows):
    docs = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], "doc_id long, text string, key string, pos int, h int")
    want = brute(rows, S.MIN_WORDS)
    out = S.span_dedup(docs).collect()
    assert len(out) == len(rows) and sum(bool(r.removed) for r in out) >= 6
    left = {}
    for (i, t), gone in want.items():
        p = S.sentences(t)
        left.setdefault(i, []).append((gone, "".join(x for k, x in enumerate(p) if k not in gone) if gone else (t or "")))
    for r in out:
        assert (r.removed, r.text) in left[r.doc_id]


def test_passages_go_and_short_repeats_stay(spark, rows):
    out = {}
    for r in S.span_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert out[20][0].removed == out[21][0].removed == [] and out[26][0].text.strip() == "" and out[0][0].removed == []
    assert out[22][0].text == "" and out[24][0].text == " \n "


def test_repeats_within_a_document(spark):
    r = random.Random(9)
    passage = " ".join(f"p{r.randrange(500)}" for _ in range(60)) + ".\n"
    rows = spark.createDataFrame([(1, passage * 3), (2, "x y. " * 5)], "doc_id long, text string")
    plain = {r.doc_id: r.removed for r in S.span_dedup(rows).collect()}
    own = {r.doc_id: r for r in S.span_dedup(rows, within=True).collect()}
    assert plain == {1: [], 2: []}
    assert own[1].text == passage and own[2].removed == []


def test_pieces_join_to_the_text():
    for t in ("", "a", " a b.c  d!\n e", "é ö.\n\nx  ", "one. two! three? four\nfive"):
        assert "".join(S.sentences(t)) == t
    assert S.sentences(None) == []
