"""The pipeline's stages, each held against brute force on its own input, and the whole of them."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from brookwatch.llm import packing
from brookwatch.llm.decontaminate import align, contaminated, tokens
from brookwatch.llm.quality import quality_scores

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def smith_waterman(text, item):
    """The score by the plain recurrence, as a share of a perfect one."""
    rows = np.zeros((len(item) + 1, len(text) + 1))
    for i, w in enumerate(item):
        for j, v in enumerate(text):
            rows[i + 1, j + 1] = max(0, rows[i, j] + (2 if v == w else -1), rows[i, j + 1] - 1, rows[i + 1, j] - 1)
    return rows.max() / (2 * len(item)) if len(item) else 0


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    r = random.Random(8)
    folder = str(tmp_path_factory.mktemp("tables"))

    def prose(n):
        return " ".join(r.choice("alpha beta gamma delta words of many kinds".split()) + str(r.randrange(400)) for _ in range(n)).capitalize() + "."

    items = [" ".join(f"q{k}_{i}" for i in range(24)) for k in range(4)] + ["short item", "", None]
    rows = [(i, "\n".join([prose(r.randrange(20, 60)), "  Boilerplate line ", prose(30)]), "en", f"site{i % 6}", 0) for i in range(90)]
    rows += [(200 + i, rows[i][1].replace("alpha1", "alpha2", 1), "en", "site1", 0) for i in range(20)]
    rows += [(300 + i, " ".join(["!!", "#@", "zzz"] * (3 + i)), "en", "junk", 0) for i in range(60)]
    for k in range(4):
        w = items[k].split()
        rows += [(400 + k, prose(30) + " " + items[k] + " " + prose(10), "en", "leak", 0), (410 + k, prose(20) + " " + " ".join("new" if i % 6 == 1 else x for i, x in enumerate(w)), "en", "leak", 0), (420 + k, prose(20) + " " + " ".join(w[:5]) + " " + prose(20), "en", "leak", 0)]
    rows += [(500, None, None, None, None), (501, "", "en", None, 0), (None, rows[0][1], "en", "site9", 0), (None, prose(40), "en", "site9", 0), (1, rows[1][1], "en", "site1", 0)]
    rows = [(i, t, a, s, None if t is None else len(t)) for i, t, a, s, _ in rows]
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, int(i < 300 or i >= 400), 0) for i, *_ in rows if i is not None and i not in (500, 501)], "doc_id long, quality int, toxic int").distinct().write.parquet(f"{folder}/labels.parquet")
    return folder, spark.read.parquet(f"{folder}/documents.parquet"), rows, items


def kept(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_quality(spark, data):
    folder, docs, rows, _ = data
    out = corpus_pipeline.quality(spark, docs, folder)
    scores = {r.doc_id: r.score for r in quality_scores(docs.filter("doc_id IS NOT NULL"), spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert out.columns == docs.columns
    got = [r.doc_id for r in out.collect() if r.doc_id is not None]
    assert sorted(got) == sorted(i for i, *_ in rows if i is not None and scores[i] >= 0.5)
    assert not {i for i in got if 300 <= i < 360} and sum(i < 300 for i in got) >= 105


def test_lines(spark, data):
    folder, docs, rows, _ = data
    sites: dict = {}
    for _, t, _, s, _ in rows:
        for x in (t or "").split("\n"):
            sites.setdefault(x.strip(" \t\n\x0b\x0c\r"), set()).add(s or "")
    bad = {x for x, s in sites.items() if x and len(s) >= 5}
    want = []
    for i, t, a, s, n in rows:
        left = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r") not in bad]
        cut = t is not None and len(left) < len(t.split("\n"))
        want.append((i, "\n".join(left) if cut else t, a, s, len("\n".join(left)) if cut else n))
    assert bad == {"Boilerplate line"} and kept(corpus_pipeline.lines(spark, docs, folder)) == sorted(map(str, want))


def shingles(t, n=5):
    w = (t or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_near(spark, data):
    folder, docs, rows, _ = data
    sets = [shingles(t) for _, t, *_ in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            same_id = rows[a][0] is not None and rows[a][0] == rows[b][0]
            if same_id or x and y and 100 * len(x & y) >= 80 * len(x | y):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    best: dict = {}
    for k, g in enumerate(group):
        i = rows[k][0]
        best[g] = min(best.get(g, (True, 0)), (i is None, i or 0)) if g in best else (i is None, i or 0)
    want = [rows[k] for k, g in enumerate(group) if (rows[k][0] is None, rows[k][0] or 0) == best[g]]
    assert kept(corpus_pipeline.near(spark, docs, folder)) == sorted(map(str, want)) and len(rows) - len(want) >= 20


def test_decontamination(spark, data):
    folder, docs, rows, items = data

    def holds(text):
        t = re.findall(r"\w+", (text or "").lower())
        for item in items:
            w = re.findall(r"\w+", (item or "").lower())
            n = min(4, len(w))
            if n and len({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} & {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}) >= min(2, len({tuple(w[i : i + n]) for i in range(len(w) - n + 1)})):
                if smith_waterman(t, w) >= 0.5:
                    return True
        return False

    want = [r for r in rows if not holds(r[1])]
    assert kept(corpus_pipeline.decontaminated(spark, docs, folder)) == sorted(map(str, want))
    gone = {r[0] for r in rows} - {r[0] for r in want}
    assert gone == {400, 401, 402, 403, 410, 411, 412, 413}


def test_alignment_equals_the_recurrence():
    r = random.Random(2)
    for _ in range(60):
        text, item = ([r.choice("abcdef") for _ in range(r.randrange(n))] for n in (30, 15))
        score, start, end = align(tokens(" ".join(text)), tokens(" ".join(item)))
        assert score == pytest.approx(smith_waterman(text, item)) and 0 <= start <= end <= len(text)


def test_items_of_one_id_and_empty_benchmark(spark, data):
    _, docs, _, items = data
    bench = spark.createDataFrame([(7, items[0]), (7, items[1]), (7, items[0])], "item_id long, text string")
    found = contaminated(docs, bench).collect()
    assert len(found) == len({(bytes(r.key), r.item_id) for r in found}) == 4 and {r.item_id for r in found} == {7}
    assert contaminated(docs, bench.limit(0)).count() == 0


def test_packing(spark, data):
    folder, docs, rows, _ = data
    out = corpus_pipeline.packed(spark, docs, folder).collect()
    pieces = sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out)
    want = []
    for i, t, *_ in rows:
        ids = packing._tokenizers("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")[0].encode(t or "", add_special_tokens=False).ids + [1]
        for at in range(0, len(ids), 2048):
            part = ids[at : at + 2048]
            want.append((str(i), at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)))
    assert pieces == sorted(want)
    by: dict = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by.values():
        assert [o for o, _ in sorted(held)] == [sum(n for _, n in sorted(held)[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 2048


def test_run_and_empty_tables(spark, data, tmp_path):
    folder, docs, *_ = data
    out = corpus_pipeline.run(spark, folder)
    assert out.count() >= 60 and len(corpus_pipeline.STAGES) == 5
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
