"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

Training texts emit only word n-grams that a bitmap of the benchmark's n-grams lets through.  All
n-grams of an item are its seeds, whatever other copies the corpus holds.  Text and item meet if they share
`min_seeds` distinct seeds, and the item is then aligned with the whole text.  A text contains an item if the
alignment's score is `share` of a perfect one.  Items shorter than n words make one n-gram of all their words.
Work is done once for each distinct text, and only the texts of candidates are shuffled.

Null and empty texts contain nothing, and so do null and empty items.  Repeated rows, and rows with one id and different
texts, are judged by their own text.  An item_id with several texts is several items of that id: the best score is
reported, and of equal scores the first place.  An alignment's place is the first end with the best score, and its start the
one that the recurrence finds first (a match before a gap).  Only the named columns are read and names of our own are
chosen beside those of docs, so other columns cannot clash.  An empty corpus or benchmark gives no rows; decontaminate()
then returns docs as it is.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bit_filter, flagged, free_name, in_filter, joined, letter_words, mix64, stored, text_key, text_of

MATCH, MISMATCH, GAP = 2.0, -1.0, -1.0


def tokens(text: str | None) -> np.ndarray:
    """64-bit hashes of the lower-case words."""
    return letter_words(text, digits=True)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    if len(h) < n:
        return np.zeros(0, np.int64)
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return out.view(np.int64)


def align(text: np.ndarray, item: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman score as a share of a perfect one, and the words [start, end) of the text; a row for each item word."""
    if not len(text) or not len(item):
        return 0.0, 0, 0
    at = np.arange(len(text) + 1)
    ramp = GAP * at
    row, origin = np.zeros(len(text) + 1), at.copy()
    best, start, end = 0.0, 0, 0
    for w in item:
        diagonal = row[:-1] + np.where(text == w, MATCH, MISMATCH)
        up = row + GAP
        new, came = up.copy(), origin.copy()
        better = diagonal >= new[1:]
        new[1:], came[1:] = np.where(better, diagonal, new[1:]), np.where(better, origin[:-1], came[1:])
        fresh = new <= 0
        new[fresh], came[fresh] = 0, at[fresh]
        # Gaps along the text: the best earlier cell, less the gap for each word between.
        level = new - ramp
        top = np.maximum.accumulate(level)
        place = np.maximum.accumulate(np.where(level >= top, at, 0))
        gapped = top + ramp
        use = gapped > new
        row, origin = np.where(use, gapped, new), np.where(use, came[place], came)
        j = int(row.argmax())
        if row[j] > best:
            best, start, end = float(row[j]), int(origin[j]), j
    return best / (MATCH * len(item)), start, end


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 4, min_seeds: int = 2, share: float = 0.5, text_col: str = "text") -> DataFrame:
    """(key, item_id, score, start, end): a row for each distinct text (by text_key) and item that it contains."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item")).filter("item IS NOT NULL").distinct()
    items = stored(items.withColumn("part", F.xxhash64("item_id", "item")))

    def item_grams(c):
        out = {"item_id": [], "part": [], "h": [], "need": [], "size": []}
        for i, p, t in zip(c["item_id"], c["part"], c["item"]):
            h = tokens(t)
            size = min(n, len(h))
            g = np.unique(grams(h, size)) if size else []
            for x in g:
                for k, v in zip(out, (i, p, int(x), min(min_seeds, len(g)), size)):
                    out[k].append(v)
        return out

    wanted = stored(arrow_map(items, item_grams, "item_id long, part long, h long, need int, size int"))
    sizes = sorted(r["size"] for r in wanted.select("size").distinct().collect())  # at most n
    packed = docs.sparkSession.sparkContext.broadcast(bit_filter(stored(wanted.select("h").distinct())))
    texts = docs.select(text_key(text_col).alias("key"), text_of(text_col).alias("text"))

    def text_grams(c):
        key, out = [], []
        for k, t in zip(c["key"], c["text"]):
            h = tokens(t)
            for size in sizes:
                g = grams(h, size)
                g = np.unique(g[in_filter(packed.value, g)])
                key += [k] * len(g)
                out += g.tolist()
        return {"key": key, "h": out}

    hits = stored(arrow_map(texts, text_grams, "key binary, h long").distinct())
    seeds = joined(wanted, stored(hits.select("h").distinct()), "h", "left_semi")
    held = seeds.groupBy("item_id", "part").agg(F.countDistinct("h").alias("seeds"))
    seeds = stored(seeds.groupBy("h", "item_id", "part").agg(F.min("need").alias("need")).join(held, ["item_id", "part"]))
    shared = joined(hits, seeds, "h").groupBy("key", "item_id", "part").agg(F.count(F.lit(1)).alias("shared"), F.min(F.least("need", "seeds")).alias("need"))
    pairs = stored(shared.filter("shared >= need").select("key", "item_id", "part"))
    # One copy of a candidate's text from each map task, so a hot text is no hot key.
    one = flagged(texts, "key", stored(pairs.select("key").distinct()), "maybe").filter("maybe").groupBy("key").agg(F.first("text").alias("text"))

    def aligned(c):
        out = {"key": [], "item_id": [], "score": [], "start": [], "end": []}
        for k, i, t, item in zip(c["key"], c["item_id"], c["text"], c["item"]):
            score, start, end = align(tokens(t), tokens(item))
            if score >= share:
                for name, v in zip(out, (k, i, score, start, end)):
                    out[name].append(v)
        return out

    both = joined(pairs.join(one, "key"), items.select("part", "item"), "part")
    found = arrow_map(both.select("key", "item_id", "text", "item"), aligned, "key binary, item_id long, score double, start long, end long", 64)
    best = F.max(F.struct("score", (-F.col("start")).alias("low"), (-F.col("end")).alias("high"))).alias("b")
    return found.groupBy("key", "item_id").agg(best).select("key", "item_id", "b.score", (-F.col("b.low")).alias("start"), (-F.col("b.high")).alias("end"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs without the rows whose text contains an item of the benchmark."""
    key = free_name(docs, "key")
    bad = stored(contaminated(docs, benchmark, text_col=text_col, **options).select(F.col("key").alias(key)).distinct())
    return joined(docs.withColumn(key, text_key(text_col)), bad, key, "left_anti").select(*docs.columns)
