"""Toxicity by class-conditional Kneser-Ney bigram models.

Models of toxic and of ordinary text are counted from labelled training rows.  A class's bigram probability is
discounted and backs off to the class's own continuation counts (how many distinct words go before a word), and these,
discounted again, to continuation counts shared by both classes, so a rare expression is not held for toxic because
one class lacks it.  A pair counts once for each document that holds it.  What is compared is the two models'
log-likelihood of a text, word by word; since a toxic text is mostly ordinary words, the ratio is summed up length-normalised
in four ways: per word, in the most toxic run of words, and as the sum of its strongly toxic words over the
square root of the length and as a logarithm.

A word that is inflected or compounded stands in too few documents for its own counts, and new endings in none.  So
each word also has the ratio of its beginning: of its first 4 to 7 bytes, the most toxic of those that lean to toxic text
by a factor of e or more, by the documents of each class that hold a word with that beginning; 0 without one.
These ratios are summed up in the same four ways.  A logistic curve over all eight, fitted to rows scored by
models that leave out their fold, makes the score a probability.

The models are fitted on a sample of at most about `max_bytes` of labelled text a class, drawn by a hash of the id, so
they have a fixed bound; every row is scored whole.  Counts are made in Spark; the driver gets only the words, predecessors
and pairs of which the discount leaves something, and the beginnings that lean to toxic text.

Null and empty texts are texts of no words; the ratio of a word that the discount takes whole in both classes, with all
pairs that it ends, is 0.  Repeated rows are scored as often as they
occur and count as often in training.  An id with several labels trains with each of them; labels that are null or
neither 0 nor 1 are passed over.  A null id has the fold of empty text and no label.  Equal scores need no order.  Only the
named columns are read, so other columns cannot clash.  Without training labels of both classes every score is the share
of label 1 (0 without labels); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, byte_hashes, dropped, fold_of, letter_runs, letter_words, mix64, narrowed, stored

#: A discount of two documents, as an expression in one or two labelled documents says little about its class.
DISCOUNT, RUN, STRONG = 2.0, 12, 1.5
#: Bytes of training text a class: about 4 million words, so at most 1.3 million entries of three documents or more.
MAX_BYTES = 24 << 20
FOLDS = (0, 1, 3)
#: Bytes of a word's beginnings; documents added to what each class has and would have of one if classes were alike; the
#: documents that must hold it; and the least log ratio of one that counts.
FIRST, ADDED, HELD, LEAN = (4, 5, 6, 7), 4.0, 8, 1.0


def tokens(text: str | None) -> np.ndarray:
    """64-bit hashes of the lower-case words of letters."""
    return letter_words(text, digits=False)


def spelled(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The tokens, and for each the hashes of its beginnings of FIRST bytes (0 where it has fewer)."""
    b, start, end = letter_runs(text, digits=False)
    cut, end = start[:, None] + np.array(FIRST), end[:, None]
    to = np.hstack([end, np.minimum(cut, end)])
    h = byte_hashes(b, np.repeat(start, to.shape[1]), to.ravel()).reshape(to.shape)
    return h[:, 0], np.where(cut <= end, h[:, 1:], np.uint64(0))


def bigrams(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's predecessor (0 at the start) and the hash of the pair."""
    before = np.concatenate([np.zeros(min(1, len(h)), np.uint64), h[:-1]])
    return before, mix64(before * np.uint64(0x9E3779B97F4A7C15) + h)


class _Map:
    """Sorted hashes to rows of numbers, with a default."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, default: float):
        order = np.argsort(keys)
        self.keys, self.values, self.default = keys[order], values[order].astype(np.float32), default

    def __call__(self, k: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full((len(k), self.values.shape[1]), self.default)
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where((self.keys[at] == k)[:, None], self.values[at], self.default)


def _hashes(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64).view(np.uint64)


def _tag(fold: int | None) -> str:
    return "a" if fold is None else str(fold)


def counted(pairs: DataFrame, d: float = DISCOUNT) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """From rows (fold, y, before, word), one for each document that holds the pair: tables of words, predecessors and
    pairs that the discount leaves something of in a class, and a row of totals, for all folds and without each."""
    cells = [(f, y) for f in FOLDS for y in (0, 1)]
    pairs = pairs.groupBy("before", "word").agg(*[F.count_if((F.col("fold") == f) & (F.col("y") == y)).alias(f"k{f}{y}") for f, y in cells])
    every = {y: sum((F.col(f"k{f}{y}") for f in FOLDS[1:]), F.col(f"k{FOLDS[0]}{y}")) for y in (0, 1)}
    n = {(t, y): (every[y] if t is None else every[y] - F.col(f"k{t}{y}")) for t in (None, *FOLDS) for y in (0, 1)}
    pairs = stored(pairs.select("before", "word", *[c.alias(f"n{_tag(t)}{y}") for (t, y), c in n.items()]))
    col = {k: F.col(f"n{_tag(k[0])}{k[1]}") for k in n}
    words = pairs.groupBy("word").agg(
        *[F.count_if(c > 0).alias(f"c{_tag(t)}{y}") for (t, y), c in col.items()],
        *[F.count_if((col[t, 0] > 0) | (col[t, 1] > 0)).alias(f"s{_tag(t)}") for t in (None, *FOLDS)],
    )
    words = stored(words)
    totals = words.agg(
        *[F.sum(f"c{_tag(t)}{y}").alias(f"c{_tag(t)}{y}") for t, y in col],
        *[F.sum(F.least(F.col(f"c{_tag(t)}{y}"), F.lit(d))).alias(f"m{_tag(t)}{y}") for t, y in col],
        *[F.sum(F.col(f"s{_tag(t)}") + F.when(F.col(f"s{_tag(t)}") > 0, 0.5).otherwise(0.0)).alias(f"s{_tag(t)}") for t in (None, *FOLDS)],
    )
    befores = pairs.groupBy("before").agg(
        *[F.sum(c).alias(f"n{_tag(t)}{y}") for (t, y), c in col.items()],
        *[F.sum(F.least(c, F.lit(d))).alias(f"g{_tag(t)}{y}") for (t, y), c in col.items()],
    )
    left = pairs.filter(F.greatest(col[None, 0], col[None, 1]) > d)
    # A word that always follows the same one has one predecessor, however often it occurs; its pairs keep it.
    paired = left.select("word").distinct().withColumn("paired", F.lit(True))
    known = words.join(paired, "word", "left").filter((F.col("ca0") > d) | (F.col("ca1") > d) | F.col("paired")).drop("paired")
    return known, befores.filter((F.col("na0") > F.col("ga0")) | (F.col("na1") > F.col("ga1"))), left, totals


class KneserNey:
    """Both classes' bigram models from tables that `counted` makes; `without` leaves out a fold."""

    def __init__(self, words: pa.Table, befores: pa.Table, pairs: pa.Table, totals: dict, without: int | None = None, d: float = DISCOUNT):
        def of(t: pa.Table, name: str) -> np.ndarray:
            return np.stack([t[f"{name}{_tag(without)}{y}"].to_numpy().astype(float) for y in (0, 1)], 1)

        def sums(name: str) -> np.ndarray:
            return np.array([float(totals[f"{name}{_tag(without)}{y}"] or 0) for y in (0, 1)])

        follows, shared = of(words, "c"), words[f"s{_tag(without)}"].to_numpy() + 0.5
        total = np.maximum(1.0, sums("c"))
        base = shared / max(1.0, float(totals[f"s{_tag(without)}"] or 0))
        uni = (follows - np.minimum(follows, d)) / total + np.maximum(sums("m") / total, 1e-6) * base[:, None]
        n, gone = of(befores, "n"), of(befores, "g")
        lam = np.where(n > 0, gone / np.maximum(n, 1), 1.0)
        v, at = np.unique(_hashes(befores["before"]), return_index=True)
        pair = of(pairs, "n")
        seen = n[at][np.searchsorted(v, _hashes(pairs["before"]))]
        high = (pair - np.minimum(pair, d)) / np.maximum(seen, 1)
        self.uni, self.lam = _Map(_hashes(words["word"]), uni, -1.0), _Map(v, lam[at], 1.0)
        self.big = _Map(mix64(_hashes(pairs["before"]) * np.uint64(0x9E3779B97F4A7C15) + _hashes(pairs["word"])), high, 0.0)

    def ratios(self, h: np.ndarray) -> np.ndarray:
        """Each word's log-likelihood ratio, toxic against ordinary; unknown words have none."""
        if not len(h):
            return np.zeros(0)
        before, pair = bigrams(h)
        u = self.uni(h)
        p = self.big(pair) + self.lam(before) * np.abs(u)
        return np.where(u[:, 0] < 0, 0.0, np.log(p[:, 1]) - np.log(p[:, 0]))


def _lean(n, total, log):
    """The log ratio of n documents (ordinary, toxic) of the classes' totals, drawn to 0 by ADDED."""
    both = n[0] + n[1]
    ratio = [log((n[y] + ADDED) / (both * (total[y] / max(1, total[0] + total[1])) + ADDED)) for y in (0, 1)]
    return ratio[1] - ratio[0]


def _totals(totals: dict, without: int | None) -> list[int]:
    return [sum(totals[f"k{f}{y}"] or 0 for f in FOLDS if f != without) for y in (0, 1)]


def counted_beginnings(held: DataFrame) -> tuple[DataFrame, dict]:
    """From rows (fold, y, piece, n), n documents of the fold and class with the beginning: the table of those that lean
    to toxic text in all folds or without one of them, and the totals."""
    cells = [(f, y) for f in FOLDS for y in (0, 1)]
    held = stored(held.groupBy("piece").agg(*[F.sum(F.when((F.col("fold") == f) & (F.col("y") == y), F.col("n")).otherwise(0)).alias(f"k{f}{y}") for f, y in cells]))
    totals = held.agg(*[F.sum(f"k{f}{y}").alias(f"k{f}{y}") for f, y in cells]).first().asDict()
    leans = F.lit(False)
    for t in (None, *FOLDS):
        n = [sum((F.col(f"k{f}{y}") for f in FOLDS if f != t), F.lit(0)) for y in (0, 1)]
        leans = leans | ((n[0] + n[1] >= HELD) & (_lean(n, _totals(totals, t), F.log) >= LEAN))
    return held.filter(leans), totals


class Beginnings:
    """The ratios of words' beginnings from a table that `counted_beginnings` makes; `without` leaves out a fold."""

    def __init__(self, table: pa.Table, totals: dict, without: int | None = None):
        n = [sum((table[f"k{f}{y}"].to_numpy() for f in FOLDS if f != without), np.zeros(len(table), np.int64)) for y in (0, 1)]
        ratio = _lean(n, _totals(totals, without), np.log)
        strong = (n[0] + n[1] >= HELD) & (ratio >= LEAN)
        self.ratio = _Map(_hashes(table["piece"])[strong], ratio[strong, None], 0.0)

    def ratios(self, pieces: np.ndarray) -> np.ndarray:
        return self.ratio(pieces.ravel()).reshape(pieces.shape).max(axis=1) if len(pieces) else np.zeros(0)


class Models:
    """The statistics of a text by words and by their beginnings."""

    def __init__(self, words: KneserNey, first: Beginnings):
        self.words, self.first = words, first

    def __call__(self, text: str | None) -> list[float]:
        h, pieces = spelled(text)
        return normalised(self.words.ratios(h)) + normalised(self.first.ratios(pieces))


def normalised(r: np.ndarray) -> list[float]:
    if not len(r):
        return [0.0, 0.0, 0.0, 0.0]
    total = np.concatenate([[0.0], np.cumsum(r)])
    k = min(RUN, len(r))
    strong = np.maximum(r - STRONG, 0).sum()
    return [float(r.mean()), float(strong / np.sqrt(len(r))), float((total[k:] - total[:-k]).max() / RUN), float(np.log1p(strong))]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.3, max_bytes: int = MAX_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; rows of fold 2 of 4 never train."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held = (fold_of(4) == 2).alias("held_out")
    marked = labels.filter(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(fold_of(4) != 2)
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    known = stored(rows.select("doc_id", size.alias("size")).join(marked, "doc_id").select("doc_id", "y", "size"))
    totals = {r["y"]: r for r in known.groupBy("y").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        flat = float(next(iter(totals), 0))
        return rows.select("doc_id", held, F.lit(flat).alias("score"), F.lit(int(flat >= threshold)).alias("predicted"))
    prior = totals[1]["n"] / (totals[0]["n"] + totals[1]["n"])
    share = {y: min(1.0, max_bytes / r["size"]) for y, r in totals.items()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 20)) / (1 << 20)
    drawn = stored(known.filter(draw < F.when(F.col("y") == 1, share[1]).otherwise(share[0])).select("doc_id", "y", fold_of(4).cast("int").alias("fold")).distinct())
    sample = stored(narrowed(rows, "doc_id", drawn).join(drawn, "doc_id"))

    def pairs(c):
        found = [np.unique(np.stack([bigrams(h)[0], h], 1), axis=0).view(np.int64) for h in map(tokens, c["text"])]
        if not found:
            return None
        sizes, both = [len(x) for x in found], np.concatenate(found)
        return {"fold": np.repeat(c["fold"], sizes), "y": np.repeat(c["y"], sizes), "before": both[:, 0], "word": both[:, 1]}

    def first(c):
        found = {}
        for fold, y, t in zip(c["fold"], c["y"], c["text"]):
            found.setdefault((fold, y), []).append(np.setdiff1d(spelled(t)[1], np.zeros(1, np.uint64)))
        if not found:
            return None
        met = {k: np.unique(np.concatenate(v), return_counts=True) for k, v in found.items()}
        sizes = [len(n) for _, n in met.values()]
        out = {k: np.repeat([of[i] for of in met], sizes) for i, k in enumerate(("fold", "y"))}
        return out | {"piece": np.concatenate([p for p, _ in met.values()]).view(np.int64), "n": np.concatenate([n for _, n in met.values()])}

    *tables, sums = counted(arrow_map(sample, pairs, "fold int, y int, before long, word long", 64))
    tables, sums = [t.toArrow() for t in tables], sums.first().asDict()  # bounded with the sample
    starts, begun = counted_beginnings(arrow_map(sample, first, "fold int, y int, piece long, n long", 256))
    starts = starts.toArrow()  # bounded with the sample

    def models(without: int | None = None) -> Models:
        return Models(KneserNey(*tables, sums, without), Beginnings(starts, begun, without))

    whole = spark.sparkContext.broadcast(models())
    without = spark.sparkContext.broadcast({f: models(f) for f in FOLDS})
    del tables

    def out_of_fold(c):
        return {"y": c["y"], "f": [without.value[k](t) for k, t in zip(c["fold"], c["text"])]}

    fitted = arrow_map(sample, out_of_fold, "y int, f array<double>", 64).collect()  # bounded with the sample
    dropped(known, drawn, sample)
    x, y = np.array([r["f"] for r in fitted]), np.array([r["y"] for r in fitted], float)
    mean, sd = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    w = _logistic(np.hstack([(x - mean) / sd, np.ones((len(x), 1))]), y)
    w[-1] += np.log(prior / (1 - prior)) - np.log(y.mean() / (1 - y.mean())) if 0 < y.mean() < 1 else 0.0

    def score(c):
        f = np.array([whole.value(t) for t in c["text"]]).reshape(-1, len(mean))
        z = np.hstack([(f - mean) / sd, np.ones((len(f), 1))]) @ w
        return {"doc_id": c["doc_id"], "score": 1 / (1 + np.exp(-np.clip(z, -30, 30)))}

    scored = arrow_map(rows, score, "doc_id long, score double", 128)
    return scored.select("doc_id", held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
