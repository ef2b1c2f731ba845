"""Quality classifier: random Fourier features, ridge regression by normal equations, isotonic calibration.

A pass over whole texts gives fixed document statistics.  Those of labelled training rows are
standardised and mapped to cosines that approximate a Gaussian kernel; every partition sums its own
normal equations, which are added up in two steps, so only matrices of a fixed size reach the driver.
Scores from models that leave out a row's fold, on a grid of a fixed size, fit the isotonic curve.

A null text is an empty one; empty texts get the score of their statistics.  Repeated rows are scored as often as they
occur.  An id with several labels or several texts trains with each pair of them; labels that are null or neither 0 nor 1 are
passed over.  A null id has the fold of empty text and no label.  Equal scores need no order.  Only the named columns
are read, so other columns cannot clash.  Without training labels of both classes every score is the share of label 1
(0.5 without labels); an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fold_of, stored

FEATURES, WIDTH, RIDGE, GRID = 16, 256, 1e-3, 2048
LETTER = re.compile(r"[^\W\d_]")


def statistics(text: str | None) -> list[float]:
    """FEATURES numbers about a whole text, none of which depends on its language's letters."""
    text = text or ""
    parts = text.split()
    n, chars = len(parts), max(1, len(text))
    lengths = np.array([len(p) for p in parts] or [0], float)
    letters = len(LETTER.findall(text))
    upper = sum(map(str.isupper, text))
    marks = sum(not (c.isalnum() or c.isspace()) for c in text)
    lines = [x for x in text.split("\n") if x.strip()]
    low = [p.lower() for p in parts]
    pairs = list(zip(low, low[1:]))
    _, counts = np.unique(np.array(low or [""]), return_counts=True)
    share = counts / counts.sum()
    ended = sum(not p[-1].isalnum() for p in parts)
    twice = sum(len(p) > 1 and not p[-1].isalnum() and not p[-2].isalnum() for p in parts)
    return [
        np.log1p(n), np.log1p(len(text)), lengths.mean(), lengths.std(), np.log1p(lengths.max()),
        letters / chars, upper / chars, marks / chars, sum(map(str.isdigit, text)) / chars, ended / max(1, n), twice / max(1, n),
        len(counts) / np.sqrt(max(1, n)), float(-(share * np.log(share)).sum()), len(set(pairs)) / max(1, len(pairs)),
        len(set(lines)) / max(1, len(lines)), sum(p.isupper() for p in parts) / max(1, n),
    ]


def _stats(c):
    return {"doc_id": c["doc_id"], "f": [[float(x) for x in statistics(t)] for t in c["text"]]}


class Cosines:
    """Standardises statistics and maps them to `width` random Fourier features and a constant."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, width: int = WIDTH, gamma: float = 0.08, seed: int = 10):
        rng = np.random.default_rng(seed)
        self.mean, self.sd, self.width = mean, np.where(sd > 1e-9, sd, 1.0), width
        self.w = rng.normal(0, np.sqrt(2 * gamma), (len(mean), width))
        self.b = rng.uniform(0, 2 * np.pi, width)

    def __call__(self, f: np.ndarray) -> np.ndarray:
        x = np.clip((f - self.mean) / self.sd, -8, 8)
        return np.hstack([np.cos(x @ self.w + self.b) * np.sqrt(2 / self.width), np.ones((len(x), 1))])


def isotonic(x: np.ndarray, hits: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the non-decreasing least-squares fit by pooling adjacent violators; x ascends."""
    blocks: list[list[float]] = []
    for at, h, w in zip(x, hits, weight):
        blocks.append([h, w, at * w])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    b = np.array(blocks)
    return b[:, 2] / b[:, 1], b[:, 0] / b[:, 1]


def _sum_tables(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b.as_py(), float) for b in t["m"])
    return pa.table([t["fold"][:1], pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["fold", "part", "m"])


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; rows of fold 2 of 4 never train."""
    spark = docs.sparkSession
    stats = stored(arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), _stats, "doc_id long, f array<double>"))
    marked = labels.filter(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
    train = stored(stats.join(marked, "doc_id").withColumn("fold", fold_of(4).cast("int")).filter("fold <> 2"))
    sums = train.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("y"), F.lit(0.5)).alias("y"), *[g(F.col("f")[i]).alias(f"{k}{i}") for i in range(FEATURES) for k, g in (("m", F.avg), ("s", F.stddev_pop))]).first()
    held = (fold_of(4) == 2).alias("held_out")
    if not sums["n"] or not 0 < sums["y"] < 1:
        return stats.select("doc_id", held, F.lit(float(sums["y"])).alias("score"), F.lit(int(sums["y"] >= threshold)).alias("predicted"))
    cosines = Cosines(*(np.array([sums[f"{k}{i}"] for i in range(FEATURES)]) for k in "ms"))
    m = cosines.width + 1

    def normal(batches):
        from pyspark import TaskContext

        total: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            z, y, k = cosines(np.array(b["f"].to_pylist())), b["y"].to_numpy(), b["fold"].to_numpy()
            for f in np.unique(k):
                zf = z[k == f]
                total[f] = total.get(f, 0) + np.vstack([zf.T @ zf, y[k == f] @ zf]).ravel()
        part = TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([part] * len(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["fold", "part", "m"])

    kinds = "fold int, part int, m binary"
    parts = train.mapInArrow(normal, kinds).groupBy("fold", "part").applyInArrow(_sum_tables, kinds).groupBy("fold").applyInArrow(_sum_tables, kinds)
    by_fold = {r["fold"]: np.frombuffer(bytes(r["m"]), float).reshape(m + 1, m) for r in parts.collect()}
    whole = sum(by_fold.values())

    def solve(t):
        return np.linalg.solve(t[:m] + RIDGE * max(1.0, t[m - 1, m - 1]) * np.eye(m), t[m])

    final = solve(whole)
    without = {f: solve(whole - t) if (whole - t)[m - 1, m - 1] > 0 else final for f, t in by_fold.items()}

    def out_of_fold(batches):
        for b in batches:
            if b.num_rows:
                z, k = cosines(np.array(b["f"].to_pylist())), b["fold"].to_numpy()
                raw = np.einsum("ij,ij->i", z, np.array([without[f] for f in k]))
                cell = np.clip(np.round((raw + 0.5) / 2 * GRID), 0, GRID).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cell), b["y"]], ["cell", "y"])

    curve = train.mapInArrow(out_of_fold, "cell int, y double").groupBy("cell").agg(F.sum("y").alias("hits"), F.count(F.lit(1)).alias("n")).orderBy("cell").collect()
    x, p = isotonic(np.array([r["cell"] * 2 / GRID - 0.5 for r in curve]), np.array([r["hits"] for r in curve]), np.array([float(r["n"]) for r in curve]))

    def score(batches):
        for b in batches:
            if b.num_rows:
                raw = cosines(np.array(b["f"].to_pylist())) @ final
                # A hundredth of the raw score orders rows that share a step of the curve.
                s = 0.99 * np.interp(raw, x, p) + 0.01 * np.clip((raw + 0.5) / 2, 0, 1)
                yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(s)], ["doc_id", "score"])

    scored = stats.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
