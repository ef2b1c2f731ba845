"""Packing by cutting-stock column generation.

A document's tokens are cut into full sequences and a rest; the rests are the items of a
cutting-stock problem.  Their length histogram (a row for each class of lengths, so its size does not
grow with the input) goes to the driver, where a linear program over packing patterns is solved by
column generation: a knapsack dynamic program prices new patterns against the duals.  Patterns are
rounded down, what is left is packed best-fit-decreasing, and rests, ranked within their class by
distributed counts, take the patterns' places.

The program works on lengths rounded up to `width` tokens.  Items of at most `SHORT` tokens are classes by their exact length
and stay out of it: they fill the room that the patterns leave, and then sequences of their own.

An empty or null text is one end token.  Nothing is dropped.  Repeated rows, and rows with one id, are documents of their own, each
with pieces from start 0; a null id stays null.  Which of two pieces of equal class takes which place is decided by their
partitions and their order in these, and may differ between runs.  Only the two named columns are read, so other
columns cannot clash.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

CAPACITY = 2048
#: Lengths are rounded up to this many tokens for the linear program; the rounding is the only padding it causes.
WIDTH = 8
#: Lengths up to this are classes by themselves.
SHORT = 128
END = 1
ENDOFTEXT = "<|endoftext|>"


@lru_cache(maxsize=2)
def _tokenizers(json_file: str, ranks_file: str):
    """The tokenizer, and a faster encoder of the same vocabulary for texts without its special token."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(ranks_file), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(ranks_file, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Tokenizer.from_file(public_tokenizers.path(json_file)), fast


def encode(text: str | None, json_file: str = "byte_bpe_50k.json", ranks_file: str = "byte_bpe_50k.tiktoken") -> np.ndarray:
    """Ids as tokenizers gives them with add_special_tokens=False, then the end id, as little-endian uint32."""
    exact, fast = _tokenizers(json_file, ranks_file)
    text = text or ""
    ids = exact.encode(text, add_special_tokens=False).ids if ENDOFTEXT in text else fast.encode_ordinary(text)
    return np.array([*ids, END], dtype="<u4")


@dataclass(frozen=True)
class Plan:
    """Rows (class, from rank, to rank, first sequence, sequences, place), and the number of sequences."""

    rows: list[tuple[int, int, int, int, int, int]]
    sequences: int


def _knapsack(value: np.ndarray, size: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of classes within room, by dynamic programming over room."""
    # Sizes ascend; a class worth no more than a smaller one is never taken.
    kept = np.flatnonzero(value > np.maximum.accumulate(np.concatenate([[0.0], value[:-1]])))
    worth, sizes = value[kept], size[kept]
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    for r, k in enumerate(np.searchsorted(sizes, np.arange(room + 1), side="right")):
        if not k:
            continue
        gain = best[r - sizes[:k]] + worth[:k]
        i = int(gain.argmax())
        if gain[i] > best[r - 1] + 1e-12:
            best[r], took[r] = gain[i], kept[i]
        else:
            best[r] = best[r - 1]
    pattern, r = np.zeros(len(size), np.int64), room
    while r > 0:
        if took[r] < 0:
            r -= 1
            continue
        pattern[took[r]] += 1
        r -= int(size[took[r]])
    return float(best[room]), pattern


def _pivot(inverse: np.ndarray, column: int, direction: np.ndarray) -> np.ndarray:
    row = inverse[column] / direction[column]
    out = inverse - np.outer(direction, row)
    out[column] = row
    return out


def column_generation(size: np.ndarray, demand: np.ndarray, room: int, rounds: int = 3000, gap: float = 2e-3) -> tuple[np.ndarray, np.ndarray]:
    """Basic patterns (a column each) and their fractional use: the revised simplex method on the master program.

    Started from one-class patterns; a pattern enters while the knapsack finds one of reduced cost below -gap,
    so the program's value is within that share of the least.  Demands are set apart by a little, against
    degenerate pivots.
    """
    m = len(size)
    demand = demand + 1e-3 * (1 + np.arange(m) * 0.6180339887 % 1)
    basis = np.diag((room // size).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    for _ in range(rounds):
        duals = inverse.sum(axis=0)  # costs are all 1
        value, pattern = _knapsack(np.maximum(duals, 0), size, room)
        if value <= 1 + gap:
            break
        use, direction = np.einsum("ij,j->i", inverse, demand), np.einsum("ij,j->i", inverse, pattern.astype(float))
        ok = direction > 1e-9
        leaving = int(np.where(ok, use / np.where(ok, direction, 1), np.inf).argmin())
        basis[:, leaving] = pattern
        inverse = _pivot(inverse, leaving, direction)
    return basis.astype(np.int64), np.maximum(np.einsum("ij,j->i", inverse, demand), 0)


def class_of(length: int, width: int) -> int:
    return length if length <= SHORT else SHORT - (SHORT - length) // width


def bound_of(c: int, width: int) -> int:
    """The greatest length of class c."""
    return c if c <= SHORT else SHORT + (c - SHORT) * width


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY, width: int = WIDTH) -> Plan:
    """Places for every item of the histogram {class: count}."""
    classes = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[c] for c in classes], np.int64)
    tokens = np.array([min(capacity, bound_of(c, width)) for c in classes.tolist()], np.int64)
    long = np.flatnonzero(classes > SHORT)
    room, units = capacity // width, np.minimum(-(-tokens // width), capacity // width)
    used, rows, sequence = np.zeros(len(classes), np.int64), [], 0

    def filled(pattern: np.ndarray, times: int, of: np.ndarray) -> np.ndarray:
        """Adds the largest items of the classes `of` that fit and of which there are enough for all `times`."""
        pattern, free = pattern.copy(), capacity - int(pattern @ tokens)
        for c in of[::-1]:
            take = int(min((left[c] - pattern[c] * times) // times, free // tokens[c]))
            pattern[c], free = pattern[c] + take, free - take * int(tokens[c])
        return pattern

    def place(pattern: np.ndarray, times: int) -> None:
        nonlocal sequence
        at = 0
        for c in np.flatnonzero(pattern)[::-1]:
            for _ in range(int(pattern[c])):
                rows.append((int(classes[c]), int(used[c]), int(used[c]) + times, sequence, times, at))
                used[c] += times
                at += 1
        left[:] = left - pattern * times
        sequence += times

    if len(long):
        patterns, use = column_generation(units[long], left[long].astype(float), room)
        for j in np.argsort(-use, kind="stable"):
            pattern = np.zeros(len(classes), np.int64)
            pattern[long] = patterns[:, j]
            fit = [left[c] // pattern[c] for c in np.flatnonzero(pattern)]
            if times := int(min([int(use[j] + 1e-9), *fit])):
                place(filled(pattern, times, np.flatnonzero(classes <= SHORT)), times)
    while left.any():  # what rounding left, and short items: largest first into the best fit
        pattern = filled(np.zeros(len(classes), np.int64), 1, np.arange(len(classes)))
        place(pattern, int(min(left[c] // pattern[c] for c in np.flatnonzero(pattern))))
    return Plan(rows, sequence)


def _pieces(capacity: int, width: int):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "part", "local"]

    def run(batches):
        part, ranks = TaskContext.get().partitionId(), {}
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"]):
                ids = encode(text.as_py())
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    c = class_of(len(piece), width)
                    rank = ranks[c] = ranks.get(c, -1) + 1
                    out.append((doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), c, part, rank))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else [()] * 8)], names)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, width: int = WIDTH) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece."""
    spark = docs.sparkSession
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class long, part long, local long"
    pieces = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_pieces(capacity, width), kinds))
    counts = pieces.groupBy("class", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    plan = make_plan({r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}, capacity, width)
    # Bounded by the classes and their patterns: at most capacity / width basic patterns, and as many again for the rounding.
    by_class: dict[int, list] = {}
    for row in plan.rows:
        by_class.setdefault(row[0], []).append(row[1:])
    tables = spark.sparkContext.broadcast({c: np.array(sorted(v), np.int64) for c, v in by_class.items()})

    def assign(batches):
        for b in batches:
            c, rank = b["class"].to_numpy(), b["rank"].to_numpy()
            sequence, place = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
            for k in np.unique(c):
                rows, at = tables.value[int(k)], np.flatnonzero(c == k)
                hit = np.searchsorted(rows[:, 0], rank[at], side="right") - 1
                sequence[at] = rows[hit, 2] + (rank[at] - rows[hit, 0]) % rows[hit, 3]
                place[at] = rows[hit, 4]
            yield pa.RecordBatch.from_arrays([*(b[n] for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(sequence), pa.array(place)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "place"])

    ranked = pieces.join(before.select("class", "part", "before"), ["class", "part"]).withColumn("rank", F.col("local") + F.col("before"))
    placed = ranked.mapInArrow(assign, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, place long")
    earlier = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", (F.sum("length").over(earlier) - F.col("length")).alias("offset"))
