"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. A pass over the texts leaves (doc_id, SHA-256 of the normalised text, sending partition).
2. Every sending partition sorts its distinct 64-bit fingerprints and sends each owner of a range
   of fingerprints one Golomb-Rice coded message.
3. Owners decode their messages and answer each with a bitmap: which of its fingerprints
   another partition sent too.
4. Partitions turn bitmaps into suspects.  Only suspects' texts are shuffled, one for each map task
   and distinct text thanks to partial aggregation, and grouped on the bytes themselves.

There is an owner for each `owner_prints` fingerprints, so gaps stay short and messages worth their coding however many
partitions send.  A hot text costs an owner one entry for each partition, and the byte check one row for each map
task.  Suspects are told by a bitmap sized by their count, then by an exact join.

Null texts count as empty and are copies of each other.  Ties go to the smallest doc_id.  Rows with the keeper's id and
an equal text are the kept document, so all of them stay; a row with a null id stays only if no row of its group has an
id, and then keep_id is null.  Only the two named columns are read, so other columns cannot clash.  An empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, dropped, flagged, looked_up, stored, text_of

#: Fingerprints of an owner: some tens of MB decoded.
OWNER_PRINTS = 4_000_000


def rice_encode(values: np.ndarray) -> tuple[int, bytes]:
    """Golomb-Rice code of ascending distinct uint64 values as gaps: unary quotients, then remainders."""
    n = len(values)
    if not n:
        return 0, b""
    gaps = np.diff(values, prepend=np.uint64(0))
    mean = max(1, int(values[-1]) // n)
    k = min(63, max(0, mean.bit_length() - 1))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    low = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    return k, len(unary).to_bytes(8, "little") + np.packbits(unary).tobytes() + np.packbits(low).tobytes()


def rice_decode(n: int, k: int, blob: bytes) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    length = int.from_bytes(blob[:8], "little")
    cut = 8 + (length + 7) // 8
    unary = np.unpackbits(np.frombuffer(blob[8:cut], np.uint8), count=length)
    ends = np.flatnonzero(unary)
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        low = np.unpackbits(np.frombuffer(blob[cut:], np.uint8), count=n * k).reshape(n, k).astype(np.uint64)
        gaps += (low << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def _digests(batches):
    part = TaskContext.get().partitionId()
    for b in batches:
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["digest"], pa.array(np.full(b.num_rows, part, np.int32))], ["doc_id", "digest", "part"])


def _fingerprints(digests) -> np.ndarray:
    return np.frombuffer(b"".join(x[:8] for x in digests.to_pylist()), ">u8").astype(np.uint64)


def _send(owners: int):
    def send(t: pa.Table) -> pa.Table:
        prints = np.unique(_fingerprints(t["digest"].combine_chunks()))
        to = (prints >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)
        rows = []
        for owner, first, n in zip(*np.unique(to, return_index=True, return_counts=True)):
            k, blob = rice_encode(prints[first : first + n])
            rows.append((t["part"][0].as_py(), int(owner), int(n), k, blob))
        cols = list(zip(*rows))
        return pa.table([pa.array(c, ty) for c, ty in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["part", "owner", "n", "k", "blob"])

    return send


def _answer(t: pa.Table) -> pa.Table:
    parts, ns, ks = (t[c].to_pylist() for c in ("part", "n", "k"))
    sent = [rice_decode(n, k, b.as_py()) for n, k, b in zip(ns, ks, t["blob"])]
    every = np.sort(np.concatenate(sent))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    maps = [np.packbits(np.isin(x, twice, assume_unique=True)).tobytes() for x in sent]
    return pa.table([pa.array(parts, pa.int32()), t["owner"], pa.array(ns, pa.int32()), pa.array(maps, pa.binary())], ["part", "owner", "n", "dups"])


def _suspect(prints: pa.Table, maps: pa.Table) -> pa.Table:
    if not prints.num_rows:
        return pa.table([pa.array([], pa.int64())], ["fp"])
    own, count = np.unique(_fingerprints(prints["digest"].combine_chunks()), return_counts=True)
    by_owner = sorted(zip(maps["owner"].to_pylist(), maps["n"].to_pylist(), maps["dups"].to_pylist()))
    flags = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for _, n, b in by_owner]) if by_owner else np.zeros(len(own), np.uint8)
    return pa.table([pa.array(own[(flags > 0) | (count > 1)].view(np.int64))], ["fp"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_prints: int = OWNER_PRINTS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs.

    Texts are equal when identical after every run of ASCII white space has become one space.
    """
    norm = docs.select(F.col(id_col).alias("doc_id"), F.regexp_replace(text_of(text_col), SPACE, " ").alias("norm"))
    norm = norm.withColumn("digest", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))
    prints = stored(norm.select("doc_id", "digest").mapInArrow(_digests, "doc_id long, digest binary, part int"))
    owners = max(1, -(-prints.count() // owner_prints))
    sent = prints.groupBy("part").applyInArrow(_send(owners), "part int, owner int, n int, k int, blob binary")
    answers = sent.groupBy("owner").applyInArrow(_answer, "part int, owner int, n int, dups binary")
    suspects = stored(prints.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_suspect, "fp long").distinct())
    fp = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
    texts = flagged(norm.withColumn("fp", fp), "fp", suspects, "maybe").filter("maybe")
    # One row for each map task and text before the shuffle, so a hot text is no hot key.
    checked = texts.groupBy("digest", "fp", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    checked = checked.join(suspects, "fp", "left_semi")
    groups = checked.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts"))
    groups = stored(groups.select("digest", "keep_id", F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share a SHA-256")).cast("long")).otherwise(F.col("group_size")).alias("group_size")))
    dropped(suspects)
    found = looked_up(prints.select("doc_id", "digest"), "digest", groups)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    kept = F.when(keep.isNull(), True).otherwise(F.coalesce(keep == F.col("doc_id"), F.lit(False)))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
