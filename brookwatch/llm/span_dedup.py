"""Substring deduplication over sliding sentence spans.

A text is cut into sentences: after a word that ends with . ! or ?, at a line break, and, so that long sentences and
texts without marks are divided too, after every word whose hash is a multiple of `CUT`; equal passages are thus divided
alike, wherever they stand.  From every sentence the shortest run of consecutive sentences that reaches `min_words`
words is hashed (96 bits), and so is the shortest such run up to every sentence.  Equal runs meet in one aggregation that keeps each run's first document, and
all sentences that a run covers in any later document are removed.  A repeated passage
with `min_words` words or more in whole sentences loses all of these; what it shares of the sentences at its ends stays.

The texts are read twice: hashes and ids alone are shuffled to find the repeated runs, then a fixed-size filter of these finds
the documents that hold some, and an exact join decides.  Texts without a cut are not shuffled.

Words are compared without the case of A-Z and white space is any run of space, tab, line feed, vertical tab, form feed and
carriage return.  The first document is the one with the smallest doc_id; a null id is one document before all others.  Rows
with one id are one document: what they share is no repeat.  Repeats within a document stay, unless `within` is
set, as op2_span_dedup does, when each later occurrence that does not overlap the first one goes too.  Null and empty texts have no sentences and become
the empty text.  Only the two named columns are read, so other columns cannot clash.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, arrow_map, bit_filter, byte_hashes, dropped, flagged, in_filter, mix64, range_hashes, split, stored, text_key, text_of

MIN_WORDS, CUT = 30, 8
_MARK = np.isin(np.arange(256), [ord(c) for c in ".!?"])


class Sentences:
    """The sentences of a text: `at` has the byte where each starts (0 first) and the text's length, `size` its words."""

    def __init__(self, raw: bytes):
        b = np.frombuffer(raw.lower(), np.uint8)
        start, end = split(b, SPACES)
        self.raw, self.words = raw, byte_hashes(b, start, end)
        lines = np.cumsum(np.concatenate([[0], b == 10]))
        after = np.append(start[1:], len(b))
        last = _MARK[b[end - 1]] | (lines[after] > lines[end]) | (self.words % np.uint64(CUT) == 0) if len(end) else np.zeros(0, bool)
        if len(last):
            last[-1] = True
        first = np.flatnonzero(np.concatenate([[True], last[:-1]])) if len(last) else np.zeros(0, np.int64)
        self.edge = np.append(first, len(start))  # words before each sentence, and all
        self.size = np.diff(self.edge)
        self.at = np.append(start[first], len(b))
        if len(first):
            self.at[0] = 0

    def runs(self, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first sentence, end, 64-bit hash, 32-bit hash) of the shortest runs of min_words words from and up to each sentence."""
        n, least = len(self.size), max(1, min_words)
        to = np.searchsorted(self.edge, self.edge[:-1] + least)
        back = np.searchsorted(self.edge, self.edge[1:] - least, side="right") - 1
        forward, backward = np.flatnonzero(to <= n), np.flatnonzero(back >= 0)
        both = np.unique(np.concatenate([forward * (n + 1) + to[forward], back[backward] * (n + 1) + backward + 1]))
        pos, end = both // (n + 1), both % (n + 1)
        lo, hi = self.edge[pos], self.edge[end]
        return pos, end, range_hashes(self.words, lo, hi).view(np.int64), (range_hashes(mix64(~self.words), lo, hi) >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def without(self, dead: np.ndarray) -> str:
        """The text without the sentences marked in dead."""
        return b"".join(self.raw[a:z] for a, z, d in zip(self.at.tolist(), self.at[1:].tolist(), dead.tolist()) if not d).decode()


def sentences(text: str | None) -> list[str]:
    """Pieces of the text, white space included, that join to the text."""
    s = Sentences((text or "").encode())
    return [s.raw[a:z].decode() for a, z in zip(s.at.tolist(), s.at[1:].tolist())]


def _hashes(min_words: int):
    def rows(c):
        doc, h, g = [], [], []
        for i, text in zip(c["doc"], c["text"]):
            _, _, x, y = Sentences(text.encode()).runs(min_words)
            x, at = np.unique(x, return_index=True)
            doc.append(np.full(len(x), i))
            h.append(x)
            g.append(y[at])
        return {"doc": np.concatenate(doc), "h": np.concatenate(h), "g": np.concatenate(g)} if doc else None

    return rows


def _again(pos, end, h, g) -> np.ndarray:
    """Which runs of a text repeat an earlier one of it, of those that are equal the first, that they do not overlap."""
    dead = np.zeros(len(h), bool)
    if len(np.unique(h)) < len(h):
        first: dict = {}
        for i, (a, z, *key) in enumerate(zip(*(x.tolist() for x in (pos, end, h, g)))):
            dead[i] = first.setdefault(tuple(key), z) <= a
    return dead


def _held(packed, min_words: int, within: bool):
    """The runs that the filter of repeated ones lets through, with their places; `own` are those that repeat within their text."""

    def rows(c):
        out = {k: [] for k in ("doc", "key", "h", "g", "pos", "end", "own")}
        for i, key, text in zip(c["doc"], c["key"], c["text"]):
            pos, end, h, g = Sentences(text.encode()).runs(min_words)
            own = _again(pos, end, h, g) if within else np.zeros(len(h), bool)
            keep = own | in_filter(packed.value, h)
            for k, v in zip(out, ([i] * int(keep.sum()), [key] * int(keep.sum()), h[keep], g[keep], pos[keep], end[keep], own[keep])):
                out[k].extend(v if isinstance(v, list) else v.tolist())
        return out

    return rows


def _cut(c):
    texts, gone = [], []
    for text, cuts in zip(c["text"], c["cuts"]):
        s = Sentences(text.encode())
        dead = np.zeros(len(s.size), bool)
        for r in cuts or ():
            dead[r["pos"] : r["end"]] = True
        texts.append(s.without(dead) if dead.any() else text)
        gone.append(np.flatnonzero(dead).tolist())
    return {"doc_id": c["doc_id"], "text": texts, "removed": gone}


def span_dedup(docs: DataFrame, min_words: int = MIN_WORDS, within: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, removed) for every row of docs; removed lists the numbers of the sentences taken out."""
    id_ = F.col(id_col).cast("long")
    rows = docs.select(id_.alias("doc_id"), F.coalesce(id_, F.lit(-(1 << 63))).alias("doc"), text_of(text_col).alias("text"))
    hashes = arrow_map(rows.select("doc", "text"), _hashes(min_words), "doc long, h long, g int", 64)
    again = hashes.groupBy("h", "g").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").select("h", "g", "first")
    again = stored(again)
    packed = docs.sparkSession.sparkContext.broadcast(bit_filter(again.select("h")))
    keyed = rows.select("doc", text_key("text").alias("key"), "text")
    held = arrow_map(keyed, _held(packed, min_words, within), "doc long, key binary, h long, g int, pos int, end int, own boolean", 64)
    later = held.join(again, ["h", "g"], "left").filter("own OR first < doc")
    cuts = stored(later.groupBy("doc", "key").agg(F.collect_set(F.struct("pos", "end")).alias("cuts")))
    dropped(again)
    made = "doc_id long, text string, removed array<int>"
    marked = flagged(rows, "doc", stored(cuts.select("doc").distinct()), "maybe")
    whole = marked.filter("NOT maybe").select("doc_id", "text", F.array().cast("array<int>").alias("removed"))
    some = marked.filter("maybe").withColumn("key", text_key("text")).join(cuts, ["doc", "key"], "left")
    return whole.unionByName(arrow_map(some.select("doc_id", "text", "cuts"), _cut, made, 64))
