"""Language-model scores by context-tree weighting over bytes.

A text is its lower-cased words joined by a space and closed by a line feed.  Every byte is eight binary
decisions; each decision has a context tree over the `depth` bytes before it.  A node estimates its
decision by Krichevsky-Trofimov from the training rows' counts, and the trees' weights, the
posterior shares of "this node" against "its children", come from the same counts, bottom up.

The model's definition, where it departs from the textbook: a tree is `depth` bytes deep (5, 4 to 6 offered), and a
byte's probability mixes the estimates of all depths from the root down to the deepest context seen in training.
That deepest node's own estimate ends the mix; the textbook would mix in 1/2 for contexts never seen, which
costs code length and adds no knowledge.

The input is read once, in blocks of a bounded size.  A block sends its distinct (context, byte) keys and
words with counts and gets back one number for each, so nothing that grows with the corpus reaches
the driver or a broadcast.  Subtrees below three bytes of context are worked out in order by streaming tasks, which
write their keys as chunks of whole subtrees; only the top of the trees (at most 65,536 contexts of 255 decisions)
passes through the driver.  Chunks are then mixed with the top, and answers travel as one compressed blob for
each block and batch.  A task holds one chunk, or one block's answers and one piece of its texts.

Null and empty texts consist of the end alone.  A null doc_id has the fold of empty text.  Repeated rows count
and are scored as often as they occur.  Without training rows every decision has probability 1/2.  Only the two
named columns are read, so other columns cannot clash.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, stored, words

DEPTH, TOP = 5, 3
END = b"\n"
#: A block keeps only its distinct keys and words; its text passes through in pieces.
BLOCK_BYTES, PIECE_BYTES = 32 << 20, 1 << 20
#: Rows that a streaming task gathers before it works out the subtrees that are complete, and rows mixed at a time.
CHUNK, PART = 200_000, 50_000
LN10 = np.log(10.0)

_K = np.arange(1, 1 << 16, dtype=float)
_HALF = np.concatenate([[0.0], np.cumsum(np.log(_K - 0.5))])
_WHOLE = np.concatenate([[0.0], np.cumsum(np.log(_K))])


def _log_gamma(n: np.ndarray, shift: float, small: np.ndarray) -> np.ndarray:
    """log(Gamma(n + shift) / Gamma(shift)) for whole n: a table, Stirling's series beyond it."""
    n = np.asarray(n, float)
    x = np.maximum(n + shift, 1.0)
    series = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    first = 0.5 * np.log(np.pi) if shift == 0.5 else 0.0
    return np.where(n < len(small), small[np.minimum(n, len(small) - 1).astype(np.int64)], series - first)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _log_gamma(a, 0.5, _HALF) + _log_gamma(b, 0.5, _HALF) - _log_gamma(np.asarray(a, float) + b, 1.0, _WHOLE)


def _weigh(a: np.ndarray, b: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log weighted probability, the node's own share) of nodes with counts a, b and their children's log product."""
    own = log_kt(a, b)
    return np.logaddexp(own, below) - np.log(2.0), 1 / (1 + np.exp(np.clip(below - own, -700, 700)))


def stream(text: str | None) -> bytes:
    return b" ".join(words(text)) + END


def keys(streams: list[bytes], depth: int = DEPTH) -> np.ndarray:
    """The key of every byte: the byte before it first, then older ones (0 before the start), the byte itself last."""
    pad = bytes(depth)
    flat = np.frombuffer(b"".join(x for s in streams for x in (pad, s)), np.uint8).astype(np.int64)
    out = flat[depth:].copy()
    for d in range(1, depth + 1):
        out |= flat[depth - d : len(flat) - d] << (8 * (depth - d + 1))
    own = np.ones(len(out), bool)
    ends = np.cumsum([len(s) + depth for s in streams])[:-1] - depth
    for d in range(depth):
        own[ends + d] = False
    return out[own]


def _sums(streams: list[bytes], known: np.ndarray, value: np.ndarray, depth: int) -> list[float]:
    """The sum of the values of each text's keys; keys are sorted with their text's number below, so each is looked up once."""
    out: list[float] = []
    room = np.uint64(64 - 8 * (depth + 1))
    for at in range(0, len(streams), 1 << int(room)):
        part = streams[at : at + (1 << int(room))]
        text = np.repeat(np.arange(len(part), dtype=np.uint64), [len(s) for s in part])
        both = np.sort(keys(part, depth).view(np.uint64) << room | text)
        k = (both >> room).view(np.int64)
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        found = np.repeat(value[np.searchsorted(known, k[first])], np.diff(np.append(first, len(k))))
        out += np.bincount((both & ((np.uint64(1) << room) - np.uint64(1))).astype(np.int64), found, len(part)).tolist()
    return out


def _whole_contexts(k: np.ndarray, shift: int) -> list[tuple[int, int]]:
    """Cuts ascending keys into runs [start, end) of about `PART` keys that end where a context, k >> shift, ends."""
    starts = np.flatnonzero(np.concatenate([[True], (k[1:] >> shift) != (k[:-1] >> shift)]))
    cuts = np.unique(starts[np.searchsorted(starts, np.arange(0, starts[-1] + 1, PART))]) if len(k) else starts
    return list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(k)]))


def _groups(k: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of each row's group, first row of each group) for decision j; k ascends."""
    g = k >> (8 - j)
    new = np.concatenate([[True], g[1:] != g[:-1]])
    return np.cumsum(new) - 1, np.flatnonzero(new)


def subtrees(k: np.ndarray, n: np.ndarray, depth: int, top: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Works out whole subtrees below `top` bytes of context.

    k holds distinct ascending keys, n their counts.  Returns each key's eight probabilities at depth `top`
    (-1: context not seen), and the nodes there: (key, zeros, ones, log weighted probability), the
    key being the context shifted by 8 with the decision's number.
    """
    levels, count, back = [k], [np.asarray(n, float)], []
    for _ in range(depth - top):
        up, inverse = np.unique((levels[-1] >> 16 << 8) | (levels[-1] & 255), return_inverse=True)
        back.append(inverse)
        levels.append(up)
        count.append(np.bincount(inverse, count[-1], len(up)))
    q = np.empty((len(k), 8), np.float32)
    nodes = []
    for j in range(8):
        path = np.arange(len(k))
        made, weights = [], None
        for i, (level, c) in enumerate(zip(levels, count)):
            group, first = _groups(level, j)
            one = (level >> (7 - j)) & 1
            ones = np.bincount(group, c * one, len(first))
            zeros = np.bincount(group, c * (1 - one), len(first))
            if i == 0:
                total, share = log_kt(zeros, ones), np.ones(len(first))
            else:
                below = np.bincount(group[back[i - 1][before]], weights, len(first))
                total, share = _weigh(zeros, ones, below)
                path = back[i - 1][path]
            at = group[path]
            hit = np.where(one[path] == 1, ones[at], zeros[at])
            seen = zeros[at] + ones[at]
            made.append(((hit + 0.5) / (seen + 1), share[at], seen > 0))
            weights, before = total, first
        p = made[0][0]
        for (_, _, deeper), (kt, share, _) in zip(made, made[1:]):
            p = np.where(deeper, share * kt + (1 - share) * p, kt)
        q[:, j] = np.where(made[-1][2], p, -1)
        base = levels[-1][first]
        nodes.append(((base >> 8 << 8) | (1 << j) | ((base & 255) >> (8 - j)), zeros, ones, weights))
    return q, tuple(np.concatenate(x) for x in zip(*nodes))


class Top:
    """The trees' first levels: for each depth the sorted node keys, counts and shares."""

    def __init__(self, k: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray, depth: int):
        self.levels = []
        for d in range(depth, -1, -1):
            if d < depth:
                up, at = np.unique((k >> 16 << 8) | (k & 255), return_inverse=True)
                zeros, ones, below = (np.bincount(at, x, len(up)) for x in (zeros, ones, total))
                k = up
            total, share = _weigh(zeros, ones, below)
            self.levels.append((k, zeros, ones, share))

    def mix(self, k: np.ndarray, q: np.ndarray, depth: int) -> np.ndarray:
        """log10 of the probability of every key's byte, from its eight probabilities below (-1: none)."""
        out = np.zeros(len(k))
        sym = k & 255
        for j in range(8):
            p, one = q[:, j].astype(float), (sym >> (7 - j)) & 1
            for d, (nodes, zeros, ones, share) in zip(range(len(self.levels) - 1, -1, -1), self.levels):
                want = (k >> (8 * (depth - d + 1)) << 8) | (1 << j) | (sym >> (8 - j))
                if not len(nodes):
                    p = np.full(len(k), 0.5)
                    continue
                at = np.minimum(np.searchsorted(nodes, want), len(nodes) - 1)
                found = nodes[at] == want
                z, o = np.where(found, zeros[at], 0), np.where(found, ones[at], 0)
                kt = (np.where(one == 1, o, z) + 0.5) / (z + o + 1)
                p = np.where(p >= 0, share[at] * kt + (1 - share[at]) * p, np.where((z + o > 0) | (d == 0), kt, -1))
            out += np.log(p)
        return out / LN10


def _pack(depth: int, block_bytes: int):
    """Rows of a table of three kinds: texts (ids, sizes, data), keys (gram, n) and words (word, n), each of a block."""
    import zstandard

    kinds = {"block": pa.int64(), "ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64()), "data": pa.binary(), "gram": pa.int64(), "word": pa.binary(), "n": pa.int64()}

    def rows(**given):
        size = len(next(iter(given.values())))
        return pa.RecordBatch.from_arrays([given[k] if k in given else pa.nulls(size, t) for k, t in kinds.items()], list(kinds))

    def merge(kept, gram, n):
        """Sums two tables of ascending keys and counts."""
        both, count = np.concatenate([kept[0], gram]), np.concatenate([kept[1], n])
        order = np.argsort(both, kind="stable")
        both, count = both[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
        return both[first], np.add.reduceat(count, first) if len(first) else count

    def run(batches):
        from pyspark import TaskContext

        none = np.zeros(0, np.int64)
        block, size = TaskContext.get().partitionId() << 32, 0
        piece, room, grams, learnt, other = ([], [], []), 0, (none, none), Counter(), set()

        def cut(ids, held, streams):
            nonlocal grams
            for out in (False, True):
                part = [s for s, h in zip(streams, held) if h == out]
                if part:
                    gram, n = np.unique(keys(part, depth), return_counts=True)
                    grams = merge(grams, gram, n * 0 if out else n)
            return rows(block=pa.array([block]), ids=pa.array([ids], kinds["ids"]), sizes=pa.array([[len(s) for s in streams]], kinds["sizes"]), data=pa.array([zstandard.compress(b"".join(streams), 3)], pa.binary()))

        def flush():
            for w in other:
                learnt[w] += 0
            learnt[END] += 0
            for name, of, kind in (("gram", grams, pa.int64()), ("word", (list(learnt), list(learnt.values())), pa.binary())):
                for at in range(0, len(of[0]), 50_000):
                    part = pa.array(of[0][at : at + 50_000], kind)
                    yield rows(**{"block": pa.array(np.full(len(part), block)), name: part, "n": pa.array(of[1][at : at + 50_000], pa.int64())})

        for b in batches:
            for i, h, t in zip(b["doc_id"], b["held_out"], b["text"]):
                s, h = stream(t.as_py()), h.as_py()
                for to, x in zip(piece, (i.as_py(), h, s)):
                    to.append(x)
                if h:
                    other.update(s.split())
                else:
                    learnt.update(s.split())
                    learnt[END] += 1
                size, room = size + len(s), room + len(s)
                if room >= min(PIECE_BYTES, block_bytes):
                    yield cut(*piece)
                    piece, room = ([], [], []), 0
                if size >= block_bytes:
                    if room:
                        yield cut(*piece)
                    yield from flush()
                    block, size = block + 1, 0
                    piece, room, grams, learnt, other = ([], [], []), 0, (none, none), Counter(), set()
        if room:
            yield cut(*piece)
        if size:
            yield from flush()

    return run


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as one blob: the first, ascending int64, as gaps; the others as they are."""
    import zstandard

    first = np.diff(arrays[0], prepend=np.int64(0))
    planes = [np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() for x in (first, *arrays[1:])]
    return zstandard.compress(b"".join(planes), 1)


def _expand(blob: bytes, *kinds: type) -> list[np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    widths = [np.dtype(k).itemsize for k in (np.int64, *kinds)]
    n, out, at = len(raw) // sum(widths), [], 0
    for k, w in zip((np.int64, *kinds), widths):
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).view(k).ravel())
        at += n * w
    return [np.cumsum(out[0]), *out[1:]]


def _chunks(depth: int, top: int):
    """Streams keys in order, a chunk of whole subtrees at a time: a row (chunk) and the rows (node, zeros, ones, total)."""
    names = ["chunk", "node", "zeros", "ones", "total"]

    def solved(k, n):
        _, (node, zeros, ones, total) = subtrees(k, n, depth, top)
        yield pa.RecordBatch.from_arrays([pa.array([_squeeze(k, n.astype(np.int64))], pa.binary()), pa.nulls(1, pa.int64()), *(pa.nulls(1, pa.float64()) for _ in range(3))], names)
        for at in range(0, len(node), 50_000):
            part = [pa.array(x[at : at + 50_000]) for x in (node, zeros, ones, total)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(part[0]), pa.binary()), *part], names)

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append((b["gram"].to_numpy(), b["n"].to_numpy()))
            size += b.num_rows
            k = held[-1][0] >> (8 * (depth - top + 1))
            if size < CHUNK or k[0] == k[-1] == held[0][0][0] >> (8 * (depth - top + 1)):
                continue
            whole, n = (np.concatenate(x) for x in zip(*held))
            at = np.searchsorted(whole >> (8 * (depth - top + 1)), k[-1])
            if at:
                yield from solved(whole[:at], n[:at])
                held, size = [(whole[at:], n[at:])], len(whole) - at
        if size:
            yield from solved(*(np.concatenate(x) for x in zip(*held)))

    return run


def _replies(batches):
    """Rows in order of (block, gram), or (block, word): one blob for each block's run of rows in a batch."""
    for b in batches:
        if not b.num_rows:
            continue
        block = b["block"].to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), b.num_rows]
        grams, blobs = [], []
        for lo, hi in zip(edges, edges[1:]):
            part = b.slice(lo, hi - lo)
            grams.append("gram" in b.schema.names)
            blobs.append(_squeeze(part["gram"].to_numpy(), part["value"].to_numpy().astype(np.float32)) if grams[-1] else _words_blob(part["word"].to_pylist(), part["value"].to_numpy()))
        yield pa.RecordBatch.from_arrays([pa.array(block[edges[:-1]]), pa.array(grams), pa.array(blobs, pa.binary())], ["block", "grams", "blob"])


def _words_blob(words_: list[bytes], n: np.ndarray) -> bytes:
    """Words hold no white space but for the end's line feed, so a space parts them."""
    import zstandard

    return zstandard.compress(len(words_).to_bytes(8, "little") + n.astype("<i8").tobytes() + b" ".join(words_), 1)


def _words_of(blob: bytes) -> tuple[list[bytes], list[int]]:
    import zstandard

    raw = zstandard.decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    return raw[8 + 8 * n :].split(b" "), np.frombuffer(raw[8 : 8 + 8 * n], "<i8").tolist()


def context_tree_scores(docs: DataFrame, modulus: int = 10, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the
    text's probability) and bits_per_byte (its code length); rows of fold 0 of `modulus` never train."""
    if not TOP < depth <= 6:
        raise ValueError("depth must be 4, 5 or 6, so that a key fits 7 bytes")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("held_out", fold_of(modulus) == 0)
    packed = stored(rows.mapInArrow(_pack(depth, block_bytes), "block long, ids array<long>, sizes array<long>, data binary, gram long, word binary, n long"))
    grams, terms = packed.filter("gram IS NOT NULL").select("block", "gram", "n"), packed.filter("word IS NOT NULL").select("block", "word", "n")

    context = F.shiftright("gram", 8 * (depth - TOP + 1))
    merged = grams.groupBy("gram").agg(F.sum("n").alias("n")).repartition(context).sortWithinPartitions("gram")
    chunks = stored(merged.mapInArrow(_chunks(depth, TOP), "chunk binary, node long, zeros double, ones double, total double"))
    # Nodes at TOP bytes of context, summed to those at TOP - 1: at most 65,536 contexts of 255 decisions.
    parent = F.shiftleft(F.shiftright("node", 16), 8).bitwiseOR(F.col("node").bitwiseAND(F.lit(255).cast("long")))
    first = chunks.filter("node IS NOT NULL").groupBy(parent.alias("node")).agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "total")]).toArrow().sort_by("node")
    trees = spark.sparkContext.broadcast(Top(*(first[c].to_numpy() for c in ("node", "zeros", "ones", "total")), TOP - 1))

    def mix(batches):
        for b in batches:
            for blob in b["chunk"]:
                k, n = _expand(blob.as_py(), np.int64)
                for lo, hi in _whole_contexts(k, 8 * (depth - TOP + 1)):
                    q, _ = subtrees(k[lo:hi], n[lo:hi], depth, TOP)
                    value = trees.value.mix(k[lo:hi], q, depth).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array(k[lo:hi]), pa.array(value)], ["gram", "value"])

    value = chunks.filter("chunk IS NOT NULL").select("chunk").mapInArrow(mix, "gram long, value float")
    counts = terms.groupBy("word").agg(F.sum("n").alias("value"))
    sums = counts.agg(F.coalesce(F.sum("value"), F.lit(0)).alias("n"), F.count_if(F.col("value") > 0).alias("v")).first()
    total, distinct = int(sums["n"]), int(sums["v"])
    of_grams = grams.select("block", "gram").join(value, "gram").sortWithinPartitions("block", "gram").select("block", "gram", "value")
    of_words = terms.select("block", "word").join(counts, "word").sortWithinPartitions("block").select("block", "word", "value")
    replies = of_grams.mapInArrow(_replies, "block long, grams boolean, blob binary").unionByName(of_words.mapInArrow(_replies, "block long, grams boolean, blob binary"))

    def score(texts: pa.Table, given: pa.Table) -> pa.Table:
        import zstandard

        of_gram, count = [], {}
        for is_gram, blob in zip(given["grams"].to_pylist(), given["blob"]):
            if is_gram:
                of_gram.append(_expand(blob.as_py(), np.float32))
            else:
                count.update(zip(*_words_of(blob.as_py())))
        known, value = (np.concatenate(x) for x in zip(*of_gram))
        order = np.argsort(known)
        known, value = known[order], value[order]
        out = {name: [] for name in ("doc_id", "n_tokens", "n_known", "base_score", "score", "bytes")}
        for ids, sizes, data in zip(*(texts[c].to_pylist() for c in ("ids", "sizes", "data"))):
            data, ends = zstandard.decompress(data), np.cumsum(sizes)
            streams = [data[e - n : e] for e, n in zip(ends.tolist(), sizes)]
            tokens, n_tokens = [], []
            for s in streams:
                w = s.split()
                tokens += w
                tokens.append(END)
                n_tokens.append(len(w) + 1)
            c = np.fromiter(map(count.__getitem__, tokens), float, len(tokens))
            first = np.cumsum([0, *n_tokens[:-1]])
            out["doc_id"] += ids
            out["n_tokens"] += n_tokens
            out["n_known"] += np.add.reduceat((c > 0).astype(np.int64), first).tolist()
            out["base_score"] += np.add.reduceat(np.log10((c + 0.1) / (total + 0.1 * (distinct + 1))), first).tolist()
            out["score"] += _sums(streams, known, value, depth)
            out["bytes"] += sizes
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()))], list(out))

    texts = packed.filter("data IS NOT NULL").select(F.col("block").alias("home"), "ids", "sizes", "data")
    out = texts.groupBy("home").cogroup(replies.groupBy("block")).applyInArrow(score, "doc_id long, n_tokens long, n_known long, base_score double, score double, bytes long")
    bits = -F.col("score") * F.lit(float(np.log2(10.0))) / F.col("bytes")
    return out.select("doc_id", (fold_of(modulus) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))
