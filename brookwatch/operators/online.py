"""Online detectors and rate limits: state of a fixed size for each node, folded over its rows in order.

`fold` is the batch form: rows are dealt by key, sorted within partitions and streamed through the state, so a
task holds one state and one batch, however long a node's series is.  `fold_stream` is the same for streams.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Sizes of the detectors.
DIMS, PROJECTIONS, BINS, TREES, LEVELS, SATURATED = 8, 40, 16, 5, 5, 65535
CMS_ROWS, CMS_COLS = 4, 512
#: A node's states, and their names.
NORMAL, UNDER_ATTACK, RECOVERY = 0, 1, 2
STATES = ("NORMAL", "UNDER_ATTACK", "RECOVERY")


class Ewma:
    """(baseline before, baseline, alert) of each value; alerts above baseline * (1 + deviation) after the warm-up."""

    def __init__(self, alpha: float = 0.2, deviation: float = 2.0, warmup: int = 5):
        self.alpha = alpha if 0 < alpha <= 1 else 0.2
        self.deviation = deviation if deviation > 0 else 2.0
        self.warmup = warmup if warmup > 0 else 5
        self.seen, self.baseline = 0, 0.0

    def step(self, x: float) -> tuple[float, float, bool]:
        before = self.baseline
        self.seen += 1
        self.baseline = x if self.seen == 1 else self.alpha * x + (1 - self.alpha) * before
        return before, self.baseline, self.seen > self.warmup and before != 0 and x > before * (1 + self.deviation)


class Loda:
    """Sparse random projections with a histogram each; the score is the mean negative log frequency."""

    def __init__(self, seed: int = 42, warmup: int = 10):
        rng = np.random.default_rng(seed)
        self.w = (rng.normal(size=(PROJECTIONS, DIMS)) * (rng.random((PROJECTIONS, DIMS)) < 0.5)).astype(np.float32)
        self.warmup, self.n = (warmup if warmup >= 5 else 10), 0
        self.mean, self.m2 = np.zeros(DIMS), np.zeros(DIMS)
        self.low, self.width = np.zeros(PROJECTIONS), np.ones(PROJECTIONS)
        self.hist = np.zeros((PROJECTIONS, BINS), np.int64)

    @property
    def trained(self) -> bool:
        return self.n >= self.warmup

    def _cells(self, z: np.ndarray) -> np.ndarray:
        return np.clip(((z - self.low) / self.width).astype(np.int64), 0, BINS - 1)

    def _project(self, x: np.ndarray) -> np.ndarray:
        sd = np.sqrt(self.m2 / max(1, self.n - 1)) if self.n > 1 else np.zeros(DIMS)
        return (self.w @ np.where(sd > 1e-10, (x - self.mean) / np.maximum(sd, 1e-10), 0.0).astype(np.float32)).astype(float)

    def update(self, x: np.ndarray) -> None:
        self.n += 1
        off = x - self.mean
        self.mean = self.mean + off / self.n
        self.m2 = self.m2 + off * (x - self.mean)
        z = self._project(x)
        if self.n <= self.warmup:
            self.low = z.copy() if self.n == 1 else np.minimum(self.low, z)
            self.width = np.where(z > self.low + self.width * BINS, (z - self.low + 0.01) / BINS, self.width)
        at = np.arange(PROJECTIONS), self._cells(z)
        self.hist[at] = np.minimum(self.hist[at] + 1, SATURATED)

    def score(self, x: np.ndarray) -> float:
        if not self.trained:
            return 0.0
        share = self.hist[np.arange(PROJECTIONS), self._cells(self._project(x))] / self.hist.sum(axis=1)
        return float(-np.log(np.maximum(share, 1e-10)).mean())


class HalfSpaceTrees:
    """Complete random trees as arrays; the score weighs each node's change of mass against the window before."""

    def __init__(self, seed: int = 43, window: int = 50, normalise: bool = False):
        rng = np.random.default_rng(seed)
        size = (1 << (LEVELS + 1)) - 1
        self.dim, self.cut = rng.integers(0, DIMS, (TREES, size)), rng.normal(size=(TREES, size)).astype(np.float32)
        self.mass, self.reference = np.zeros((TREES, size)), np.zeros((TREES, size))
        self.window, self.seen, self.trained = (window if window >= 20 else 50), 0, False
        self.normalise, self.n, self.mean, self.m2 = normalise, 0, np.zeros(DIMS), np.zeros(DIMS)

    def _path(self, x: np.ndarray) -> np.ndarray:
        """Nodes from root to leaf in each tree."""
        if self.normalise and self.n > 1:
            x = (x - self.mean) / np.maximum(np.sqrt(self.m2 / (self.n - 1)), 1e-10)
        x, tree, node = x.astype(np.float32), np.arange(TREES), np.zeros(TREES, np.int64)
        out = [node]
        for _ in range(LEVELS):
            node = 2 * node + 1 + (x[self.dim[tree, node]] > self.cut[tree, node])
            out.append(node)
        return np.stack(out, 1)

    def update(self, x: np.ndarray) -> None:
        self.n += 1
        off = x - self.mean
        self.mean = self.mean + off / self.n
        self.m2 = self.m2 + off * (x - self.mean)
        self.mass[np.arange(TREES)[:, None], self._path(x)] += 1
        self.seen += 1
        if self.seen >= self.window:
            self.reference, self.mass, self.seen, self.trained = self.mass, np.zeros_like(self.mass), 0, True

    def score(self, x: np.ndarray) -> float:
        if not self.trained:
            return 0.0
        at = np.arange(TREES)[:, None], self._path(x)
        now, was = self.mass[at], self.reference[at]
        return float(((1 << np.arange(LEVELS + 1)) * np.abs(now - was) / np.maximum(now + was, 1)).sum() / TREES)


def sigmoid(x: float, centre: float, scale: float) -> float:
    return float(1 / (1 + np.exp(-(x - centre) / scale)))


class Ensemble:
    """Weighted sigmoids of LODA, half-space trees, z-score and EWMA residual; baselines rest while the last score is high."""

    def __init__(self, seed: int = 42, threshold: float = 0.6, weights: tuple[float, ...] = (0.15, 0.15, 0.4, 0.3), normalise: bool = False):
        self.loda, self.trees = Loda(seed, 10), HalfSpaceTrees(seed + 1, 50, normalise)
        self.history, self.ewma = deque(maxlen=60), Ewma(0.05, 2.0, 3)
        self.weights, self.last = weights, 0.0
        self.threshold = threshold if 0 < threshold < 1 else 0.6

    def step(self, current: float, previous: float, x: np.ndarray) -> tuple[float, float, float, float, float, bool]:
        if self.last < self.threshold:
            value = previous if previous > 0 else current
            self.history.append(value)
            self.ewma.step(value)
        self.loda.update(x)
        self.trees.update(x)
        z = 0.0
        if len(self.history) >= 5:
            mean, sd = np.mean(self.history), np.std(self.history)
            z = (previous - mean) / sd if sd > 0 else 5.0 * (previous > mean)
        base = self.ewma.baseline
        residual = (previous - base) / base if base > 0 else 0.0
        parts = [sigmoid(self.loda.score(x), 1.5, 0.8), sigmoid(self.trees.score(x), 15, 5), sigmoid(z, 3, 1), sigmoid(residual, 2, 1)]
        used = np.array(self.weights) * [self.loda.trained, self.trees.trained, True, True]
        self.last = float(used @ parts / used.sum()) if used.sum() > 0 else 0.0
        return (*parts, self.last, self.last > self.threshold)


def fnv1a(texts: list[str], row: int = 0) -> np.ndarray:
    """32-bit FNV-1a of the row number (two bytes, low first) and each text, for all texts at once."""
    raw = [row.to_bytes(2, "little") + t.encode() for t in texts]
    size = np.array([len(r) for r in raw])
    flat = np.zeros((len(raw), int(size.max(initial=0))), np.uint64)
    for i, r in enumerate(raw):
        flat[i, : len(r)] = np.frombuffer(r, np.uint8)
    h = np.full(len(raw), 2166136261, np.uint64)  # Fixed values: FNV's offset and prime.
    for c in range(flat.shape[1]):
        h = np.where(c < size, ((h ^ flat[:, c]) * np.uint64(16777619)) & np.uint64(0xFFFFFFFF), h)
    return h


class RateLimit:
    """A token bucket (twice the rate at most), then a Count-Min count for each source, halved every `decay` seconds of event time."""

    def __init__(self, rate: float = 1000.0, per_source: int = 50, decay: float = 5.0):
        self.rate = rate if rate > 0 else 1000.0
        self.limit, self.decay = (per_source if per_source > 0 else 50), decay
        self.tokens, self.at, self.decayed, self.dropped = self.rate, None, None, 0
        self.counts = np.zeros((CMS_ROWS, CMS_COLS), np.int64)

    def reset(self, ts: float) -> None:
        """Empties the counts and fills the bucket; what was dropped stays counted."""
        self.counts[:] = 0
        self.tokens, self.at = 2 * self.rate, ts

    def step(self, ts: float, columns: np.ndarray) -> tuple[bool, int]:
        """(allowed, the source's count; 0 where the bucket was empty)."""
        if self.at is None:
            self.at = ts
        if self.decayed is None:
            self.decayed = ts
        self.tokens, self.at = min(2 * self.rate, self.tokens + self.rate * max(0.0, ts - self.at)), max(ts, self.at)
        times = int((ts - self.decayed) // self.decay)
        if times > 0:
            self.counts >>= min(times, 16)
            self.decayed += times * self.decay
        if self.tokens < 1:
            self.dropped += 1
            return False, 0
        cells = np.arange(CMS_ROWS), columns
        self.counts[cells] = np.minimum(self.counts[cells] + 1, SATURATED)
        count = int(self.counts[cells].min())
        if count > self.limit:
            self.dropped += 1
            return False, count
        self.tokens -= 1
        return True, count


class Gate:
    """Mitigation: passes all while a node's state is normal, limits it under attack and in recovery, and starts afresh after."""

    def __init__(self, rate: float = 1000.0, per_source: int = 50, decay: float = 5.0):
        self.limit, self.active = RateLimit(rate, per_source, decay), False

    def step(self, ts: float, state: int, columns: np.ndarray) -> tuple[bool, bool, int]:
        """(allowed, active, dropped so far)."""
        if state == NORMAL and self.active:
            self.limit.reset(ts)
        self.active = state in (UNDER_ATTACK, RECOVERY)
        allowed = self.limit.step(ts, columns)[0] if self.active else True
        return allowed, self.active, self.limit.dropped


class StateMachine:
    """Hysteresis over scores: `confirm` high ones in a row raise the state, `recover` low ones in a row clear it, a high
    one in recovery raises it again.  A state may be forced before a score is seen."""

    def __init__(self, threshold: float = 0.6, confirm: int = 3, recover: int = 5):
        self.threshold = threshold if threshold > 0 else 0.6
        self.confirm, self.recover = (confirm if confirm >= 1 else 3), (recover if recover >= 1 else 5)
        self.state, self.run = NORMAL, 0

    def force(self, state: int) -> None:
        self.state, self.run = state, 0

    def step(self, score: float) -> int:
        high, now = score > self.threshold, self.state
        if now == NORMAL:
            self.run = self.run + 1 if high else 0
            if self.run >= self.confirm:
                self.force(UNDER_ATTACK)
        elif high:
            self.force(UNDER_ATTACK)
        else:
            self.run = 1 if now == UNDER_ATTACK else self.run + 1
            self.state = RECOVERY
            if now == RECOVERY and self.run >= self.recover:
                self.force(NORMAL)
        return self.state


class DeviceDetector:
    """A small device's detector in single precision: half an EWMA's excess, half a z-score over the last ten counts."""

    def __init__(self, alpha: float = 0.2, deviation: float = 2.0, warmup: int = 5, sensitivity: float = 3.0, history: int = 10):
        self.alpha, self.deviation, self.sensitivity = np.float32(alpha), np.float32(deviation), np.float32(sensitivity)
        self.warmup, self.seen, self.base, self.history = warmup, 0, np.float32(0), deque(maxlen=history)

    def step(self, count: float) -> float:
        x, one, before = np.float32(count), np.float32(1), self.base
        self.base = x if not self.seen else self.alpha * x + (one - self.alpha) * before
        self.seen += 1
        excess = z_part = np.float32(0)
        if self.seen > self.warmup and before > 0 and x > before * (one + self.deviation):
            excess = min(one, (x - before) / (before * self.deviation))
        if len(self.history) >= 5:
            past = np.array(self.history, np.float32)
            mean = past.sum(dtype=np.float32) / np.float32(len(past))
            sd = np.sqrt(max(np.float32(0), (past * past).sum(dtype=np.float32) / np.float32(len(past)) - mean * mean))
            z = (x - mean) / sd if sd > 0 else (self.sensitivity + one if x > mean else np.float32(0))
            if z > self.sensitivity:
                z_part = min(one, z / (self.sensitivity * np.float32(2)))
        self.history.append(x)
        return float(np.float32(0.5) * excess + np.float32(0.5) * z_part)


class Baseline:
    """Running means of packets and of bytes a packet over the first `most` normal windows."""

    def __init__(self, most: int = 50):
        self.most, self.n, self.packets, self.bpp = most, 0, 0.0, 0.0

    def step(self, packets: float, size: float, state: int) -> tuple[float, float]:
        if state == NORMAL and self.n < self.most:
            self.packets = (self.packets * self.n + packets) / (self.n + 1)
            if packets > 0:
                self.bpp = (self.bpp * self.n + size / packets) / (self.n + 1)
            self.n += 1
        return self.packets, self.bpp


def _ewma(state: Ewma, c: dict) -> dict:
    before, now, alert = zip(*(state.step(float(x)) for x in c["sources"]))
    return {"baseline": before, "ewma": now, "alert": alert}


def _ensemble(state: Ensemble, c: dict) -> dict:
    rows = zip(*(np.array(c[k], float) for k in ("sources", "previous", "ratio", "packets", "bytes", "bytes_per_packet")))
    # The last two dimensions, residual and z-score, are zero when a window is scored.
    made = [state.step(s, p, np.array([s, p, r, n, b, bpp, 0.0, 0.0])) for s, p, r, n, b, bpp in rows]
    return dict(zip(("loda", "hst", "z", "residual", "score", "alert"), zip(*made)))


def _columns(sources: list[str]) -> np.ndarray:
    """Each source's Count-Min column in each row; a batch's sources are hashed once."""
    found, at = np.unique(np.array(sources, object), return_inverse=True)
    return np.stack([fnv1a(found.tolist(), r) % CMS_COLS for r in range(CMS_ROWS)], 1).astype(np.int64)[at]


def _limited(state: RateLimit, c: dict) -> dict:
    allowed, count = zip(*(state.step(t, k) for t, k in zip(c["seconds"], _columns(c["src_ip"]))))
    return {"allowed": allowed, "count": count}


def _gated(state: Gate, c: dict) -> dict:
    made = (state.step(t, s, k) for t, s, k in zip(c["seconds"], c["state"], _columns(c["src_ip"])))
    return dict(zip(("allowed", "active", "dropped"), zip(*made)))


def _machine(state: StateMachine, c: dict) -> dict:
    out = []
    for score, forced in zip(c["score"], c.get("forced", [None] * len(c["score"]))):
        if forced is not None:
            state.force(forced)
            out.append(forced)
        else:
            out.append(state.step(score))
    return {"state": out}


def _device(state: DeviceDetector, c: dict) -> dict:
    return {"device_score": [state.step(float(x)) for x in c["sources"]]}


def _baseline(state: Baseline, c: dict) -> dict:
    made = [state.step(float(p), float(b), s) for p, b, s in zip(c["packets"], c["bytes"], c["state"])]
    return dict(zip(("baseline_packets", "baseline_bpp"), zip(*made)))


def _loda(state: Loda, c: dict) -> dict:
    out, trained = [], []
    for x in c["vector"]:
        x = np.array(x, float)
        state.update(x)
        out.append(state.score(x))
        trained.append(state.trained)
    return {"score": out, "trained": trained}


def fold(rows: DataFrame, key: str, order: list[str], start: Callable, step: Callable, made: str) -> DataFrame:
    """rows with the columns `made` that step(state, columns of a run of rows) gives; every key starts anew.

    Null keys are a key of their own; rows must not have nulls in the columns that step reads.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = StructType(rows.schema.fields + _parse_datatype_string(made).fields)
    new = to_arrow_schema(_parse_datatype_string(made))

    def run(batches):
        state, last = None, object()
        for b in batches:
            if not b.num_rows:
                continue
            ids = b[key].to_pylist()
            edges = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            for lo, hi in zip(edges, edges[1:]):
                if ids[lo] != last:
                    state, last = start(), ids[lo]
                part = b.slice(lo, hi - lo)
                out = step(state, part.to_pydict())
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(list(out[f.name]), f.type) for f in new)], [*part.schema.names, *new.names])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def ewma_alerts(windows: DataFrame, alpha: float = 0.2, deviation: float = 2.0, warmup: int = 5) -> DataFrame:
    """Adds baseline (before the window), ewma and alert to (node_id, window_start, sources)."""
    return fold(windows, "node_id", ["window_start"], lambda: Ewma(alpha, deviation, warmup), _ewma, "baseline double, ewma double, alert boolean")


ENSEMBLE = "loda double, hst double, z double, residual double, score double, alert boolean"


def ensemble_scores(features: DataFrame, seed: int = 42, threshold: float = 0.6, weights: tuple[float, ...] = (0.15, 0.15, 0.4, 0.3), normalise: bool = False) -> DataFrame:
    """Adds the parts' scores, the ensemble's and alert to the windows' features; weights (0.8, 0, ...) make an ablation."""
    return fold(features, "node_id", ["window_start"], lambda: Ensemble(seed, threshold, weights, normalise), _ensemble, ENSEMBLE)


def rate_limited(packets: DataFrame, rate: float = 1000.0, per_source: int = 50, decay: float = 5.0) -> DataFrame:
    """Adds allowed and count to packets (node_id, seconds double, src_ip) in order of time; ties go by source."""
    return fold(packets, "node_id", ["seconds", "src_ip"], lambda: RateLimit(rate, per_source, decay), _limited, "allowed boolean, count long")


def mitigated(packets: DataFrame, rate: float = 1000.0, per_source: int = 50, decay: float = 5.0) -> DataFrame:
    """Adds allowed, active and dropped (so far) to packets (node_id, seconds double, src_ip, state int) in order of time."""
    return fold(packets, "node_id", ["seconds", "src_ip"], lambda: Gate(rate, per_source, decay), _gated, "allowed boolean, active boolean, dropped long")


def states(scored: DataFrame, threshold: float = 0.6, confirm: int = 3, recover: int = 5) -> DataFrame:
    """Adds state to (node_id, window_start, score) and, if given, the column forced (a state that a command sets, or null)."""
    return fold(scored, "node_id", ["window_start"], lambda: StateMachine(threshold, confirm, recover), _machine, "state int")


def device_scores(windows: DataFrame, **options) -> DataFrame:
    """Adds device_score to (node_id, window_start, sources)."""
    return fold(windows, "node_id", ["window_start"], lambda: DeviceDetector(**options), _device, "device_score double")


def baselines(windows: DataFrame, most: int = 50) -> DataFrame:
    """Adds baseline_packets and baseline_bpp to (node_id, window_start, packets, bytes, state): means up to each window."""
    return fold(windows, "node_id", ["window_start"], lambda: Baseline(most), _baseline, "baseline_packets double, baseline_bpp double")


def scored_by(rows: DataFrame, start: Callable) -> DataFrame:
    """Adds score and trained of LODA or of half-space trees to (node_id, window_start, vector array<double>)."""
    return fold(rows, "node_id", ["window_start"], start, _loda, "score double, trained boolean")


def fold_stream(rows: DataFrame, key: str, order: str, start: Callable, step: Callable, made: str) -> DataFrame:
    """fold for a stream: each micro-batch's rows of a key in order, the state kept between batches."""
    from pyspark.sql.streaming.state import GroupStateTimeout
    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = StructType(rows.schema.fields + _parse_datatype_string(made).fields)

    def run(_, frames, group):
        import pandas as pd

        state = pickle.loads(bytes(group.get[0])) if group.exists else start()
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        out = step(state, rows.to_dict("list"))
        group.update((pickle.dumps(state),))
        yield rows.assign(**{k: list(v) for k, v in out.items()})

    return rows.groupBy(key).applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.NoTimeout)


def count_min(packets: DataFrame, keys: list[str], value: str = "src_ip") -> DataFrame:
    """(keys..., value, estimate): the Count-Min estimate of every source's packets without decay, by two aggregations."""
    from pyspark.sql import functions as F

    from brookwatch.functions.hashing import fnv1a_text

    per_source = packets.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    cells = F.array(*[F.struct(F.lit(r).alias("row"), F.pmod(fnv1a_text(F.col(value), r), F.lit(CMS_COLS)).alias("col")) for r in range(CMS_ROWS)])
    placed = per_source.select(*keys, value, "_n", F.explode(cells).alias("c")).select(*keys, value, "_n", "c.row", "c.col")
    counts = placed.groupBy(*keys, "row", "col").agg(F.least(F.sum("_n"), F.lit(SATURATED)).alias("count"))
    return placed.join(counts, [*keys, "row", "col"]).groupBy(*keys, value).agg(F.min("count").alias("estimate"))
