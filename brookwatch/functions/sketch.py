"""HyperLogLog sketches as relations (keys..., idx, rho), merged by max.

The finest form is the sparse relation (keys..., slot, rank): 2^25 slots, from which the dense registers follow; a dense
relation comes from it or from the wire.  Union of either is one aggregation, partial on the map side.  Estimates are
functions of a relation's content alone: below the sparse limit linear counting over the slots, beyond it the
bias-corrected estimate over the registers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from brookwatch.functions import hashing as H

#: Linear-counting thresholds for p = 4 to 18.
LC_THRESHOLD = dict(zip(range(4, 19), (10, 20, 40, 80, 220, 400, 900, 1800, 3100, 6500, 11500, 20000, 50000, 120000, 350000)))
#: The cardinalities at which p = 14's bias was sampled beside the regular steps of bias_points().
_EXTRA = (
    12, 32, 82, 92, 132, 142, 222, 913, 1207, 1305, 1403, 1501, 2677, 3069, 3265, 3461, 3559, 3657, 4245, 4735, 5127, 5617, 5813, 5911,
    6303, 6891, 7283, 7675, 8263, 8557, 8753, 8949, 9635, 9929, 23672, 29668, 53652, 62646, 74638, 80634,
)


@dataclass(frozen=True)
class SketchConfig:
    """Precision, sparse precision and hash of a sketch; checked once, when it is made."""

    p: int = 14
    p_prime: int = H.P_PRIME
    hash: str = "sha256"

    def __post_init__(self):
        if self.p not in LC_THRESHOLD:
            raise ValueError(f"p must be 4 to 18, not {self.p}")
        if not self.p < self.p_prime <= 32:
            raise ValueError("p' must be above p and at most 32")
        if self.hash not in H.HASHES:
            raise ValueError(f"the hash is one of {sorted(H.HASHES)}, not {self.hash!r}")

    @property
    def m(self) -> int:
        return 1 << self.p

    @property
    def wire_bytes(self) -> int:
        return (6 * self.m + 7) // 8

    @property
    def alpha(self) -> float:
        return {4: 0.673, 5: 0.697, 6: 0.709}.get(self.p, 0.7213 / (1 + 1.079 / self.m))

    @property
    def std_error_pct(self) -> float:
        return 104.0 / math.sqrt(self.m)


DEFAULT = SketchConfig()


def hashed(rows: DataFrame, keys: list[str], value: str, config: SketchConfig = DEFAULT, address: bool = True) -> DataFrame:
    """(keys..., h): the value's hash, of its 16-byte form for addresses and of its text's bytes else; what has none is left out."""
    raw = H.ip_bytes(F.col(value)) if address else F.col(value).cast("string").cast("binary")
    return rows.select(*keys, H.HASHES[config.hash](raw).alias("h")).filter("h IS NOT NULL")


def sparse(rows: DataFrame, keys: list[str], value: str, config: SketchConfig = DEFAULT, address: bool = True) -> DataFrame:
    """(keys..., slot, rank): a sketch's finest form."""
    slot, rank = H.sparse_slot(F.col("h"), config.p, config.p_prime)
    return merge(hashed(rows, keys, value, config, address).select(*keys, slot.alias("slot"), rank.alias("rank")), keys)


def registers(rows: DataFrame, keys: list[str], value: str, config: SketchConfig = DEFAULT, address: bool = True) -> DataFrame:
    """(keys..., idx, rho): the top p bits of the hash choose a register, the leading zeros of the rest fill it."""
    idx, rank = H.register(F.col("h"), config.p)
    return merge(hashed(rows, keys, value, config, address).select(*keys, idx.alias("idx"), rank.alias("rho")), keys)


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The union of sketches, sparse or dense, that agree on keys."""
    place, rank = ("slot", "rank") if "slot" in sketches.columns else ("idx", "rho")
    return sketches.groupBy(*keys, place).agg(F.max(rank).alias(rank))


def union(keys: list[str], *sketches: DataFrame, config: SketchConfig = DEFAULT) -> DataFrame:
    """The union of sparse and dense relations: sparse if all are, else dense.  A sketch united with itself is itself."""
    if not sketches:
        raise ValueError("nothing to unite")
    if not all("slot" in s.columns for s in sketches):
        sketches = tuple(to_dense(s, keys, config) if "slot" in s.columns else s for s in sketches)
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return merge(out, keys)


def to_dense(slots: DataFrame, keys: list[str], config: SketchConfig = DEFAULT) -> DataFrame:
    """(keys..., idx, rho, slots): the registers of sparse relations, and how many slots each stands for."""
    idx, rank = H.dense_of(F.col("slot"), F.col("rank"), config.p, config.p_prime)
    return slots.select(*keys, idx.alias("idx"), rank.alias("rho")).groupBy(*keys, "idx").agg(F.max("rho").alias("rho")).select(*keys, "idx", "rho")


def bias_points(p: int = 14) -> list[int]:
    """Cardinalities at which the bias is sampled, ascending."""
    if p != 14:
        return []
    top = 5 << p
    return sorted({*range(1, 501, 10), *range(500, 10001, 98), *range(10000, top + 1, 1499), top, *_EXTRA})


def raw_estimates(ranks: np.ndarray, indexes: np.ndarray, at: list[int], config: SketchConfig = DEFAULT) -> list[float]:
    """Raw estimates after the first n of a series of (index, rank), for each n of `at`, ascending."""
    held, out, before = np.zeros(config.m, np.int64), [], 0
    for n in at:
        np.maximum.at(held, indexes[before:n], ranks[before:n])
        out.append(config.alpha * config.m**2 / float(np.exp2(-held.astype(float)).sum()))
        before = n
    return out


@lru_cache(maxsize=2)
def bias_table(p: int = 14) -> tuple[tuple[float, float], ...]:
    """(raw estimate, bias) in order of the estimate, rebuilt from the addresses numbered 1 to n and XXH64."""
    import xxhash

    at = bias_points(p)
    if not at:
        return ()
    config = SketchConfig(p, hash="xxhash")
    prefix = bytes(10) + b"\xff\xff"
    h = [xxhash.xxh64_intdigest(prefix + i.to_bytes(4, "big")) for i in range(1, at[-1] + 1)]
    rest = [x & ((1 << (64 - p)) - 1) for x in h]
    ranks = np.array([64 - p + 1 - r.bit_length() for r in rest])
    raw = raw_estimates(ranks, np.array([x >> (64 - p) for x in h]), at, config)
    return tuple(sorted((e, e - n) for e, n in zip(raw, at)))


@lru_cache(maxsize=2)
def bias_by_position(p: int = 14, neighbours: int = 6) -> tuple[float, ...]:
    """The mean bias of the neighbours around each place among the table's estimates, the window kept within the table."""
    bias = [b for _, b in bias_table(p)]
    starts = [min(max(0, i - neighbours // 2), max(0, len(bias) - neighbours)) for i in range(len(bias) + 1)] if bias else []
    return tuple(float(np.mean(bias[s : s + neighbours])) for s in starts)


def bias_of(raw: Column, config: SketchConfig = DEFAULT) -> Column:
    """The bias of a raw estimate: 0 beyond 5 m and where there is no table."""
    table = bias_table(config.p)
    if not table:
        return F.lit(0.0)
    place = F.size(F.filter(F.array(*[F.lit(e) for e, _ in table]), lambda x: x < raw))
    return F.when(raw <= 5.0 * config.m, F.element_at(F.array(*[F.lit(b) for b in bias_by_position(config.p)]), place + 1)).otherwise(0.0)


def _sums(dense: DataFrame, keys: list[str], config: SketchConfig, *more: Column) -> DataFrame:
    """(keys..., n_registers, zeros, raw, linear) and more aggregates; linear is null without empty registers."""
    m = float(config.m)
    sums = dense.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_registers"), F.sum(F.pow(F.lit(2.0), -F.col("rho"))).alias("_s"), *more)
    sums = sums.withColumn("zeros", config.m - F.col("n_registers"))
    raw = F.lit(config.alpha * m * m) / (F.col("_s") + F.col("zeros"))
    return sums.withColumn("raw", raw).withColumn("linear", F.when(F.col("zeros") > 0, F.lit(m) * F.log(F.lit(m) / F.nullif("zeros", F.lit(0))))).drop("_s")


def _corrected(config: SketchConfig) -> Column:
    better = F.col("raw") - bias_of(F.col("raw"), config)
    h = F.coalesce("linear", better)
    return F.greatest(F.lit(0), F.round(F.when(h <= LC_THRESHOLD[config.p], h).otherwise(better))).cast("long")


def dense_estimates(dense: DataFrame, keys: list[str], config: SketchConfig = DEFAULT) -> DataFrame:
    """(keys..., n_registers, raw, estimate): linear counting up to p's threshold, the bias-corrected estimate beyond."""
    return _sums(dense, keys, config).select(*keys, "n_registers", "raw", _corrected(config).alias("estimate"))


def classic_estimates(dense: DataFrame, keys: list[str], config: SketchConfig = DEFAULT, large_range: bool = False) -> DataFrame:
    """(keys..., raw, estimate) of the first HyperLogLog: linear counting, rounded down, while the raw estimate is at
    most 2.5 m and registers are empty; optionally corrected for collisions of 32-bit hashes."""
    raw, two32 = F.col("raw"), float(1 << 32)
    far = F.lit(large_range) & (raw > two32 / 30)
    wide = F.when(far, F.round(-two32 * F.log(F.greatest(F.lit(1e-300), 1 - raw / two32)))).otherwise(F.round(raw))
    out = F.when((raw <= 2.5 * config.m) & F.col("linear").isNotNull(), F.floor("linear")).otherwise(wide)
    return _sums(dense, keys, config).select(*keys, "raw", out.cast("long").alias("estimate"))


def device_estimates(dense: DataFrame, keys: list[str], config: SketchConfig = DEFAULT, linear_limit: float = 72000.0) -> DataFrame:
    """(keys..., estimate) as a small device shows it: linear counting up to its own limit, then the raw estimate."""
    h = F.coalesce("linear", F.lit(math.inf))
    return _sums(dense, keys, config).select(*keys, F.floor(F.when(h <= linear_limit, h).otherwise(F.col("raw")) + 0.5).cast("long").alias("estimate"))


def micro_registers(rows: DataFrame, keys: list[str], value: str, p: int = 4) -> DataFrame:
    """(keys..., idx, rho) of the smallest devices: FNV-1a of 32 bits over an IPv4 address's bytes."""
    h = rows.select(*keys, H.fnv1a_ipv4(F.col(value)).alias("h")).filter("h IS NOT NULL")
    return merge(h.select(*keys, F.shiftright("h", 32 - p).cast("int").alias("idx"), H.rho(H.low_bits(F.col("h"), 32 - p), 32 - p).cast("int").alias("rho")), keys)


def micro_estimates(dense: DataFrame, keys: list[str], p: int = 4) -> DataFrame:
    """(keys..., estimate): linear counting while the raw estimate is at most 2.5 m, half up."""
    config = SketchConfig(p)
    out = F.when((F.col("raw") <= 2.5 * config.m) & F.col("linear").isNotNull(), F.col("linear")).otherwise(F.col("raw"))
    return _sums(dense, keys, config).select(*keys, F.floor(out + 0.5).cast("long").alias("estimate"))


def sparse_estimates(slots: DataFrame, keys: list[str], config: SketchConfig = DEFAULT) -> DataFrame:
    """(keys..., n_slots, estimate): linear counting over the sparse slots, rounded down."""
    n = slots.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_slots"))
    return n.select(*keys, "n_slots", linear_slots(F.col("n_slots"), config).alias("estimate"))


def linear_slots(n: Column, config: SketchConfig = DEFAULT) -> Column:
    m = float(1 << config.p_prime)
    return F.floor(F.lit(m) * F.log(F.lit(m) / (F.lit(m) - n))).cast("long")


def is_sparse(n_slots: Column, config: SketchConfig = DEFAULT) -> Column:
    """Whether so many slots take less room than the registers."""
    return n_slots * (config.p + 11) < 6 * config.m


def estimates(slots: DataFrame, keys: list[str], config: SketchConfig = DEFAULT) -> DataFrame:
    """(keys..., n_slots, form, estimate) of sparse relations, by the form that their content asks for."""
    idx, rank = H.dense_of(F.col("slot"), F.col("rank"), config.p, config.p_prime)
    dense = slots.select(*keys, idx.alias("idx"), rank.alias("rho")).groupBy(*keys, "idx").agg(F.max("rho").alias("rho"), F.count(F.lit(1)).alias("slots"))
    sums = _sums(dense, keys, config, F.sum("slots").alias("n_slots"))
    small = is_sparse(F.col("n_slots"), config)
    return sums.select(*keys, "n_slots", F.when(small, "sparse").otherwise("dense").alias("form"), F.when(small, linear_slots(F.col("n_slots"), config)).otherwise(_corrected(config)).alias("estimate"))


def native_estimates(rows: DataFrame, keys: list[str], value: str, lg_k: int = 14) -> DataFrame:
    """(keys..., estimate) by Spark's own mergeable sketch: the fast path, whose numbers are its own."""
    return rows.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_sketch_agg(value, lg_k)).alias("estimate"))


def pack_registers(rho: list[int] | np.ndarray) -> bytes:
    """Registers of six bits, low bits first, one after the other: the dense wire form."""
    rho = np.asarray(rho, np.uint8)
    if (rho > 63).any():
        raise ValueError("a register holds at most 63")
    bits = np.unpackbits(rho[:, None], axis=1, bitorder="little")[:, :6]
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack_registers(data: bytes, p: int = 14) -> np.ndarray:
    m = 1 << p
    if len(data) != (6 * m + 7) // 8:
        raise ValueError(f"a dense sketch of p={p} has {(6 * m + 7) // 8} bytes, not {len(data)}")
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: 6 * m].reshape(m, 6)
    return bits @ (1 << np.arange(6))


def export_sparse(slots: DataFrame, keys: list[str], config: SketchConfig = DEFAULT) -> DataFrame:
    """(keys..., p, p_prime, sparse): the ascending codes of each sketch, whose count its precision bounds."""
    code = H.encode_slot(F.col("slot"), F.col("rank"), config.p, config.p_prime)
    return slots.groupBy(*keys).agg(F.sort_array(F.collect_set(code)).alias("sparse")).select(*keys, F.lit(config.p).alias("p"), F.lit(config.p_prime).alias("p_prime"), "sparse")


def export_dense(dense: DataFrame, keys: list[str], config: SketchConfig = DEFAULT) -> DataFrame:
    """(keys..., p, p_prime, dense): the packed registers of each sketch."""
    held = dense.groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("idx", "rho"))).alias("r"))

    @F.pandas_udf(BinaryType())
    def packed(maps):
        import pandas as pd

        def one(pairs):
            rho = np.zeros(config.m, np.uint8)
            for i, v in dict(pairs).items():
                rho[i] = v
            return pack_registers(rho)

        return pd.Series([one(x) for x in maps])

    return held.select(*keys, F.lit(config.p).alias("p"), F.lit(config.p_prime).alias("p_prime"), packed("r").alias("dense"))


def import_sparse(wire: DataFrame, keys: list[str], config: SketchConfig = DEFAULT) -> DataFrame:
    """(keys..., slot, rank) of rows (keys..., p, p_prime, sparse); other precisions and null lists raise."""
    wrong = (F.col("p") != config.p) | (F.col("p_prime") != config.p_prime) | F.col("sparse").isNull()
    checked = F.when(F.coalesce(wrong, F.lit(True)), F.raise_error(F.lit("a sparse sketch of another precision, or none")).cast("array<bigint>")).otherwise(F.col("sparse"))
    slot, rank = H.decode_slot(F.col("code"))
    return merge(wire.select(*keys, F.explode(checked).alias("code")).select(*keys, slot.alias("slot"), rank.alias("rank")), keys)


def import_dense(wire: DataFrame, keys: list[str], config: SketchConfig = DEFAULT) -> DataFrame:
    """(keys..., idx, rho) of rows (keys..., p, dense); other precisions, null or wrongly sized data raise."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = wire.select(*keys, "p", "dense")
    schema = f"{', '.join(f'`{k}` {dict(wire.dtypes)[k]}' for k in keys)}{', ' if keys else ''}idx int, rho int"
    names = [f.name for f in to_arrow_schema(rows.schema)][: len(keys)]

    def run(batches):
        for b in batches:
            for i, (p, data) in enumerate(zip(b["p"].to_pylist(), b["dense"].to_pylist())):
                if p != config.p or data is None:
                    raise ValueError(f"a dense sketch of p={p}, not {config.p}, or none")
                rho = unpack_registers(data, config.p)
                at = np.flatnonzero(rho)
                part = [b[k].slice(i, 1).take(pa.array(np.zeros(len(at), np.int64))) for k in names]
                yield pa.RecordBatch.from_arrays([*part, pa.array(at.astype(np.int32)), pa.array(rho[at].astype(np.int32))], [*names, "idx", "rho"])

    return merge(rows.mapInArrow(run, schema), keys)


def merge_request(sketches: DataFrame) -> DataFrame:
    """(node_id, body): JSON requests of rows (node_id, p, dense, anomaly_state, attack_type, attack_confidence)."""
    fields = ["node_id", "p", F.base64("dense").alias("registers"), "anomaly_state", "attack_type", "attack_confidence"]
    return sketches.select("node_id", F.to_json(F.struct(*fields)).alias("body"))


#: The schema of a JSON merge request, and the size of a body that is read.
REQUEST = "node_id string, p int, registers string, anomaly_state int, attack_type string, attack_confidence double, free_heap long, ship_latency_ms double, loop_time_us long"
MAX_BODY = 1 << 18


def merge_requests(bodies: DataFrame, config: SketchConfig = DEFAULT) -> DataFrame:
    """Adds error to the fields of JSON bodies (column body), and dense: null where the request is refused."""
    r = F.from_json(F.substring("body", 1, MAX_BODY), REQUEST, {"mode": "PERMISSIVE"})
    data = F.try_to_binary(F.col("r.registers"), F.lit("base64"))
    out = bodies.withColumn("r", r).select("r.*", data.alias("dense"))
    error = (
        F.when(F.col("p").isNull() & F.col("registers").isNull(), "bad JSON")
        .when(F.col("dense").isNull(), "bad base64")
        .when((F.col("p") != config.p) | (F.length("dense") != config.wire_bytes), "decode sketch")
    )
    out = out.withColumn("error", error)
    return out.withColumn("dense", F.when(F.col("error").isNull(), F.col("dense"))).drop("registers")
