"""Synthetic traffic as relations: every address is a function of its place and a seed, so any part can be made again alone."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brookwatch.functions.hashing import int_to_ip


def random_ip(*keys: Column, seed: int = 42) -> Column:
    """A pseudo-random address of the keys."""
    return int_to_ip(F.xxhash64(F.lit(seed), *keys).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def pool_ip(member: Column, seed: int = 42) -> Column:
    """Address number `member` of a pool in 10/8 whose last octet is 1 to 254."""
    h = F.xxhash64(F.lit(seed), member)
    octet = [F.pmod(F.shiftright(h, s), F.lit(n)) for s, n in ((0, 256), (8, 256), (16, 254))]
    return F.concat_ws(".", F.lit("10"), octet[0].cast("string"), octet[1].cast("string"), (octet[2] + 1).cast("string"))


def numbered_ip(i: Column) -> Column:
    """Address number i in base 255, as the load test numbers them."""
    n = i.cast("long")
    parts = [F.pmod(F.floor(n / d), F.lit(256)) for d in (16581375, 65025, 255)]
    return F.concat_ws(".", *[p.cast("string") for p in parts], F.pmod(n, F.lit(255)).cast("string"))


def _counted(windows: DataFrame, n: Column) -> DataFrame:
    """A row for each i in 0 .. n - 1 of each window."""
    return windows.withColumn("_n", n.cast("long")).filter("_n > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).drop("_n")


def scenario(spark: SparkSession, windows: int = 12, normal: int = 300, attack: int = 15_000, attacks: Iterable[int] = (4, 5, 6, 7), width: float = 2.0, seed: int = 42, nodes: int = 1) -> DataFrame:
    """(node_id, window_id, seconds, src_ip, byte_len, label): every window has normal addresses, attack windows more of them."""
    hit = F.col("window_id").isin(*[int(a) for a in attacks]) if list(attacks) else F.lit(False)
    grid = spark.range(windows * nodes).select(F.floor(F.col("id") / nodes).alias("window_id"), F.concat(F.lit("node-"), (F.col("id") % nodes).cast("string")).alias("node_id"))
    rows = _counted(grid, normal + F.when(hit, attack).otherwise(0))
    label = F.when(F.col("i") < normal, "normal").otherwise("attack")
    total = normal + F.when(hit, attack).otherwise(0)
    return rows.select("node_id", "window_id", ((F.col("window_id") + F.col("i") / total) * width).alias("seconds"), random_ip(F.col("node_id"), F.col("window_id"), F.col("i"), seed=seed).alias("src_ip"), F.lit(64).cast("long").alias("byte_len"), label.alias("label"))


def load_test(spark: SparkSession, phases: Iterable[tuple[str, int, int]] = (("BASELINE", 10, 500), ("SPIKE", 3, 20_000), ("COOLDOWN", 5, 500))) -> DataFrame:
    """(round, phase, src_ip): rounds of numbered addresses, the phases one after the other."""
    plan, at = [], 0
    for name, rounds, ips in phases:
        plan += [(at + r + 1, name, ips) for r in range(rounds)]
        at += rounds
    rows = _counted(spark.createDataFrame(plan, "round int, phase string, ips long"), F.col("ips"))
    return rows.select("round", "phase", numbered_ip(F.col("i")).alias("src_ip"))


def device_traffic(spark: SparkSession, profile: str = "mixed", normal_rate: int = 50, attack_rate: int = 5000, pool: int = 1000, delay: int = 30, duration: int = 60, after: int = 30, seed: int = 42) -> DataFrame:
    """(second, phase, src_ip, byte_len): seconds of pool traffic of 64 bytes, of an attack of 1500 bytes from anywhere, or of
    the three phases normal, attack, recovery."""
    if profile not in ("normal", "attack", "mixed"):
        raise ValueError(f"unknown profile: {profile}")
    spans = {"normal": [("normal", delay)], "attack": [("attack", duration)], "mixed": [("normal", delay), ("attack", duration), ("recovery", after)]}[profile]
    phase, start = F.lit(None).cast("string"), sum(n for _, n in spans)
    total = start
    for name, n in reversed(spans):
        start -= n
        phase = F.when((F.col("second") >= start) & (F.col("second") < start + n), name).otherwise(phase)
    seconds = spark.range(total).select(F.col("id").alias("second")).withColumn("phase", phase)
    hot = F.col("phase") == "attack"
    rows = _counted(seconds, F.when(hot, max(1, attack_rate // 10) * 10).otherwise(normal_rate))
    key = F.pmod(F.xxhash64(F.lit(seed), "second", "i"), F.lit(pool))
    return rows.select("second", "phase", F.when(F.col("phase") == "attack", random_ip(F.col("second"), F.col("i"), seed=seed)).otherwise(pool_ip(key, seed)).alias("src_ip"), F.when(F.col("phase") == "attack", 1500).otherwise(64).cast("long").alias("byte_len"))


def flood(spark: SparkSession, phases: Iterable[tuple[str, int, int]] = (("baseline", 100, 30), ("attack", 5000, 30), ("recovery", 100, 30)), batch: int = 50, seed: int = 42) -> DataFrame:
    """(phase, datagram, value): the datagrams of phases (name, addresses a second, seconds), `batch` addresses a line each.
    A relation only: nothing is sent."""
    plan, at = [], 0
    for name, rate, seconds in phases:
        size = min(batch, rate)
        n = rate * seconds // size
        plan.append((name, at, n, size))
        at += n
    rows = spark.createDataFrame(plan, "phase string, start long, n long, size int")
    rows = _counted(rows, F.col("n")).withColumn("datagram", F.col("start") + F.col("i"))
    lines = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda k: F.concat(random_ip(F.col("datagram"), k, seed=seed), F.lit("\n")))
    return rows.select("phase", "datagram", F.concat_ws("", lines).alias("value"))


def with_attacks(packets: DataFrame, window: str, attacks: Iterable, extra: int, column: str = "src_ip") -> DataFrame:
    """packets (window, src_ip) and, in the attack windows, `extra` numbered addresses more."""
    spark = packets.sparkSession
    more = _counted(spark.createDataFrame([(a,) for a in attacks], packets.select(window).schema), F.lit(extra))
    return packets.select(window, column).unionByName(more.select(window, numbered_ip(F.col("i")).alias(column)))
