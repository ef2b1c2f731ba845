"""Tumbling-window traffic, features, alerts and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brookwatch.sources.packets import is_attack


def traffic(packets: DataFrame, width: str = "1 hour") -> DataFrame:
    """(node_id, window_start, packets, bytes, sources) in event time."""
    rows = packets.withColumn("window_start", F.window("ts", width).start)
    return rows.groupBy("node_id", "window_start").agg(F.count(F.lit(1)).alias("packets"), F.sum("byte_len").alias("bytes"), F.countDistinct("src_ip").alias("sources"))


def features(windows: DataFrame) -> DataFrame:
    """Adds the previous window's sources, the ratio to them (1 after none) and bytes per packet (0 without packets)."""
    before = F.lag("sources", 1, 0).over(Window.partitionBy("node_id").orderBy("window_start"))
    out = windows.withColumn("previous", before)
    ratio = F.when(F.col("previous") == 0, 1.0).otherwise(F.col("sources") / F.col("previous"))
    return out.withColumn("ratio", ratio).withColumn("bytes_per_packet", F.when(F.col("packets") == 0, 0.0).otherwise(F.col("bytes") / F.col("packets")))


def z_scores(windows: DataFrame, history: int = 20, threshold: float = 3.0, least: int = 5) -> DataFrame:
    """(node_id, window_start, sources, n, mean, z, alert) against the history before; without spread, any rise alerts."""
    past = Window.partitionBy("node_id").orderBy("window_start").rowsBetween(-history, -1)
    out = windows.select("node_id", "window_start", "sources", F.count("sources").over(past).alias("n"), F.avg("sources").over(past).alias("mean"), F.stddev_pop("sources").over(past).alias("sd"))
    flat = F.when(F.col("sources") > F.col("mean"), 5.0).otherwise(0.0)
    z = F.when(F.col("n") < least, 0.0).when(F.col("sd") < 1e-9, flat).otherwise((F.col("sources") - F.col("mean")) / F.col("sd"))
    return out.select("node_id", "window_start", "sources", "n", "mean", z.alias("z"), (z > threshold).alias("alert"))


def ground_truth(packets: DataFrame, width: str = "1 hour") -> DataFrame:
    """(window_start, attacks, normals, is_attack): a window is an attack if attacks outnumber half the normal packets."""
    rows = packets.groupBy(F.window("ts", width).start.alias("window_start")).agg(F.count_if(is_attack(F.col("label"))).alias("attacks"), F.count_if(~is_attack(F.col("label"))).alias("normals"))
    return rows.withColumn("is_attack", (F.col("attacks") > F.floor(F.col("normals") / 2)).cast("int"))


def confusion(predictions: DataFrame, truth: str = "truth", predicted: str = "alert") -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, f1 (0 where undefined)."""
    t, p = F.col(truth).cast("boolean"), F.col(predicted).cast("boolean")
    c = predictions.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))

    def share(a: Column, b: Column) -> Column:
        return F.when(b == 0, 0.0).otherwise(a / b)

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("*", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def vector(features: DataFrame, populate: bool = False) -> DataFrame:
    """Adds the detectors' vector of eight: sources, previous, ratio, packets, bytes, bytes per packet, residual, z-score.

    The last two are 0, as they are when a window is scored, unless `populate` takes them from columns of these names.
    """
    last = [F.col("residual"), F.col("z")] if populate else [F.lit(0.0), F.lit(0.0)]
    columns = [F.col(c) for c in ("sources", "previous", "ratio", "packets", "bytes", "bytes_per_packet")] + last
    return features.withColumn("vector", F.array(*[c.cast("double") for c in columns]))


def attack_features(rows: DataFrame) -> DataFrame:
    """Adds card_spike, rate_spike and bytes_per_packet to (sources, previous, packets, bytes, baseline_packets): 1 where
    there is nothing to compare with, 0 bytes without packets."""

    def share(a: str, b: str, none: float) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.nullif(b, F.lit(0))).otherwise(F.lit(none))

    return rows.withColumn("card_spike", share("sources", "previous", 1.0)).withColumn("rate_spike", share("packets", "baseline_packets", 1.0)).withColumn("bytes_per_packet", share("bytes", "packets", 0.0))


def classify(rows: DataFrame) -> DataFrame:
    """attack_type and confidence from card_spike, rate_spike and bytes_per_packet: the share of three rules met, the first of equals."""
    card, rate, bpp = F.col("card_spike"), F.col("rate_spike"), F.col("bytes_per_packet")
    # The limits of the rules.
    rules = {
        "SYN_FLOOD": [card > 5, rate > 5, (bpp > 0) & (bpp < 100)],
        "UDP_FLOOD": [card > 5, rate > 5, (bpp >= 100) & (bpp <= 500)],
        "HTTP_FLOOD": [(card > 2) & (card <= 10), rate > 3, bpp > 500],
        "PORT_SCAN": [(card > 2) & (card <= 10), (rate > 0.5) & (rate <= 3), (bpp > 0) & (bpp < 80)],
    }
    points = {k: sum((r.cast("int") for r in v[1:]), v[0].cast("int")) for k, v in rules.items()}
    best = F.greatest(*points.values())
    name = F.lit("UNKNOWN")
    for k, v in reversed(points.items()):
        name = F.when((v == best) & (best >= 1), k).otherwise(name)
    calm = (card < 2) & (rate < 2)
    return rows.withColumn("attack_type", F.when(calm, "NONE").otherwise(name)).withColumn("confidence", F.when(calm, 0.0).otherwise(best / 3.0))


def transitions(states: DataFrame) -> DataFrame:
    """(node_id, window_start, was, state) where a node's state differs from the one before; every node starts at 0."""
    was = F.lag("state", 1, 0).over(Window.partitionBy("node_id").orderBy("window_start"))
    return states.select("node_id", "window_start", was.alias("was"), "state").filter("was <> state")


def latest(rows: DataFrame, n: int = 10, key: str = "node_id", order: str = "window_start") -> DataFrame:
    """The last n rows of each key, with their place from the end as `back`."""
    return rows.withColumn("back", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).filter(F.col("back") <= n)


def state_name(state: Column) -> Column:
    """A state's name; UNKNOWN for numbers that are none."""
    return F.coalesce(F.when(state == 0, "NORMAL").when(state == 1, "UNDER_ATTACK").when(state == 2, "RECOVERY"), F.lit("UNKNOWN"))


def relative_windows(packets: DataFrame, seconds: int = 3600) -> DataFrame:
    """Adds window_id, counted from the first packet of all in widths of so many seconds; the first time is one row."""
    start = packets.agg(F.min("ts").alias("_start"))
    elapsed = (F.unix_micros("ts") - F.unix_micros("_start")) / (seconds * 1_000_000)
    return packets.join(F.broadcast(start)).withColumn("window_id", F.floor(elapsed)).drop("_start")


def ticks(packets: DataFrame, width: str = "1 hour", tick: int = 600) -> DataFrame:
    """(node_id, window_start, tick, packets, bytes, sources) of the partial windows as they grow: what a node sees at the
    end of each tick, of so many seconds, of a window in which it has packets.  A source counts from the tick that it is first seen in."""
    rows = packets.select("node_id", F.window("ts", width).start.alias("window_start"), F.timestamp_seconds(F.floor(F.unix_seconds("ts") / tick) * tick).alias("tick"), "src_ip", "byte_len")
    sums = rows.groupBy("node_id", "window_start", "tick").agg(F.count(F.lit(1)).alias("packets"), F.sum("byte_len").alias("bytes"))
    first = rows.groupBy("node_id", "window_start", "src_ip").agg(F.min("tick").alias("tick"))
    new = first.groupBy("node_id", "window_start", "tick").agg(F.count(F.lit(1)).alias("new"))
    upto = Window.partitionBy("node_id", "window_start").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    both = sums.join(new, ["node_id", "window_start", "tick"], "left").na.fill(0, ["new"])
    return both.select("node_id", "window_start", "tick", *[F.sum(c).over(upto).alias(n) for c, n in (("packets", "packets"), ("bytes", "bytes"), ("new", "sources"))])
