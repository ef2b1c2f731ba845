"""Sinks: experiments, ground truth, evaluation and benchmark results as files; sketches and alerts of streams, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from brookwatch.functions import sketch


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, header=True)


def write_ground_truth(truth: DataFrame, path: str) -> None:
    write_csv(truth.select("window_id", "is_attack", "attack_count", "normal_count", "primary_attack_type", "window_duration_s"), path)


def write_experiment(folder: str, config: DataFrame, timeline: DataFrame, resources: DataFrame, summary: DataFrame) -> None:
    """Four tables of an experiment: config and summary as JSON, timeline and metrics as CSV with rounded numbers."""
    config.write.json(f"{folder}/config.json")
    write_csv(timeline.withColumn("score", F.format_string("%.4f", "score")).withColumn("latency_ms", F.format_string("%.2f", "latency_ms")), f"{folder}/timeline.csv")
    write_csv(resources.withColumn("cpu_percent", F.format_string("%.2f", "cpu_percent")), f"{folder}/metrics.csv")
    summary.write.json(f"{folder}/summary.json")


def append_timeline(entries: DataFrame, path: str) -> None:
    write_csv(entries, path, "append")


def write_evaluation(folder: str, confusion: DataFrame, detect_ns: DataFrame, events: DataFrame) -> None:
    """The metrics of one row as (metric, value), and the events, as two tables."""
    one = confusion.join(F.broadcast(detect_ns))
    names = {"recall": F.format_string("%.4f", "recall"), "false_positives": F.col("fp").cast("string"), "false_negatives": F.col("fn").cast("string"), "true_positives": F.col("tp").cast("string"), "time_to_detect_ns": F.col("time_to_detect_ns").cast("string")}
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("metric"), v.alias("value")) for i, (n, v) in enumerate(names.items())])
    write_csv(one.select(F.explode(pairs).alias("p")).orderBy("p.i").select("p.metric", "p.value"), f"{folder}/metrics")
    write_csv(events.select("window_id", "at", "count", "reason"), f"{folder}/events")


def observed(df: DataFrame, name: str = "traffic") -> tuple[DataFrame, Observation]:
    """df with gauges that are known after an action on it: rows, packets, bytes and alerts of what it has of these."""
    gauges = {"rows": F.count(F.lit(1))}
    gauges |= {c: F.sum(c) for c in ("packets", "bytes") if c in df.columns}
    gauges |= {"alerts": F.count_if("alert")} if "alert" in df.columns else {}
    seen = Observation(name)
    return df.observe(seen, *[v.alias(k) for k, v in gauges.items()]), seen


def ship_sketches(path: str, keys: list[str], value: str = "src_ip", config: sketch.SketchConfig = sketch.DEFAULT) -> Callable:
    """For foreachBatch: appends a batch's partial sketches (keys..., slot, rank, batch); their union is a sketch of all.

    A batch that is tried again writes over its own folder, so no sketch is counted apart; union is idempotent in any case.
    """

    def ship(batch: DataFrame, number: int) -> None:
        sketch.sparse(batch, keys, value, config).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return ship


def replay_batches(path: str, size: int = 100) -> Callable:
    """For foreachBatch: writes a batch's addresses as JSON injection requests of `size` at most, in its rows' order by time."""

    def replay(batch: DataFrame, number: int) -> None:
        place = batch.select("node_id", "src_ip", F.floor(F.unix_micros("ts")).alias("at"), F.monotonically_increasing_id().alias("id"))
        groups = place.withColumn("request", F.floor(F.col("id") / size)).groupBy("node_id", "request")
        ips = F.transform(F.array_sort(F.collect_list(F.struct("at", "id", "src_ip"))), lambda x: x["src_ip"])
        groups.agg(ips.alias("ips")).select(F.to_json(F.struct("node_id", "ips")).alias("value")).write.mode("overwrite").text(f"{path}/batch={number}")

    return replay


def firewall_actions(edges: DataFrame) -> DataFrame:
    """(tick, action) rows for whoever holds a firewall; nothing is called here, and an action repeats only after its opposite."""
    return edges.select("tick", "action")


def register_hex(wire: DataFrame) -> DataFrame:
    """Adds hex, the registers as devices print them."""
    return wire.withColumn("hex", F.hex("dense"))
