"""Structured Streaming forms: tumbling windows, sketches, detectors with keyed state, sinks batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from brookwatch import sinks
from brookwatch.functions import sketch
from brookwatch.operators import online


def traffic_stream(packets: DataFrame, width: str = "10 seconds", late: str = "20 seconds") -> DataFrame:
    """(node_id, window_start, packets, bytes, sources): sources by a mergeable sketch, rows later than the watermark dropped.

    A late row within the watermark counts in the window of its own time.
    """
    rows = packets.withWatermark("ts", late).groupBy("node_id", F.window("ts", width))
    return rows.agg(F.count(F.lit(1)).alias("packets"), F.sum("byte_len").alias("bytes"), F.approx_count_distinct("src_ip", 0.01).alias("sources")).select("node_id", F.col("window.start").alias("window_start"), "packets", "bytes", "sources")


def register_stream(packets: DataFrame, width: str = "10 seconds", late: str = "20 seconds", config: sketch.SketchConfig = sketch.DEFAULT) -> DataFrame:
    """(node_id, window_start, slot, rank): the sparse sketch of every closed window, a row for each slot."""
    rows = packets.withWatermark("ts", late)
    h = rows.select("node_id", "ts", sketch.H.HASHES[config.hash](sketch.H.ip_bytes(F.col("src_ip"))).alias("h")).filter("h IS NOT NULL")
    slot, rank = sketch.H.sparse_slot(F.col("h"), config.p, config.p_prime)
    out = h.select("node_id", "ts", slot.alias("slot"), rank.alias("rank")).groupBy("node_id", F.window("ts", width), "slot").agg(F.max("rank").alias("rank"))
    return out.select("node_id", F.col("window.start").alias("window_start"), "slot", "rank")


def state_stream(scores: DataFrame, threshold: float = 0.6, confirm: int = 3, recover: int = 5) -> DataFrame:
    """Adds state to a stream (node_id, window_start, score): the batch form's state machine, kept between batches."""
    return online.fold_stream(scores, "node_id", "window_start", lambda: online.StateMachine(threshold, confirm, recover), online._machine, "state int")


def ensemble_stream(features: DataFrame, seed: int = 42, threshold: float = 0.6, weights: tuple[float, ...] = (0.15, 0.15, 0.4, 0.3)) -> DataFrame:
    """Adds the ensemble's scores to a stream of windows' features."""
    return online.fold_stream(features, "node_id", "window_start", lambda: online.Ensemble(seed, threshold, weights), online._ensemble, online.ENSEMBLE)


def gate_stream(packets: DataFrame, rate: float = 1000.0, per_source: int = 50, decay: float = 5.0) -> DataFrame:
    """Adds allowed, active and dropped to a stream (node_id, seconds, src_ip, state)."""
    return online.fold_stream(packets, "node_id", "seconds", lambda: online.Gate(rate, per_source, decay), online._gated, "allowed boolean, active boolean, dropped long")


def shipped(packets: DataFrame, path: str, checkpoint: str, keys: list[str] | None = None) -> DataStreamWriter:
    """A writer that ships a stream's partial sketches to a folder, batch by batch."""
    return packets.writeStream.foreachBatch(sinks.ship_sketches(path, keys or ["node_id"])).option("checkpointLocation", checkpoint)


def each_batch(stream: DataFrame, write: Callable, checkpoint: str) -> DataStreamWriter:
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
