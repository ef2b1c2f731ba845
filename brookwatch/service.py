"""A sketch as a service object: insert, estimate, export, merge and reset, over relations; nothing runs until it is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookwatch.functions import sketch
from brookwatch.functions.hashing import is_ip
from brookwatch.functions.sketch import DEFAULT, SketchConfig


class SketchService:
    """Holds the union of what was inserted or merged since the last reset, per epoch; invalid addresses are refused apart."""

    def __init__(self, spark: SparkSession, config: SketchConfig = DEFAULT):
        self.spark, self.config, self.epoch = spark, config, 0
        self._empty()

    def _empty(self) -> None:
        self.slots = self.spark.createDataFrame([], "slot int, rank int")
        self.dense: DataFrame | None = None

    def insert(self, packets: DataFrame, value: str = "src_ip") -> DataFrame:
        """Takes the addresses of packets in and returns the rows that hold none."""
        self.slots = sketch.union([], self.slots, sketch.sparse(packets, [], value, self.config), config=self.config)
        return packets.filter(~is_ip(F.col(value)))

    def merge(self, wire: DataFrame) -> None:
        """Takes exported sketches in: rows (p, p_prime, sparse) or (p, dense); others raise ValueError."""
        if "sparse" in wire.columns:
            self.slots = sketch.union([], self.slots, sketch.import_sparse(wire, [], self.config), config=self.config)
        elif "dense" in wire.columns:
            more = sketch.import_dense(wire, [], self.config)
            self.dense = more if self.dense is None else sketch.merge(self.dense.unionByName(more), [])
        else:
            raise ValueError("an exported sketch is sparse or dense")

    def registers(self) -> DataFrame:
        """(idx, rho) of all that is held."""
        own = sketch.to_dense(self.slots, [], self.config)
        return own if self.dense is None else sketch.merge(own.unionByName(self.dense), [])

    def register(self, index: int) -> int:
        """One register's value; 0 if it is empty."""
        if not 0 <= index < self.config.m:
            raise ValueError(f"a register's number is 0 to {self.config.m - 1}")
        row = self.registers().filter(F.col("idx") == index).first()
        return row["rho"] if row else 0

    def estimate(self) -> int:
        if self.dense is None:
            row = sketch.estimates(self.slots, [], self.config).first()
        else:
            row = sketch.dense_estimates(self.registers(), [], self.config).first()
        return int(row["estimate"] or 0) if row else 0

    def get_sketch(self) -> DataFrame:
        """The exported sketch: sparse while that takes less room and nothing dense was merged, else dense."""
        if self.dense is None and self.slots.count() * (self.config.p + 11) < 6 * self.config.m:
            return sketch.export_sparse(self.slots, [], self.config)
        return sketch.export_dense(self.registers(), [], self.config)

    def slot_count(self) -> int:
        return self.slots.count()

    def reset(self) -> int:
        """Forgets all and returns the new epoch's number."""
        self.epoch += 1
        self._empty()
        return self.epoch

    def health(self) -> dict:
        return {"status": "ok", "epoch": self.epoch, "p": self.config.p, "hash": self.config.hash}


class Aggregator(SketchService):
    """The service that nodes report to: merges, estimates and answers polls, but takes no addresses itself."""

    def __init__(self, spark: SparkSession, config: SketchConfig = DEFAULT, seconds: int = 10):
        super().__init__(spark, config)
        self.seconds, self.reports, self.resets = seconds, None, []

    def insert(self, packets: DataFrame, value: str = "src_ip") -> DataFrame:
        raise NotImplementedError("an aggregator takes sketches, not addresses")

    def report(self, reports: DataFrame) -> None:
        self.reports = reports if self.reports is None else self.reports.unionByName(reports, allowMissingColumns=True)

    def defense_command(self) -> dict:
        from brookwatch.operators import aggregator

        if self.reports is None:
            return {"activated": False, "global_score": 0.0, "reason": ""}
        return aggregator.defense_state(aggregator.correlated(self.reports, self.seconds, self.resets)).first().asDict()

    def reset_at(self, ts: int) -> int:
        """Forgets sketches and reports at a time, and begins the grace after it."""
        self.resets.append(ts)
        self.reports = None
        return self.reset()
