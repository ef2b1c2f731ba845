"""Detectors behind one interface: rows (node_id, window_start, sources, ...) in, the same with score, baseline, trained, alert out.

Threshold and z-score are window functions; EWMA, LODA, half-space trees and the ensemble are folds with a state of a
fixed size for each node.  Parameters out of range become the defaults.  A new epoch (`epoch` in the key) is a reset.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookwatch.operators import online, windows


class Detector(ABC):
    """What all detectors offer: a name, scores, alerts."""

    name: str

    @abstractmethod
    def scored(self, rows: DataFrame) -> DataFrame:
        """rows with score, baseline (null where there is none), trained and alert."""

    def alerts(self, rows: DataFrame) -> DataFrame:
        """The rows that alert."""
        return self.scored(rows).filter("alert")


def _made(rows: DataFrame, score, baseline, trained, alert) -> DataFrame:
    """Adds the four columns of a detector."""
    return rows.withColumns({"score": score.cast("double"), "baseline": baseline.cast("double"), "trained": trained, "alert": alert})


class Threshold(Detector):
    """More sources than a number."""

    name = "threshold"

    def __init__(self, threshold: int = 5000):
        self.threshold = threshold

    def scored(self, rows: DataFrame) -> DataFrame:
        return _made(rows, F.col("sources"), F.lit(None), F.lit(True), F.col("sources") > self.threshold)


class ZScore(Detector):
    """Standard deviations above the mean of the last windows."""

    name = "zscore"

    def __init__(self, history: int = 20, threshold: float = 3.0):
        self.history, self.threshold = max(5, history), threshold

    def scored(self, rows: DataFrame) -> DataFrame:
        z = windows.z_scores(rows, self.history, self.threshold).select("node_id", "window_start", "z", "mean", "n")
        both = rows.join(z, ["node_id", "window_start"])
        return _made(both, F.col("z"), F.col("mean"), F.col("n") >= 5, F.col("z") > self.threshold).drop("z", "mean", "n")


class Alias(ZScore):
    """The former learned detector: a z-score of 20 windows and threshold 3."""

    name = "ml"

    def __init__(self):
        super().__init__(20, 3.0)


class Ewma(Detector):
    """A count well above the exponentially weighted mean before it."""

    name = "ewma"

    def __init__(self, alpha: float = 0.2, deviation: float = 2.0, warmup: int = 5):
        self.options = (alpha, deviation, warmup)

    def scored(self, rows: DataFrame) -> DataFrame:
        out = online.ewma_alerts(rows, *self.options).withColumnRenamed("baseline", "_before")
        return _made(out, (F.col("sources") - F.col("_before")) / F.nullif("_before", F.lit(0.0)), F.col("_before"), F.col("_before") != 0, F.col("alert")).drop("_before", "ewma")


class _Scores(Detector):
    """Detectors that score and never alert by themselves; rows carry `vector`."""

    def _start(self):
        raise NotImplementedError

    def scored(self, rows: DataFrame) -> DataFrame:
        return online.scored_by(rows, self._start).withColumns({"baseline": F.lit(None).cast("double"), "alert": F.lit(False)})


class Loda(_Scores):
    name = "loda"

    def __init__(self, seed: int = 42, warmup: int = 10):
        self.seed, self.warmup = seed, warmup

    def _start(self):
        return online.Loda(self.seed, self.warmup)


class HalfSpaceTrees(_Scores):
    name = "hst"

    def __init__(self, seed: int = 43, window: int = 50, normalise: bool = False):
        self.options = (seed, window, normalise)

    def _start(self):
        return online.HalfSpaceTrees(*self.options)


class Ensemble(Detector):
    """Weighted LODA, half-space trees, z-score and EWMA; weights (0.8, 0, ...) and (0, 0.8, ...) are the ablations."""

    name = "ensemble"

    def __init__(self, seed: int = 42, threshold: float = 0.6, weights: tuple[float, ...] = (0.15, 0.15, 0.4, 0.3), normalise: bool = False):
        self.options = (seed, threshold, weights, normalise)

    def scored(self, rows: DataFrame) -> DataFrame:
        out = online.ensemble_scores(rows, *self.options)
        return out.withColumns({"baseline": F.lit(None).cast("double"), "trained": F.lit(True)})


DETECTORS = {d.name: d for d in (Threshold, ZScore, Alias, Ewma, Loda, HalfSpaceTrees, Ensemble)}


def detector(name: str, **options) -> Detector:
    if name not in DETECTORS:
        raise ValueError(f"the detector is one of {sorted(DETECTORS)}, not {name!r}")
    return DETECTORS[name](**options)
