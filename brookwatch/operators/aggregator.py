"""The aggregator: nodes' latest reports, correlation by majority, defense and its commands.

Reports are rows (node_id, ts in seconds, ensemble_score, loda_score, hst_score, anomaly_state, ...).  A tick is a moment at
which reports are correlated, every `seconds`.  A report stands for its node from its time to the node's next one, for
two widths at most, and not beyond a reset; so it belongs to few ticks, and correlation is one expansion and one aggregation,
without a state that grows.  Resets are given as a list, for they are an operator's commands.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How many widths a report lives, the share of nodes that activates the defense, the seconds of grace after a reset.
STALE_WIDTHS, MAJORITY, GRACE = 2, 0.5, 70
REASON = "majority_nodes_under_attack"


def node_latest(reports: DataFrame, at: Column | None = None, stale: float | None = None) -> DataFrame:
    """Each node's last report, of equal times the greatest row; without those older than `stale` seconds before `at`."""
    rest = [c for c in reports.columns if c not in ("node_id", "ts")]
    rows = reports.filter(F.col("node_id") != "").groupBy("node_id").agg(F.max(F.struct("ts", *rest)).alias("r")).select("node_id", "r.*")
    return rows if at is None or stale is None else rows.filter(at - F.col("ts") <= stale)


def _last(resets: Iterable[int], at: Column) -> Column:
    """The last reset up to a time, or null."""
    times = sorted(resets)
    return F.array_max(F.filter(F.array(*[F.lit(int(t)).cast("long") for t in times]), lambda t: t <= at)) if times else F.lit(None).cast("long")


def correlated(reports: DataFrame, seconds: int, resets: Iterable[int] = ()) -> DataFrame:
    """(tick, total, under_attack, max_score, max_loda, max_hst, max_state, in_grace, activated, reason) of every tick that some
    report stands for.  Empty node names report nothing."""
    resets = list(resets)
    node = Window.partitionBy("node_id").orderBy("ts", F.hash(*reports.columns))
    rows = reports.filter(F.col("node_id") != "").withColumn("_next", F.lead("ts").over(node))
    first = F.ceil(F.col("ts") / seconds) * seconds
    end = F.least(F.col("ts") + STALE_WIDTHS * seconds, F.coalesce(F.col("_next") - 1, F.col("ts") + STALE_WIDTHS * seconds))
    rows = rows.withColumn("_first", first.cast("long")).withColumn("_end", end.cast("long")).filter("_first <= _end")
    rows = rows.withColumn("tick", F.explode(F.sequence("_first", "_end", F.lit(seconds).cast("long"))))
    rows = rows.withColumn("_reset", _last(resets, F.col("tick"))).filter("_reset IS NULL OR ts >= _reset")
    out = rows.groupBy("tick").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("anomaly_state") == 1).alias("under_attack"),
        *[F.greatest(F.lit(0.0), F.coalesce(F.max(c), F.lit(0.0))).alias(n) for c, n in (("ensemble_score", "max_score"), ("loda_score", "max_loda"), ("hst_score", "max_hst"))],
        F.greatest(F.lit(0), F.max("anomaly_state")).alias("max_state"),
    )
    grace = F.coalesce(F.col("tick") - _last(resets, F.col("tick")) < GRACE, F.lit(False))
    activated = ~F.col("in_grace") & (F.col("under_attack") / F.col("total") >= MAJORITY)
    out = out.withColumn("in_grace", grace).withColumn("activated", activated)
    return out.withColumn("reason", F.when(F.col("activated"), REASON).otherwise(""))


def defense_edges(correlation: DataFrame, seconds: int) -> DataFrame:
    """(tick, was, activated, action): ticks at which the defense comes on (lockdown) or goes off (unlock).

    The tick before is looked up by its number, so no order over all ticks is needed; a tick that nothing reports in is off.
    """
    on = correlation.filter("activated").select("tick")
    before = on.select((F.col("tick") + seconds).alias("tick"))
    up = on.join(before, "tick", "left_anti").select("tick", F.lit(False).alias("was"), F.lit(True).alias("activated"), F.lit("lockdown").alias("action"))
    down = before.join(on, "tick", "left_anti").select("tick", F.lit(True).alias("was"), F.lit(False).alias("activated"), F.lit("unlock").alias("action"))
    return up.unionByName(down)


def defense_state(correlation: DataFrame) -> DataFrame:
    """One row (activated, global_score, reason): what a node that polls is told."""
    last = correlation.agg(F.max(F.struct("tick", "activated", "max_score", "reason")).alias("r"))
    return last.select(F.coalesce("r.activated", F.lit(False)).alias("activated"), F.coalesce("r.max_score", F.lit(0.0)).alias("global_score"), F.coalesce("r.reason", F.lit("")).alias("reason"))


def escalated(states: DataFrame, correlation: DataFrame, seconds: int) -> DataFrame:
    """Adds defense and escalated to (node_id, ts, state): a node that polls while the defense is on goes from normal to under
    attack; other states stay."""
    on = correlation.select("tick", F.col("activated").alias("defense"))
    out = states.withColumn("tick", (F.floor(F.col("ts") / seconds) * seconds).cast("long")).join(on, "tick", "left").na.fill(False, ["defense"])
    return out.withColumn("escalated", F.when(F.col("defense") & (F.col("state") == 0), 1).otherwise(F.col("state"))).drop("tick")


def type_gauges(reports: DataFrame) -> DataFrame:
    """(node_id, attack_type, value): 1 for a node's named attack, else 0 for NONE."""
    named = F.coalesce((F.col("attack_type") != "") & (F.col("attack_type") != "NONE"), F.lit(False))
    return node_latest(reports).select("node_id", F.when(named, F.col("attack_type")).otherwise("NONE").alias("attack_type"), named.cast("int").alias("value"))


def present(requests: DataFrame, metric: str) -> DataFrame:
    """(node_id, metric, value) of telemetry that a request carries; absent and 0 are the same."""
    return requests.filter(F.col(metric) > 0).select("node_id", F.lit(metric).alias("metric"), F.col(metric).cast("double").alias("value"))
