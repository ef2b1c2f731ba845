"""Ground truth, confusion, time to detect and summaries of experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookwatch.sources.packets import is_attack


def _share(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / F.nullif(b, F.lit(0)))


def ground_truth(packets: DataFrame, seconds: int) -> DataFrame:
    """(window_id, is_attack, attack_count, normal_count, primary_attack_type, window_duration_s) of packets (window_id, label,
    attack_type), empty windows up to the last included.

    A window is an attack if attacks outnumber half the normal packets, rounded down.  The primary type is the commonest one,
    of equals the first by name; an attack without a type goes by its label.
    """
    attack = is_attack(F.col("label"))
    kind = F.when(attack, F.coalesce(F.nullif("attack_type", F.lit("")), F.col("label")))
    by_type = packets.groupBy("window_id", kind.alias("type")).agg(F.count(F.lit(1)).alias("n"))
    found = by_type.groupBy("window_id").agg(
        F.coalesce(F.sum(F.when(F.col("type").isNotNull(), F.col("n"))), F.lit(0)).alias("attack_count"),
        F.coalesce(F.sum(F.when(F.col("type").isNull(), F.col("n"))), F.lit(0)).alias("normal_count"),
        F.min(F.when(F.col("type").isNotNull(), F.struct((-F.col("n")).alias("low"), "type"))).alias("top"),
    )
    last = packets.agg(F.max("window_id").alias("last")).filter("last IS NOT NULL")
    every = last.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("last").cast("long"))).alias("window_id"))
    out = every.join(found, "window_id", "left").na.fill(0, ["attack_count", "normal_count"])
    hit = (F.col("attack_count") > F.floor(F.col("normal_count") / 2)).cast("int")
    return out.select("window_id", hit.alias("is_attack"), "attack_count", "normal_count", F.coalesce("top.type", F.lit("")).alias("primary_attack_type"), F.lit(seconds).alias("window_duration_s"))


def true_alerts(alerts: DataFrame, attacks: DataFrame) -> DataFrame:
    """Alerts in attack windows (both by window_id); a window counts once."""
    return alerts.dropDuplicates(["window_id"]).join(attacks.select("window_id").distinct(), "window_id", "left_semi")


def missed_windows(alerts: DataFrame, attacks: DataFrame) -> DataFrame:
    """Attack windows without an alert."""
    return attacks.select("window_id").distinct().join(alerts, "window_id", "left_anti")


def event_confusion(alerts: DataFrame, attacks: DataFrame, total: DataFrame) -> DataFrame:
    """One row (tp, fp, fn, tn, recall, precision, f1, fpr) from alerts and attack windows by window_id and the one row
    (total) of all windows; tn is what is left of them, 0 at least."""
    marked = attacks.select("window_id").distinct().withColumn("truth", F.lit(True))
    alerted = alerts.select("window_id").distinct().withColumn("alert", F.lit(True))
    both = marked.join(alerted, "window_id", "full").na.fill(False, ["truth", "alert"])
    c = both.agg(F.count_if(F.col("truth") & F.col("alert")).alias("tp"), F.count_if(~F.col("truth") & F.col("alert")).alias("fp"), F.count_if(F.col("truth") & ~F.col("alert")).alias("fn"))
    c = c.join(F.broadcast(total.select("total")))  # one row each
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    c = c.withColumn("tn", F.greatest(F.lit(0), F.col("total") - tp - fn - fp)).drop("total")
    return c.select("*", _share(tp, tp + fn).alias("recall"), _share(tp, tp + fp).alias("precision"), _share(2 * tp, 2 * tp + fp + fn).alias("f1"), _share(fp, fp + F.col("tn")).alias("fpr"))


def time_to_detect(alerts: DataFrame, attacks: DataFrame, start: Column, seconds: float) -> DataFrame:
    """One row (seconds): from the beginning of the first attack window to the first alert in any, 0 at least, null without one.

    Alerts are (window_id, at in seconds); windows of so many seconds count from `start`.
    """
    begun = attacks.agg(F.min("window_id").alias("w"))
    seen = true_alerts(alerts.groupBy("window_id").agg(F.min("at").alias("at")), attacks).agg(F.min("at").alias("at"))
    gap = F.col("at") - (start + F.col("w") * seconds)
    return seen.join(F.broadcast(begun)).select(F.when(gap > 0, gap).when(gap.isNotNull(), 0.0).alias("time_to_detect"))


def timeline_summary(timeline: DataFrame, resources: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """A row for each key (one in all without) from a timeline, and the means of its resources: counts, precision, recall, f1,
    error rates, the mean positive latency of hits, the share of right classes, memory and processor use."""
    keys = keys or []
    t, p = F.col("true_label") == "attack", F.col("predicted_label") == "attack"
    typed = (F.col("attack_type_true") != "") & (F.col("attack_type_pred") != "")
    c = timeline.groupBy(*keys).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"),
        F.coalesce(F.avg(F.when(t & p & (F.col("latency_ms") > 0), F.col("latency_ms"))), F.lit(0.0)).alias("detection_latency_ms"),
        F.coalesce(F.avg(F.when(typed, (F.col("attack_type_true") == F.col("attack_type_pred")).cast("double"))), F.lit(0.0)).alias("classification_accuracy"),
        F.count(F.lit(1)).alias("total_windows"),
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    c = c.select("*", _share(tp, tp + fp).alias("precision"), _share(tp, tp + fn).alias("recall"), _share(2 * tp, 2 * tp + fp + fn).alias("f1_score"), _share(fp, fp + tn).alias("false_positive_rate"), _share(fn, fn + tp).alias("false_negative_rate"))
    if resources is None:
        return c
    use = resources.groupBy(*keys).agg(
        F.coalesce(F.floor(F.avg("rss_bytes")), F.lit(0)).cast("long").alias("avg_rss_bytes"),
        F.coalesce(F.max("rss_bytes"), F.lit(0)).alias("peak_rss_bytes"),
        F.coalesce(F.avg("cpu_percent"), F.lit(0.0)).alias("avg_cpu_percent"),
    )
    return c.join(use, keys, "left") if keys else c.join(F.broadcast(use))


def score_matrix(results: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """A row for each `row` with the greatest value in each of the named columns, and their mean."""
    wide = results.groupBy(row).pivot(column, columns).agg(F.max(value))
    known = [F.col(f"`{c}`") for c in columns]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in known[1:]), F.coalesce(known[0], F.lit(0.0)))
    count = sum((c.isNotNull().cast("int") for c in known[1:]), known[0].isNotNull().cast("int"))
    return wide.withColumn("mean", _share(total, count))
