"""Gap filling, runs of attack windows, latency curves and summaries of experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def filled(windows: DataFrame, seconds: int = 3600) -> DataFrame:
    """Every window between a node's first and last, with zeros where it has no packets."""
    span = windows.groupBy("node_id").agg(F.min("window_start").alias("a"), F.max("window_start").alias("b"))
    every = span.select("node_id", F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {int(seconds)} SECONDS"))).alias("window_start"))
    return every.join(windows, ["node_id", "window_start"], "left").na.fill(0, ["packets", "bytes", "sources"])


def recent_spread(windows: DataFrame, last: int = 5) -> DataFrame:
    """Adds the mean and population variance of the last windows' sources, this one included."""
    frame = Window.partitionBy("node_id").orderBy("window_start").rowsBetween(1 - last, 0)
    return windows.withColumn("recent_mean", F.avg("sources").over(frame)).withColumn("recent_variance", F.var_pop("sources").over(frame))


def attack_runs(states: DataFrame, flag: str) -> DataFrame:
    """(node_id, first_window, last_window, windows) of each run of consecutive rows with the flag set."""
    order = Window.partitionBy("node_id").orderBy("window_start")
    on = F.coalesce(F.col(flag).cast("boolean"), F.lit(False))
    marked = states.select("node_id", "window_start", on.alias("on"), F.sum((~on).cast("int")).over(order).alias("run"))
    out = marked.filter("on").groupBy("node_id", "run").agg(F.min("window_start").alias("first_window"), F.max("window_start").alias("last_window"), F.count(F.lit(1)).alias("windows"))
    return out.drop("run")


def resets_rate(samples: DataFrame, counter: str, seconds: int = 60) -> DataFrame:
    """Adds rate: the counter's increases within the last seconds, a second; a drop counts as a reset."""
    order = Window.partitionBy("node_id").orderBy("seconds")
    step = F.greatest(F.lit(0), F.col(counter) - F.lag(counter).over(order))
    rows = samples.withColumn("_step", F.coalesce(step, F.lit(0)))
    return rows.withColumn("rate", F.sum("_step").over(order.rangeBetween(-seconds, 0)) / seconds).drop("_step")


def latency_curve(events: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value, share) of an empirical distribution: a count for each distinct value, then running sums."""
    n = events.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    part = Window.partitionBy(by)
    return n.select(by, value, (F.sum("n").over(part.orderBy(value)) / F.sum("n").over(part)).alias("share"))


def summary(events: DataFrame) -> DataFrame:
    """One row from (truth, alert, latency): rates of errors and the mean positive latency of hits; 0 where undefined."""
    t, p = F.col("truth").cast("boolean"), F.col("alert").cast("boolean")
    c = events.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"), F.coalesce(F.avg(F.when(t & p & (F.col("latency") > 0), F.col("latency"))), F.lit(0.0)).alias("mean_latency"))

    def share(a: str, b: str):
        return F.when(F.col(a) + F.col(b) == 0, 0.0).otherwise(F.col(a) / (F.col(a) + F.col(b)))

    c = c.select("*", share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"), share("fp", "tn").alias("fpr"), share("fn", "tp").alias("fnr"))
    both = F.col("precision") + F.col("recall")
    return c.withColumn("f1", F.when(both == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / both))
