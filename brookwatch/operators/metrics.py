"""Series of metrics: rates, quantiles of histograms, curves, phases, as-of joins, accuracy and memory figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram_quantile(buckets: DataFrame, keys: list[str], q: float) -> DataFrame:
    """(keys..., quantile) of cumulative buckets (keys..., le, count), le being infinity in the last: linear within a
    bucket, the last finite bound beyond it; null without observations."""
    order = Window.partitionBy(*keys).orderBy("le")
    rows = buckets.withColumn("_low", F.lag("le", 1, 0.0).over(order)).withColumn("_before", F.lag("count", 1, 0).over(order))
    rows = rows.withColumn("_total", F.max("count").over(Window.partitionBy(*keys)))
    rank = q * F.col("_total")
    first = rows.filter((F.col("count") >= rank) & (F.col("_total") > 0)).groupBy(*keys).agg(F.min(F.struct("le", "_low", "_before", "count", "_total")).alias("b"))
    low, le = F.col("b._low"), F.col("b.le")
    share = (q * F.col("b._total") - F.col("b._before")) / F.nullif(F.col("b.count") - F.col("b._before"), F.lit(0))
    return first.select(*keys, F.when(F.isnan(le) | (le == float("inf")), low).otherwise(low + (le - low) * F.coalesce(share, F.lit(0.0))).alias("quantile"))


def exponential_buckets(observations: DataFrame, keys: list[str], value: str, start: float = 0.001, factor: float = 2.0, count: int = 12) -> DataFrame:
    """(keys..., le, count): cumulative counts of the bounds start * factor^k and infinity."""
    bounds = [start * factor**k for k in range(count)] + [float("inf")]
    sums = observations.groupBy(*keys).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)])
    pairs = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(bounds)])
    return sums.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.le", "p.count")


def percentiles(rows: DataFrame, keys: list[str], value: str, at: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(keys..., p50, p95, ...): exact percentiles, interpolated."""
    return rows.groupBy(*keys).agg(*[F.percentile(value, p).alias(f"p{p * 100:g}") for p in at])


def relative_time(samples: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Adds elapsed, the time since the key's first sample: an aggregation and a join, so a long series is no one task."""
    start = samples.groupBy(*keys).agg(F.min(ts).alias("_start"))
    joined = samples.join(start, keys) if keys else samples.join(F.broadcast(start))
    return joined.withColumn("elapsed", F.col(ts) - F.col("_start")).drop("_start")


def phase_of(elapsed: Column, spans: list[tuple[str, float]], last: str) -> Column:
    """The phase that an elapsed time falls in: spans (name, end) in order, and what comes after them."""
    out = F.lit(last)
    for name, end in reversed(spans):
        out = F.when(elapsed < end, name).otherwise(out)
    return out


def intervals(samples: DataFrame, keys: list[str], phase: str, ts: str = "ts") -> DataFrame:
    """(keys..., phase, first_ts, last_ts, samples) of each run of a key's samples in one phase."""
    order = Window.partitionBy(*keys).orderBy(ts)
    changed = F.coalesce(F.col(phase) != F.lag(phase).over(order), F.lit(True)).cast("int")
    runs = samples.withColumn("_changed", changed).withColumn("_run", F.sum("_changed").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_run", phase).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("samples")).drop("_run")


def pivoted(samples: DataFrame, metrics: list[str], ts: str = "ts") -> DataFrame:
    """A row for each time with a column for each of the named metrics of (ts, metric, value); others are passed over."""
    return samples.filter(F.col("metric").isin(metrics)).groupBy(ts).pivot("metric", metrics).agg(F.max("value"))


def as_of(left: DataFrame, right: DataFrame, value: str, bucket: int, keys: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """left (keys..., ts, ...) with the value of the last row of right (keys..., ts, value) up to its time, or null.

    Both sides meet in buckets of `bucket` time units, ordered within each; a bucket begins with the last value of the ones
    before it, which an order over buckets gives, not over rows.  Of equal times in right the greatest value counts.
    """
    keys = keys or []
    rest = [c for c in left.columns if c not in (*keys, ts)]
    slot = F.floor(F.col(ts) / bucket)
    sides = left.select(*keys, ts, F.struct(*rest, F.lit(1).alias("_own")).alias("_row"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_value"))
    known = right.filter(F.col(value).isNotNull()).groupBy(*keys, ts).agg(F.max(value).alias("_value"))
    both = sides.unionByName(known.select(*keys, ts, F.lit(None).cast(sides.schema["_row"].dataType).alias("_row"), "_value")).withColumn("_slot", slot)
    last = known.withColumn("_slot", slot).groupBy(*keys, "_slot").agg(F.max_by("_value", ts).alias("_last"))
    slots = both.select(*keys, "_slot").distinct().join(last, [*keys, "_slot"], "left")
    earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(*keys, "_slot", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    upto = Window.partitionBy(*keys, "_slot").orderBy(ts, F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_seen", F.last("_value", ignorenulls=True).over(upto)).filter("_row IS NOT NULL")
    return filled.join(slots, [*keys, "_slot"]).select(*keys, ts, *[F.col(f"_row.{c}").alias(c) for c in rest], F.coalesce("_seen", "_carried").alias(value))


def resource_use(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., mean_rss, max_rss, mean_heap): the mean and the greatest are different figures and named so."""
    return samples.groupBy(*keys).agg(F.avg("rss_bytes").alias("mean_rss"), F.max("rss_bytes").alias("max_rss"), F.avg("heap_bytes").alias("mean_heap"))


def error_summary(errors: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys..., final_error, max_error, mean_error) of error_pct; the final one is that of the greatest order."""
    return errors.groupBy(*keys).agg(F.max_by("error_pct", order).alias("final_error"), F.max("error_pct").alias("max_error"), F.avg("error_pct").alias("mean_error"))


def memory_savings(rows: DataFrame) -> DataFrame:
    """Adds ratio (exact bytes for each of the sketch's) and saved_pct to (exact_bytes, sketch_bytes)."""
    ratio = F.col("exact_bytes") / F.nullif("sketch_bytes", F.lit(0))
    return rows.withColumn("ratio", ratio).withColumn("saved_pct", 100 * (1 - F.col("sketch_bytes") / F.nullif("exact_bytes", F.lit(0))))


def sketch_bytes(p: Column) -> Column:
    """Bytes of the registers of a precision, six bits each."""
    return F.floor((F.pow(F.lit(2.0), p) * 6 + 7) / 8).cast("long")


def std_error_pct(p: Column) -> Column:
    return 104.0 / F.sqrt(F.pow(F.lit(2.0), p))


def device_for(size: Column) -> Column:
    """The smallest device that two sketches of so many bytes fit on."""
    # A small board's 2 KB less 512 bytes, and a megabyte.
    return F.when(size * 2 <= 2048 - 512, "Arduino Uno (2KB)").when(size * 2 <= 1024 * 1024, "Raspberry Pi 3").otherwise("Server")


def shown_bytes(size: Column) -> Column:
    """A size as people read it, in units of 1024."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for k, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        out = F.when(size >= 1024**k, F.format_string(f"%.2f {unit}", size / float(1024**k))).otherwise(out)
    return out
