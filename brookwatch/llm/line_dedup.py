"""Line deduplication by distinct-site spread, in DataFrame functions only.

Lines are keyed by a hash of their text without outer white space.  One pass over the texts leaves a row for each
line: its text's key, place, hash and site.  Lines seen at least `min_sites` times get a HyperLogLog sketch of their
sites, merged by aggregation; where the estimate is near the threshold, sites are counted exactly.  Lines on
`min_sites` sites or more are boilerplate and leave every document.  Only texts that lose lines are looked up by
key, and lines are joined with broadcast tables of checked size, or in skew-split partitions beyond it.

Null texts count as empty and stay null; a null site is a site of its own (the empty name); blank lines are never
boilerplate and stay.  Repeated rows count as often as they occur, but their sites once.  Neither ties nor order matter: a
line goes from all documents or from none.  All columns of docs are returned as they are; a column lines_removed of docs is
replaced.  Names of our own are chosen beside those of docs, so none can clash.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, free_name, joined, looked_up, stored, text_key, text_of

MIN_SITES = 5
#: Relative distance from the threshold within which the estimate is not trusted (over eight standard errors at 2^12 registers).
NEAR = 0.15
_OUTER = " \t\n\x0b\x0c\r"


def lines_of(docs: DataFrame, site_col: str = "source", text_col: str = "text") -> DataFrame:
    """(key, site, pos, line) for each line that is not blank; key is the text's, line the line's hash."""
    rows = docs.select(text_key(text_col).alias("key"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.posexplode(F.split(text_of(text_col), "\n", -1)).alias("pos", "raw"))
    rows = rows.withColumn("raw", F.btrim("raw", F.lit(_OUTER))).filter("raw <> ''")
    return rows.select("key", "site", "pos", F.unhex(F.md5(F.col("raw").cast("binary"))).alias("line"))


def boilerplate_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(line, sites) for each hash of a line of the stored rows (line, site) on min_sites sites or more."""
    often = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.min("site").alias("a"), F.max("site").alias("z"))
    often = stored(often.filter((F.col("n") >= min_sites) & ((F.col("a") < F.col("z")) | F.lit(min_sites <= 1))).select("line"))
    # A site counts once for each map task and line before the sketches are merged.
    sketched = stored(joined(lines.select("line", "site"), often, "line", "left_semi").groupBy("line").agg(F.hll_sketch_agg("site", 12).alias("s")).select("line", F.hll_sketch_estimate("s").alias("sites")))
    sure = sketched.filter(F.col("sites") > min_sites * (1 + NEAR) + 1)
    near = stored(sketched.filter((F.col("sites") >= min_sites * (1 - NEAR) - 1) & (F.col("sites") <= min_sites * (1 + NEAR) + 1)).select("line"))
    # Two aggregations, so a frequent line's sites are first made distinct in every map task.
    exact = joined(lines.select("line", "site"), near, "line", "left_semi").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("sites"))
    return sure.unionByName(exact.filter(F.col("sites") >= min_sites))


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, site_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs with the text's boilerplate lines removed, and the column lines_removed."""
    key, gone = free_name(docs, "key"), free_name(docs, "gone")
    lines = stored(lines_of(docs, site_col, text_col))
    bad = stored(boilerplate_lines(lines, min_sites).select("line"))
    hits = joined(lines.select("key", "pos", "line"), bad, "line", "left_semi")
    places = stored(hits.groupBy("key").agg(F.collect_set("pos").alias("gone")).select(F.col("key").alias(key), F.col("gone").alias(gone)))
    dropped(lines, bad)
    out = looked_up(docs.withColumn(key, text_key(text_col)), key, places)
    left = F.array_join(F.filter(F.split(text_col, "\n", -1), lambda x, i: ~F.array_contains(gone, i)), "\n")
    kept = [F.when(F.col(gone).isNull(), F.col(c)).otherwise(left).alias(c) if c == text_col else F.col(c) for c in docs.columns if c.lower() != "lines_removed"]
    return out.select(*kept, F.coalesce(F.size(gone), F.lit(0)).alias("lines_removed"))
