"""Sharding by balanced label propagation.

Rows start dealt evenly over the shards (law `rows`: counts at most one apart).  Documents of equal
text are linked.  In each round a join gives every linked row the shards that hold most of its group, as many as the group
needs room for; rows elsewhere propose to move to one of these.
Moves between two shards are accepted in equal numbers both ways, rows without links making up the
difference, so the law holds after every round.  Ranks are distributed counts; only the matrix of
moves between shards (shards squared) reaches the driver.  Groups' proposals are looked up from a broadcast table of checked
size, or by a join of linked rows alone, so a hot group is no hot key.

A null text is an empty one: size 1, linked with other empty ones.  Repeated rows are rows of their own, each with its own slot,
and linked as equal texts; which of two equal rows gets which slot is open, as nothing tells them apart.  A null id is ranked
by its text's hash like any other.  Ties between shards go by a hash of group and shard, ties in rank by hashes of id and
text.  Only the two named columns are read, so other columns cannot clash.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, looked_up, stored, text_of


def _ranked(df: DataFrame, keys: list[str], part: Column, order: list[Column], name: str) -> DataFrame:
    """A rank from 0 within keys: local ranks in hashed parts, plus the counts of the parts before."""
    df = df.withColumn("_part", part)
    local = df.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1)
    counts = df.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = counts.withColumn("_before", F.sum("_n").over(upto) - F.col("_n")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_kp"), "_before")
    on = (F.col("_part") == F.col("_kp"))
    for i, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"_k{i}"))
    return local.join(before, on).withColumn(name, F.col("_local") + F.col("_before")).drop("_part", "_local", "_kp", "_before", *[f"_k{i}" for i in range(len(keys))])


def _flows(movers: dict, singles: dict, shards: int) -> tuple[dict, dict]:
    """For each ordered pair of shards the proposals accepted and the unlinked rows sent along; flows both ways are equal."""
    lack = {(i, j): max(0, movers.get((j, i), 0) - movers.get((i, j), 0)) for i in range(shards) for j in range(shards) if i != j}
    for i in range(shards):
        need, have = sum(lack[i, j] for j in range(shards) if j != i), singles.get(i, 0)
        if need > have:
            lack |= {(i, j): lack[i, j] * have // need for j in range(shards) if j != i}
    take, fill = {}, {}
    for i, j in lack:
        flow = min(movers.get((i, j), 0) + lack[i, j], movers.get((j, i), 0) + lack[j, i])
        take[i, j] = min(movers.get((i, j), 0), flow)
        fill[i, j] = flow - take[i, j]
    return take, fill


def balanced_shards(docs: DataFrame, shards: int = 8, rounds: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, group_size) for every row of docs."""
    raw = text_of(text_col).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.unhex(F.md5(raw)).alias("gid"),
    )
    rows = stored(rows)
    # Ranks are made in parts, several for each partition, so none holds much more than a task reads.
    parts = 4 * max(rows.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("gid")]
    sizes = stored(rows.groupBy("gid").agg(F.count(F.lit(1)).alias("group_size")).filter("group_size > 1"))
    state = _ranked(rows.withColumn("_all", F.lit(0)), ["_all"], part, order, "deal").drop("_all")
    state = looked_up(state, "gid", sizes).select("doc_id", "size", "text_crc32", "gid", F.coalesce("group_size", F.lit(1)).alias("group_size"), F.pmod(F.col("deal"), F.lit(shards)).cast("int").alias("shard"))
    state = stored(state)
    quota = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    room = F.lit(0.9 * max(1, min(quota.values(), default=1)))
    for _ in range(rounds):
        held = state.filter("group_size > 1").groupBy("gid", "shard").agg(F.count(F.lit(1)).alias("n"))
        # A group gathers in the shards that hold most of it, as many as it needs; at most `shards` entries a group.
        best = held.groupBy("gid").agg(F.sort_array(F.collect_list(F.struct("n", F.xxhash64("gid", "shard").alias("tie"), "shard")), asc=False).alias("s"), F.sum("n").alias("all"))
        needed = F.least(F.lit(shards), F.ceil(F.col("all") / room)).cast("int")
        best = best.select("gid", F.transform(F.slice("s", F.lit(1), F.least(F.size("s"), needed)), lambda x: x["shard"]).alias("targets"))
        seen = looked_up(state, "gid", stored(best))
        choice = F.get("targets", F.pmod(F.xxhash64("doc_id", "shard"), F.size("targets")).cast("int"))
        to = F.when(F.col("group_size") == 1, F.lit(-1)).when(F.array_contains("targets", F.col("shard")), F.lit(-2)).otherwise(choice)
        seen = seen.withColumn("to", to.cast("int")).drop("targets")
        ranked = stored(_ranked(seen, ["shard", "to"], part, order, "rank"))
        found = {(r["shard"], r["to"]): r["n"] for r in ranked.groupBy("shard", "to").agg(F.count(F.lit(1)).alias("n")).collect()}
        movers = {k: n for k, n in found.items() if k[1] >= 0}
        if not movers:
            dropped(ranked)
            break
        take, fill = _flows(movers, {i: n for (i, j), n in found.items() if j == -1}, shards)
        moved = F.col("shard")
        for i in range(shards):
            at, own = 0, F.lit(i)
            for j in range(shards):
                if i != j:
                    if take[i, j]:
                        own = F.when((F.col("to") == j) & (F.col("rank") < take[i, j]), F.lit(j)).otherwise(own)
                    if fill[i, j]:
                        own = F.when((F.col("to") == -1) & (F.col("rank") >= at) & (F.col("rank") < at + fill[i, j]), F.lit(j)).otherwise(own)
                        at += fill[i, j]
            moved = F.when(F.col("shard") == i, own).otherwise(moved)
        before, state = state, stored(ranked.select("doc_id", "size", "text_crc32", "gid", "group_size", moved.cast("int").alias("shard")))
        dropped(before, ranked)
        if not any(take.values()):
            break
    out = _ranked(state, ["shard"], part, order, "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("group_size").cast("long").alias("group_size"))
