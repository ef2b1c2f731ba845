"""Near-duplicate detection by SetSketch registers.

1. One pass over the texts gives every document the hash and size of its shingle set and the set's SetSketch: for
   each hash function the exponentially spaced, truncated minimum floor(1 - log_b(min)) of its shingles' exponential
   values, two bytes each.  Registers of a union are maxima.  Equal sets become one class; sets are not stored.
2. Bands of registers are hashed into buckets.  A bucket first links its members to its hub, the member that shares
   its buckets with most others (a star, so a group of copies costs one row for each member).  After these links are
   confirmed, members of different components of one bucket meet too, but for pairs inside its largest component.
   Where such pairs would be more than `WIDE` in a bucket, and in all such buckets of a hub more than a sixth of its members'
   shingles, which is about what would be looked at instead, an exact prefix filter around a pivot B, the most central
   member of the hub's component, takes their place.  So a hub never makes more rows than its members have shingles.  With D(x) the shingles that x and B do not share, two sets have
   |x ^ y| = |D(x) ^ D(y)|, and similarity t or more means |x ^ y| <= c (|x| + |y|) with c = (1 - t) / (1 + t).  If y is
   not that similar to B, |D(y)| > c (|y| + |B|), so x and y must share more than (|D(x)| + c (|B| - |x|)) / 2
   elements.  In an order that puts what B lacks first, their first common element is then followed by that many in
   D(x), which few elements are, and by (|D(x)| - c |x| + |D(y)| - c |y|) / 2 in both; edits of a member's own are left out.
   As |x ^ y| <= (1 - t) / t |x|, all but so many of D(x) are shared too, so what is nearer to its end is not looked at.
   Members similar to B are linked with it, and so in one component.
3. Pairs pass if their Jaccard similarity, estimated jointly from all registers by likelihood with the known set
   sizes, may reach the threshold; then full sets, made again from the candidates' texts alone, are compared.
4. Components come from contraction rounds.

Null and empty texts have an empty set and are linked with nothing.  Rows with one id are one document, so all their
texts share a component; repeated rows change nothing.  A row with a null id takes the component of its text (null
if no row with an id has that set) and is kept if that is null.  Ties go to the smallest id.  Only the two named
columns are read, so other columns cannot clash.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FEW, arrow_map, components, dropped, joined, looked_up, mix64, narrowed, shingle_hashes, space_words, stored

BANDS, ROWS = 28, 5  # at similarity 0.8 all bands miss with probability (1 - 0.8^5)^28 = 1.5e-5
BASE, RATE, TOP = 1.001, 20.0, 65534
#: Pairs are dropped before the full comparison if the threshold is exp(this) times less likely than the best estimate.
DOUBT = 12.0
#: Pairs of different components in one bucket beyond which its members meet by their rarest differences from a pivot, where these are fewer.  Changes speed only.
WIDE = 256


def _functions(m: int) -> tuple[np.ndarray, np.ndarray]:
    seed = mix64(np.arange(1, 2 * m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seed[:m] | np.uint64(1), seed[m:]


def registers(hashes: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes."""
    times, plus = _functions(m)
    least = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        least = np.minimum(least, (hashes[at : at + 512, None] * times + plus).min(axis=0))
    value = -np.log1p(-np.minimum((least.astype(np.float64) + 0.5) / 2.0**64, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, TOP + 1).astype("<u2")


def likely(above: np.ndarray, below: np.ndarray, m: int, n_a: np.ndarray, n_b: np.ndarray, threshold: float, doubt: float = DOUBT) -> np.ndarray:
    """Whether similarity `threshold` or more is not ruled out, given how many registers are larger and smaller."""
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    grid = np.linspace(0.0, 1.0, 101)[None, :]
    inner = np.minimum(grid, np.minimum(u / v, v / u))

    def p(x):
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-9, 1)

    more, less = p(u - v * inner), p(v - u * inner)
    same = np.clip(1 - more - less, 1e-9, 1)
    ll = above[:, None] * np.log(more) + below[:, None] * np.log(less) + (m - above - below)[:, None] * np.log(same)
    return ll[:, grid[0] >= threshold - 1e-9].max(axis=1) >= ll.max(axis=1) - doubt


def _sketches(shingle: int):
    import xxhash

    def rows(c):
        sets = [shingle_hashes(space_words(t), shingle) for t in c["text"]]
        return {
            "doc_id": c["doc_id"],
            "n": [len(s) for s in sets],
            "cls": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
            "regs": [registers(s).tobytes() if len(s) else None for s in sets],
        }

    return rows


def _sets(shingle: int):
    def rows(c):
        return {"id": c["id"], "shingles": [shingle_hashes(space_words(t), shingle).astype("<u8").tobytes() for t in c["text"]]}

    return rows


def _differences(percent: int):
    """For pairs (pivot a, member b): a row for each shingle h of b's difference from a.

    What a lacks (added) goes before what b lacks in the common order.  `rest` counts, for the latter, the shingles that b
    lacks from h on, and for the former all that b lacks; `need` is how many must be shared with any far member, and two
    members' excesses over 2 (100 + percent) how many with one another.  Shingles that b lacks with fewer from them on than
    must be shared are left out, but for b's first difference, which tells that b is there.
    """
    names = ("a", "b", "comp", "n", "far", "need", "excess")

    def rows(c):
        out = {k: [] for k in (*names, "h", "added", "rest")}
        for a, b, comp, x, y in zip(c["a"], c["b"], c["comp"], c["s_a"], c["s_b"]):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            added, lacks = (np.setdiff1d(*pair, assume_unique=True).view(np.int64) for pair in ((y, x), (x, y)))
            n, lost = len(added) + len(lacks), len(lacks)
            far = (100 + percent) * n > (100 - percent) * (len(x) + len(y))
            need = ((100 + percent) * n + (100 - percent) * (len(x) - len(y))) // (2 * (100 + percent)) + 1
            excess = (100 + percent) * n - (100 - percent) * len(y)
            least = n - (100 - percent) * len(y) // percent
            rest = np.arange(lost, 0, -1)
            looked = rest >= (least if far else max(least, need))
            if lost and not len(added):
                looked[0] = True
            h, rest = np.concatenate([added, np.sort(lacks)[looked]]), np.concatenate([np.full(len(added), lost), rest[looked]])
            for k, v in zip(names, (a, b, comp, len(y), far, need, excess)):
                out[k].append(np.full(len(h), v))
            out["h"].append(h)
            out["added"].append(np.arange(len(h)) < len(added))
            out["rest"].append(rest)
        return {k: np.concatenate(v) for k, v in out.items()} if out["a"] else None

    return rows


def _band(c):
    if not c["id"]:
        return None
    regs = np.frombuffer(b"".join(c["regs"]), "<u2").reshape(len(c["id"]), BANDS, ROWS).astype(np.uint64)
    bucket = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), regs.shape[:2])
    for r in range(ROWS):
        bucket = mix64(bucket * np.uint64(0x9E3779B97F4A7C15) + regs[:, :, r])
    return {"id": np.repeat(np.array(c["id"], np.int64), BANDS), "n": np.repeat(np.array(c["n"], np.int64), BANDS), "bucket": bucket.ravel().view(np.int64)}


def _possible(threshold: float):
    def rows(c):
        if not c["a"]:
            return None
        x, y = (np.frombuffer(b"".join(c[k]), "<u2").reshape(len(c["a"]), -1) for k in ("regs_a", "regs_b"))
        n_a, n_b = np.array(c["n_a"], float), np.array(c["n_b"], float)
        keep = likely((x > y).sum(1), (x < y).sum(1), x.shape[1], n_a, n_b, threshold)
        return {k: [v for v, ok in zip(c[k], keep) if ok] for k in ("a", "b")}

    return rows


def _confirmed(percent: int):
    def rows(c):
        a, b = [], []
        for i, j, x, y in zip(c["a"], c["b"], c["s_a"], c["s_b"]):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                a.append(i)
                b.append(j)
        return {"a": a, "b": b}

    return rows


def _both(pairs: DataFrame, table: DataFrame, columns: dict[str, str], share: int = 128) -> DataFrame:
    """Joins columns of table (id, ...), named with _a and _b, to the sides of stored pairs (a, b); of more than FEW pairs, a hub's row is repeated once for each `share` of its pairs."""
    sides = {side: table.select(F.col("id").alias(side), *[F.col(k).alias(f"{v}_{side}") for k, v in columns.items()]) for side in ("a", "b")}
    if pairs.count() <= FEW:
        return pairs.join(sides["a"], "a").join(sides["b"], "b")
    ends = pairs.select(F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("end")) for s in ("a", "b")])).alias("at"))
    copies = stored(ends.groupBy("at.side", "at.end").agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("copies")).filter("copies > 1"))
    n = F.coalesce("copies", F.lit(1))
    for side, other in (("a", "b"), ("b", "a")):
        of_side = copies.filter(F.col("side") == side).select(F.col("end").alias(side), "copies")
        rows = sides[side].join(of_side, side, "left").select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("salt")).drop("copies")
        salted = pairs.join(of_side, side, "left").withColumn("salt", F.pmod(F.xxhash64(other), n).cast("int")).drop("copies")
        pairs = salted.join(rows, [side, "salt"]).drop("salt")
    return pairs


def _met(groups: DataFrame, found: DataFrame) -> DataFrame:
    """The rows (bucket, id, n, ...) of buckets with several components: adds comp, the bucket's largest, how many are not in it and the count of pairs to compare."""
    comp = groups.join(found, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    sizes = comp.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("k"))
    mixed = sizes.groupBy("bucket").agg(F.max_by("comp", F.struct("k", "comp")).alias("largest"), F.sum("k").alias("k"), F.max("k").alias("top"), F.count(F.lit(1)).alias("comps"))
    mixed = mixed.filter("comps > 1").select("bucket", "largest", (F.col("k") - F.col("top")).alias("others"), (F.col("k") * (F.col("k") - F.col("top"))).alias("cost"))
    return comp.join(mixed, "bucket")


def _crowded(met: DataFrame, wide: int) -> DataFrame:
    """The hubs (hub) whose buckets of more than `wide` pairs have more of them together than a sixth of their members' shingles."""
    each = met.filter(F.col("cost") > wide).groupBy("hub", "id").agg(F.sum("others").alias("pairs"), F.max("n").alias("n"))
    return each.groupBy("hub").agg(F.sum("pairs").alias("pairs"), F.sum("n").alias("n")).filter("6 * pairs > n").select("hub")


def _cross(met: DataFrame) -> DataFrame:
    """Pairs of one bucket from different components, each once."""
    left, right = (met.select("bucket", F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("comp").alias(f"c_{s}"), "largest") for s in ("a", "b"))
    return left.filter("c_a <> largest").join(right.drop("largest"), "bucket").filter("c_a <> c_b AND (a < b OR c_b = largest)").select("a", "b", "n_a", "n_b")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", wide: int = WIDE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    member = stored(arrow_map(rows, _sketches(shingle), "doc_id long, n long, cls binary, regs binary", 128))
    named = member.filter("n > 0 AND doc_id IS NOT NULL")
    nodes = stored(named.groupBy("cls").agg(F.min(F.struct("doc_id", "n", "regs")).alias("m")).select("cls", F.col("m.doc_id").alias("id"), "m.n", "m.regs"))
    bands = arrow_map(nodes.select("id", "n", "regs"), _band, "id long, n long, bucket long")
    sizes = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    shared = stored(bands.join(sizes, "bucket"))
    central = stored(shared.groupBy("id").agg(F.sum("k").alias("central")))
    hubs = shared.join(central, "id").groupBy("bucket").agg(F.max(F.struct("central", (-F.col("id")).alias("low"), "n")).alias("m"))
    hubs = hubs.select("bucket", (-F.col("m.low")).alias("hub"), F.col("m.n").alias("n_hub"))
    inside = stored(shared.select("bucket", "id", "n").join(hubs, "bucket"))
    dropped(shared)
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")

    def sets(ids: DataFrame) -> DataFrame:
        """(id, shingles) of the ids in the stored column id, made from the texts."""
        named_rows = rows.withColumnRenamed("doc_id", "id")
        texts = (named_rows.join(F.broadcast(ids), "id", "left_semi") if ids.count() <= FEW else narrowed(named_rows, "id", ids)).distinct()
        return stored(arrow_map(texts, _sets(shingle), "id long, shingles binary", 128))

    def confirm(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs.filter(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
        seen = _both(pairs, nodes, {"regs": "regs", "n": "n"})
        likely_pairs = stored(arrow_map(seen, _possible(percent / 100), "a long, b long").distinct())
        full = sets(stored(likely_pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
        whole = _both(likely_pairs, full, {"shingles": "s"})
        links = stored(arrow_map(whole, _confirmed(percent), "a long, b long", 64))
        dropped(pairs, likely_pairs, full)
        return links

    def around_pivots(met: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs (a, b, n_a, n_b) of different components around one pivot that share a difference from it that
        may be their first, and the links (a, b) with the pivots."""
        best = F.max(F.struct("central", (-F.col("id")).alias("low"))).alias("m")
        pivots = stored(central.join(found, "id").groupBy("comp").agg(best).select(F.col("comp").alias("home"), (-F.col("m.low")).alias("pivot")))
        hub_of = found.select(F.col("id").alias("hub"), F.col("comp").alias("home"))
        homes = stored(met.select("hub").distinct().join(hub_of, "hub").join(pivots, "home").select("hub", "pivot"))
        placed = joined(met, homes, "hub", "left").select(F.coalesce("pivot", "hub").alias("a"), F.col("id").alias("b"), "comp")
        spokes = stored(placed.filter("a <> b").distinct())
        full = sets(stored(spokes.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
        whole = _both(spokes, full, {"shingles": "s"})
        made = "a long, b long, comp long, n long, far boolean, need long, excess long, h long, added boolean, rest long"
        diff = stored(arrow_map(whole, _differences(percent), made, 128))
        dropped(spokes, full)
        # Added shingles that no other member has need not be looked at.  Ranks run within one member of one pivot.
        held = stored(diff.filter("added").groupBy("a", "h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").drop("df"))
        later = F.count(F.lit(1)).over(Window.partitionBy("a", "b").orderBy(F.col("h").desc()))
        added = diff.filter("added").join(held, ["a", "h"]).withColumn("rest", F.col("rest") + later)
        common = diff.filter("NOT added").unionByName(added)
        # From a pair's first common shingle on, both must have as many as their overlap needs.
        left, right = (rows.select("a", "h", F.col("b").alias(i), F.col("comp").alias(f"c_{i}"), F.col("n").alias(f"n_{j}"), F.col("excess").alias(f"e_{j}"), F.col("rest").alias(f"rest_{j}")) for rows, i, j in ((common.filter("rest >= need"), "x", "a"), (common.filter("far"), "y", "b")))
        enough = 2 * (100 + percent) * F.least("rest_a", "rest_b") >= F.col("e_a") + F.col("e_b")
        pairs = left.join(right, ["a", "h"]).filter((F.col("c_x") != F.col("c_y")) & enough).select(F.col("x").alias("a"), F.col("y").alias("b"), "n_a", "n_b")
        return pairs, stored(diff.filter("NOT far").select("a", "b").distinct())

    star = confirm(inside.filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b"), F.col("n").alias("n_a"), F.col("n_hub").alias("n_b")))
    found = components(star).select("id", F.col("component").alias("comp"))
    met = stored(_met(inside.select("bucket", "id", "n", "hub"), found))
    dropped(inside)
    crowded = stored(_crowded(met, wide))
    over = met.filter(F.col("cost") > wide)
    few, many = joined(over, crowded, "hub", "left_anti"), joined(over, crowded, "hub", "left_semi")
    pairs, links = _cross(met.filter(F.col("cost") <= wide).unionByName(few.select(*met.columns))), star
    if not many.isEmpty():
        more, near = around_pivots(many)
        pairs, links = pairs.unionByName(more), star.unionByName(near)
    # A repeated id may stand in several classes; they are one document.
    of_class = nodes.select("cls", F.col("id").alias("node"))
    several = stored(named.groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("z")).filter("a < z").select("doc_id"))
    edges = links.unionByName(confirm(pairs))
    if not several.isEmpty():
        ids = stored(joined(named.select("doc_id", "cls"), several, "doc_id").join(of_class, "cls").select("doc_id", "node"))
        first = ids.groupBy("doc_id").agg(F.min("node").alias("a"))
        edges = edges.unionByName(stored(ids.join(first, "doc_id").filter("a <> node").select("a", F.col("node").alias("b")).distinct()))
    linked = components(edges).select(F.col("id").alias("node"), "component")
    by_class = stored(of_class.join(linked, "node", "left").select("cls", F.coalesce("component", "node").alias("least")))
    out = looked_up(member.select("doc_id", "n", "cls"), "cls", by_class)
    component = F.coalesce("least", "doc_id")
    kept = F.coalesce(component == F.col("doc_id"), F.col("least").isNull())
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))
