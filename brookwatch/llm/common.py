"""Helpers shared by the training-data operators.

Operators select what they need first, or name their own columns with free_name(), so extra columns, whatever
their names, neither clash nor reach a shuffle that has no need of them.  A null text counts as empty everywhere.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only on a local master where none is set."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="brookwatch-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def stored(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes df as Parquet in the shared folder and reads it again, so its size is known anew."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


checkpoint = stored


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of df has it, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fold_of(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, by the modulus; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def fold(doc_id, modulus: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _table(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


SPACES = _table(b" \t\n\x0b\x0c\r")
_LETTERS = b"abcdefghijklmnopqrstuvwxyz"
#: Bytes that are no part of a word: ASCII without [a-z0-9_], and without [a-z].
NO_WORD, NO_LETTER = (~_table(_LETTERS + more + bytes(range(128, 256))) for more in (b"0123456789_", b""))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The first powers of base, at least n + 1; the longest text's are kept."""
    out = _POWERS.get(int(base))
    if out is None or len(out) <= n:
        out = np.full(max(n + 1, 1 << 16), base, np.uint64)
        out[0] = 1
        out = _POWERS[int(base)] = np.multiply.accumulate(out)
    return out


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end] for each pair, from one pass over the values."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers(_BASE, n)[:n], out=total[1:])
    return mix64((total[end] - total[start]) * _powers(_INVERSE, n)[start])


def split(b: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not in the table apart."""
    out = np.concatenate([[True], apart[b], [True]])
    return np.flatnonzero(out[:-1] & ~out[1:]), np.flatnonzero(~out[:-1] & out[1:])


def byte_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return range_hashes(_CODE[b], start, end)


def space_words(text: str | None) -> np.ndarray:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ with A-Z in lower case (bytes.lower() is limited to ASCII)."""
    b = np.frombuffer(text.encode().lower() if text else b"", np.uint8)
    return byte_hashes(b, *split(b, SPACES))


def letter_runs(text: str | None, digits: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the text in lower case, and starts and ends of its words \\w+, or without digits and the underscore [^\\W\\d_]+."""
    low = (text or "").lower()
    if not low.isascii():
        odd = {ord(c): " " for c in set(low) if ord(c) > 127 and not (c.isalnum() and (digits or not c.isdecimal()))}
        low = low.translate(odd) if odd else low
    b = np.frombuffer(low.encode(), np.uint8)
    return b, *split(b, NO_WORD if digits else NO_LETTER)


def letter_words(text: str | None, digits: bool) -> np.ndarray:
    """64-bit hashes of the words of letter_runs."""
    return byte_hashes(*letter_runs(text, digits))


def words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z in lower case.  bytes.lower() and bytes.split() are limited to ASCII."""
    return text.encode().lower().split() if text else []


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of words given by their hashes; fewer words make one shingle."""
    if not len(h):
        return np.zeros(0, np.uint64)
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


#: Rows and bytes of a batch on its way to Python.  Both sides hold one a task, and Spark's 10,000 rows of texts or sets are some 100 MB.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1024, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def _lower_batches(spark: SparkSession) -> None:
    """Spark reads these settings when a map runs, so they stay for the session; smaller ones that are set are left alone."""
    for name, most in BATCH.items():
        now = spark.conf.get(name, None)
        now = int(now) if now is not None and re.fullmatch(r"-?[0-9]+", now) else 0
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


def _give_back() -> None:
    """Freed memory goes back to the system, so a worker waits for its next task with little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; others have none
    if trim is not None:
        trim(0)


def arrow_map(df: DataFrame, rows, schema: str, slice_rows: int = 512) -> DataFrame:
    """mapInArrow in slices; rows(dict of Python lists) returns a dict of columns (or None for no rows)."""
    from pyspark.sql.types import _parse_datatype_string  # parsed on the driver
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                out = rows(batch.slice(at, slice_rows).to_pydict())
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        _give_back()

    _lower_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


#: Rows of a table that may be broadcast: some 20 MB of keys and small values.
FEW = 200_000


def joined(df: DataFrame, table: DataFrame, on, how: str = "inner") -> DataFrame:
    """df joined with a stored table, which is broadcast if it has FEW rows, so df is not dealt by its hot keys; else
    both are shuffled, and adaptive execution splits skewed partitions."""
    return df.join(F.broadcast(table) if table.count() <= FEW else table, on, how)


def looked_up(df: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """df left-joined with a stored table of unique keys; rows that surely find none are not shuffled."""
    if table.count() <= FEW:
        return df.join(F.broadcast(table), column, "left")
    flag = free_name(df, "flag")
    marked = flagged(df, column, table.select(column), flag)
    found = marked.filter(flag).drop(flag).join(table, column, "left")
    more = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name != column]
    return found.unionByName(marked.filter(~F.col(flag)).drop(flag).select("*", *more))


def text_key(column: str = "text") -> Column:
    """A key of a whole text; what depends on the text alone is worked out once for all its copies."""
    return F.unhex(F.md5(text_of(column).cast("binary")))


BLOCK = 1 << 15  # bits of one bitmap of bitmap_construct_agg


def _bits_for(keys: DataFrame, least_bits: int, most_bits: int) -> int:
    """A power of two of 32 bits a key or more, but never below least_bits nor above most_bits."""
    bits, n = least_bits, keys.count()
    while bits < min(most_bits, 32 * n):
        bits *= 2
    return bits


def _bitmaps(slots: DataFrame) -> DataFrame:
    """(bucket, bitmap) of the column slot, numbers from 1."""
    return slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap"))


def bit_filter(hashes: DataFrame, least_bits: int = 1 << 25, most_bits: int = 1 << 28) -> np.ndarray:
    """Packed bits set at hash % bits for the stored long column h: sized by the count of hashes, 4 MB at least and 32 MB at most."""
    bits = _bits_for(hashes, least_bits, most_bits)
    packed = np.zeros((bits // BLOCK, BLOCK // 8), np.uint8)
    for row in _bitmaps(hashes.select((F.pmod("h", F.lit(bits)) + 1).alias("slot"))).toLocalIterator():
        packed[row["bucket"] - 1] = np.frombuffer(bytes(row["bitmap"]), np.uint8)
    return packed.ravel()


def in_filter(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = np.mod(hashes.view(np.int64), np.int64(len(packed) * 8))
    return (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def flagged(df: DataFrame, column: str, keys: DataFrame, flag: str, least_bits: int = 1 << 22, most_bits: int = 1 << 30) -> DataFrame:
    """Adds a boolean: false where the column is surely not in keys (one stored column of that name), true else.

    A bitmap of the keys' hashes, sized by their count and never above most_bits (128 MB), is broadcast.
    """
    bits = _bits_for(keys, least_bits, most_bits)
    slot, bucket, bitmap = (free_name(df, c) for c in ("slot", "bucket", "bitmap"))

    def at(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(bits)) + 1

    blocks = stored(_bitmaps(keys.select(at(column).alias("slot")))).select(F.col("bucket").alias(bucket), F.col("bitmap").alias(bitmap))
    position = F.bitmap_bit_position(slot)
    octet = F.conv(F.hex(F.substring(F.col(bitmap), F.shiftright(position, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    rows = df.withColumn(slot, at(column)).withColumn(bucket, F.bitmap_bucket_number(slot)).join(F.broadcast(blocks), bucket, "left")
    hit = F.coalesce(F.getbit(octet, F.pmod(position, F.lit(8)).cast("int")) == 1, F.lit(False))
    return rows.select(*df.columns, hit.alias(flag))


def narrowed(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows of df whose column is in keys (a stored table with that column): only they and a few others are shuffled."""
    flag = free_name(df, "flag")
    keys = keys.select(column)
    return flagged(df, column, keys, flag).filter(flag).drop(flag).join(keys, column, "left_semi")


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ends of the edges and for each the smallest end that it reaches; rounds as in components()."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while len(a):
        to = np.arange(len(ids))
        np.minimum.at(to, a, b)
        np.minimum.at(to, b, a)
        while not np.array_equal(to, to[to]):
            to = to[to]
        label, a, b = to[label], to[a], to[b]
        a, b = a[a != b], b[a != b]
    return ids, ids[label]


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of the edges (a, b), best stored ones: the smallest id that it reaches.

    Up to FEW edges, 3 MB, are worked out on the driver, which takes no stages; more by the same rounds over tables.
    Each round points every node at its least neighbour, follows the pointers to their roots by doubling, and
    contracts the edges to edges between roots.  No two roots are neighbours, so a round leaves at most half of the
    nodes: logarithmically many rounds, each with logarithmically many doublings, whatever the graph's diameter.
    Every step is a written table, so sizes are known anew and lost executors cost one step.
    """

    def clean(a: Column, b: Column, of: DataFrame) -> DataFrame:
        return stored(of.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct())

    ends = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    if ends.count() <= FEW:
        near = ends.toArrow()
        ids, least = least_reached(*(near[c].to_numpy() for c in ("a", "b")))
        return stored(ends.sparkSession.createDataFrame(pa.table({"id": pa.array(ids, pa.int64()), "component": pa.array(least, pa.int64())})))
    nodes = stored(ends.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    labels = nodes.select("id", F.col("id").alias("component"))
    edge, held = clean(F.col("a"), F.col("b"), ends), nodes
    while not edge.isEmpty():
        both = edge.unionByName(edge.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tree = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("to")))
        while True:
            step = tree.select(F.col("id").alias("to"), F.col("to").alias("next"))
            new = stored(tree.join(step, "to").select("id", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
            dropped(tree)
            tree = new
            if tree.filter("moved").isEmpty():
                break
        roots = [tree.select(F.col("id").alias(c), F.col("to").alias(f"r_{c}")) for c in ("a", "b")]
        shorter = clean(F.col("r_a"), F.col("r_b"), edge.join(roots[0], "a").join(roots[1], "b"))
        follow = tree.select(F.col("id").alias("component"), F.col("to").alias("root"))
        named = stored(labels.join(follow, "component", "left").select("id", F.coalesce("root", "component").alias("component")))
        dropped(edge, tree, held)
        edge, labels, held = shorter, named, named
    return labels
