"""What the training-data operators share: shared-folder tables, word scanning, components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: An odd base for the rolling word hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 20


# --- memory of Python workers ---------------------------------------------------------------

try:  # glibc: arrays of up to 32 MB are reused within a batch, and tidy() gives them back
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.mallopt(-3, 32 << 20)
    _LIBC.mallopt(-1, 512 << 20)
except (OSError, AttributeError):  # another C library
    _LIBC = None


def tidy() -> None:
    """Give freed memory back to the system. Workers outlive their tasks, and an executor's
    limit counts what they hold."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


# --- tables in the shared folder -------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset (tests), a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = getattr(spark, "_ranksmith_scratch", None)
        if not at:
            at = tempfile.mkdtemp(prefix="ranksmith-")
            spark._ranksmith_scratch = at
    return at.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone, and with it the means to reach the store
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once in the shared folder and read it back: it cuts the lineage, and a lost
    executor costs no recomputation. The table goes when the driver process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ranksmith-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ranksmith_path = path
    _MADE.append(path)
    return out


_MADE: list[str] = []


def release(spark: SparkSession, since: int, *but: DataFrame) -> None:
    """Delete the tables made since len(_MADE) was `since`, but for those of `but`. What has not
    been run yet must not need them. The plans, broadcasts and shuffle files that made them go
    too: Spark keeps these until the driver collects its garbage, which it puts off until its
    heap is full."""
    keep = [df._ranksmith_path for df in but]
    for path in _MADE[since:]:
        if path not in keep:
            _delete(spark, path)
    _MADE[since:] = keep
    gc.collect()  # Python's DataFrames hold plans in the JVM
    spark.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of 2,048 rows at most, unless the session has its own setting: with texts
    of a few kilobytes the default of 10,000 rows is tens of megabytes in each process."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A class with over one row in HOT is joined apart: there are fewer than HOT such classes.
HOT = 1024


def classed(rows: DataFrame, classes: DataFrame, key: str, name: str) -> DataFrame:
    """rows joined with classes (key, n: its number of rows, ...) on key.

    A class may hold a third of all rows. Those with over 1 in HOT of them number fewer than
    HOT, so they are broadcast, and their rows stay where they are; all other classes, none of
    which can fill a task, are joined by a shuffle.
    """
    classes = materialize(classes, name)
    most = (classes.agg(F.sum("n")).first()[0] or 0) / HOT
    named = classes.withColumnRenamed(key, "_key")
    hot, cold = (named.where(c).drop("n") for c in (F.col("n") > most, F.col("n") <= most))
    on, hot = F.col(key) == F.col("_key"), F.broadcast(hot)
    return rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(cold, on)).drop("_key")


# --- words, vectorised -----------------------------------------------------------------------


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of the key depends on every bit of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its offsets (rows + 1, from 0). A null is empty."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_binary())
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES):
    """Row ranges [a, b) of about `size` bytes; one longer row makes a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        m = max(n, CHUNK_BYTES + 1)
        both = []
        for b in (_BASE, _BASE_INV):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words `[^\\x20\\x09-\\x0D]+` of each row, in order, and
    the number of words of each row. All by whole-array operations: prefix sums of a
    polynomial give any word's hash by one subtraction."""
    hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for a, b in chunks(offsets):
        raw, off = buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        n = len(raw)
        if not n:
            continue
        word = ~_SPACE[raw]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        inner = off[(off > 0) & (off < n)]
        before[inner], after[inner - 1] = False, False
        starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after)
        p, inv = _powers(n)
        sums = np.cumsum(p[:n] * (_LOWER[raw].astype(np.uint64) + np.uint64(1)))
        first = np.where(starts > 0, sums[starts - 1], np.uint64(0))
        h = (sums[ends] - first) * inv[starts]
        hashes.append(mix64(h + (ends - starts).astype(np.uint64) * np.uint64(_BASE)))
        at = np.searchsorted(starts, off)
        counts[a:b] = np.diff(at)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


# --- connected components --------------------------------------------------------------------


def local_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (u, v) and the smallest node of each one's component."""
    nodes, idx = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = idx[: len(u)], idx[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        ra, rb = root[a], root[b]
        go = ra != rb
        a, b, ra, rb = a[go], b[go], ra[go], rb[go]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return nodes, nodes[root]


def _pairs_of(batches):
    """The columns u and v of batches, joined to about _HELD rows."""
    held, n = [], 0
    for b in batches:
        held.append([b.column(c).to_numpy(zero_copy_only=False).copy() for c in range(2)])
        n += b.num_rows
        if n >= _HELD:
            yield [np.concatenate(x) for x in zip(*held)]
            held, n = [], 0
    if n:
        yield [np.concatenate(x) for x in zip(*held)]


def _thinned(batches):
    """Batches (u, v), u above v, that link the same nodes: a forest of each _HELD edges."""
    for u, v in _pairs_of(batches):
        node, root = local_roots(u, v)
        up = node != root
        yield pa.RecordBatch.from_arrays([pa.array(node[up]), pa.array(root[up])], names=["u", "v"])
    tidy()


def _rooted_all(batches):
    """(node, root) of all nodes of the edges (u, v) of batches, which number EDGES at most."""
    every = list(_pairs_of(batches))
    if every:
        node, root = local_roots(*(np.concatenate(x) for x in zip(*every)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])
    tidy()


def components(edges: DataFrame, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of edges (u, v): root is the smallest node reachable.

    Every partition of edges is thinned to a forest first. What is left, if at most EDGES edges,
    is one task's work and three jobs: each job leaves its plans and metrics in the driver.
    More edges take alternating large-star and small-star rounds: an edge table is rewritten until
    it is a set of stars, in a number of rounds that grows with the logarithm of the longest path.
    Every round is one table in the shared folder; to the driver come two numbers and the hubs, nodes
    with over 1 in HOT of the edges, which are joined apart.
    """
    spark = edges.sparkSession
    since = len(_MADE)
    ends = [F.col(c).cast("long").alias(c) for c in ("u", "v")]
    cur = materialize(edges.select(*ends).where("u != v").mapInArrow(_thinned, "u bigint, v bigint"), name)
    n, seen = cur.count(), None
    if n <= EDGES:
        roots = materialize(cur.coalesce(1).mapInArrow(_rooted_all, "node bigint, root bigint"), name)
        release(spark, since, roots)
        return roots
    for _ in range(max_rounds):
        few = lambda df: df.coalesce(max(1, -(-n // EDGES)))  # noqa: E731, B023
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hot = _hubs(both, n)
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = few(_with_least(both, low, hot)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            _with_least(large, low, hot)
            .where("v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u != v")
            .distinct()
        )
        cur = materialize(few(small), name)
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        n = now[0]
        release(spark, since, cur)
        if now == seen or n == 0:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


#: Edges of one task of components: with few edges there are few tasks.
EDGES = 1 << 18
#: Edges that a task holds while it thins them.
_HELD = 1 << 20
#: A node with fewer edges than this is no hub, however few edges there are.
LEAST_HUB = 256


def _hubs(both: DataFrame, n: int) -> DataFrame | None:
    """Nodes (u) that end over 1 in HOT of the n edges, for a broadcast: at most 2 * HOT of
    them. None where there are none."""
    ends = both.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") > max(n / HOT, LEAST_HUB))
    found = [(r["u"],) for r in ends.select("u").collect()]
    return F.broadcast(both.sparkSession.createDataFrame(found, "u bigint")) if found else None


def _with_least(rows: DataFrame, low: DataFrame, hot: DataFrame | None) -> DataFrame:
    """rows (u, v) with m of low (u, m). Rows of hubs stay where they are; all others are joined
    by a shuffle. A node has as many rows in either half of a round as it ends edges, at most."""
    if hot is None:
        return rows.join(low, "u")
    few = F.broadcast(low.join(hot, "u", "left_semi"))
    return rows.join(few, "u").unionByName(rows.join(hot, "u", "left_anti").join(low, "u"))


def named_roots(members: DataFrame, roots: DataFrame, least: str, name: str) -> DataFrame:
    """(node, low) of the nodes that roots (node, root) holds: low is the least `least` among
    members (node, least) of the same root. A root may hold a third of all nodes."""
    held = materialize(members.join(roots, "node"), f"{name}-members")
    low = held.groupBy("root").agg(F.min(least).alias("low"), F.count("*").alias("n"))
    return classed(held, low, "root", name).select("node", "low")
