"""Shared pieces: lineage cuts, skew-safe joins, vectorised word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_KEYS = 512  # a key holding over 1/HOT_KEYS of the rows is "hot"; there are fewer than HOT_KEYS of them


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it from there.

    The folder comes from ``spark.checkpoint.dir``; only where that is unset
    and Spark runs in one process (tests) a temporary one is made.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tracelake-"))
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle and checkpoint files that nothing refers to; it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the jobs run inside: rows of whole sets or texts are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def attach(left: DataFrame, right: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """Left join on ``key`` with ``right``, one row a key, whose column ``rows`` says how many left rows carry it.

    Keys with over ``total / HOT_KEYS`` left rows (fewer than HOT_KEYS keys, so
    safe to broadcast) join where the left rows lie; all others shuffle.
    """
    most = max(1, total // HOT_KEYS)
    hot = right.filter(F.col(rows) > most)
    found = hot.limit(HOT_KEYS + 1).collect()
    if not found:
        return left.join(right, key, "left")
    spark = left.sparkSession
    hot = spark.createDataFrame(found, right.schema)
    cold = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.filter(~(F.col(rows) > most)), key, "left")
    return left.join(F.broadcast(hot), key, "inner").select(*cold.columns).unionByName(cold)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, or with underscores before it, such that no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def utf8(text: Column | str) -> Column:
    return F.encode(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "UTF-8")


def held_out(doc_id: Column | str) -> Column:
    """True for the quarter of documents that no model here learns from."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")) % 4 == 2


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """All rows, or about ``most`` of them chosen by a hash of ``key``: what a model is fitted on."""
    n = rows.count()
    return rows if n <= most else rows.filter(F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(1 << 20)) < F.lit(most * (1 << 20) // n)).limit(2 * most)


# ---------------------------------------------------------------- word hashing

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BLOCK = 1 << 20  # bytes hashed at once; a longer text goes through in parts cut at white space

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_CODE = np.random.default_rng(20240613).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_tables: dict[str, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _tables.get(str(base))
    if have is None or len(have) < n:
        x = np.full(max(n, BLOCK + 4096), base, np.uint64)
        x[0] = 1
        have = _tables[str(base)] = np.multiply.accumulate(x)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Separators of tokens of letters and digits: every ASCII byte that is neither.
SIGNS = np.ones(256, bool)
SIGNS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _block_words(data: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    word = np.empty(len(data) + 2, bool)
    word[0] = word[-1] = False
    np.logical_not(separator[data], out=word[1:-1])
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[0::2], edge[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODE[data] * powers(BASE, len(data))[: len(data)], out=total[1:])
    h = (total[end] - total[start]) * powers(INVERSE, len(data) + 1)[start]
    return mix(h + (end - start).astype(np.uint64)), start, end


def words(text: bytes | str | None, lower: bool = True, separator: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, first byte and end byte of each run of bytes that aren't separators (by default, ASCII white space); A-Z count as a-z.

    Any length of text: BLOCK bytes are worked on at a time.
    """
    data = np.frombuffer((text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text) or b"", np.uint8)
    if lower:
        data = _LOWER[data]
    if len(data) <= BLOCK:
        return _block_words(data, separator)
    parts, at = [], 0
    while at < len(data):
        stop = min(at + BLOCK, len(data))
        if stop < len(data):
            gap = np.flatnonzero(separator[data[at:stop]])
            while not len(gap) and stop < len(data):  # one word longer than a block
                begin, stop = stop, min(stop + BLOCK, len(data))
                gap = np.flatnonzero(separator[data[begin:stop]]) + (begin - at)
            stop = at + int(gap[-1]) + 1 if len(gap) else stop
        h, s, e = _block_words(data[at:stop], separator)
        parts.append((h, s + at, e + at))
        at = stop
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word shingles in order; of fewer words, one for the whole sequence; none without words."""
    if not len(h):
        return h
    k = min(n, len(h))
    x = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        x = x * np.uint64(0xD6E8FEB86659FD93) + h[j : len(h) - k + 1 + j]
    return mix(x + np.uint64(k))


CACHES: dict[str, dict] = {}  # what a worker keeps from task to task, by the operator it serves


def give_back(but: str = "") -> None:
    """Return memory to the system: Python workers are used again and again, and would keep the most that any task took.

    Caches of operators other than ``but`` go, too.
    """
    import pyarrow as pa

    for k, v in CACHES.items():
        if k != but:
            v.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def rows_of(batches: Iterator, *columns: str) -> Iterator[tuple]:
    """Python values of the columns, row by row, of Arrow batches."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)
    give_back()


def _forest(batches: Iterator) -> Iterator:
    """Union-find over one partition's edges: the same components as stars (a, least id)."""
    import pyarrow as pa

    up: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while up.get(root, root) != root:
            root = up[root]
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    for a, b in rows_of(batches, "a", "b"):
        x, y = find(a), find(b)
        if x != y:
            up[max(x, y)] = min(x, y)
    own = list(up)
    yield pa.record_batch({"a": pa.array(own, pa.int64()), "b": pa.array([find(x) for x in own], pa.int64())})


EDGES_A_PART = 100_000  # edges worked on in one task, about


def min_label(edges: DataFrame, local: bool = True, rounds: int = 80) -> DataFrame:
    """Smallest id reachable: (id, component) for each id with a smaller one in its component.

    Alternating large-star and small-star steps (Kiveris et al., SoCC 2014):
    each keeps the components and at most as many edges, until the edges are
    stars round their smallest id. A hub's edges meet its minimum through
    partial sums and the skew-safe join, never in one task. ``local`` first
    contracts each partition by union-find, which spares rounds; without it
    only DataFrame operations run.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    for turn in range(rounds):
        if turn % 4 == 3:
            release(edges.sparkSession)
        e = cut(e)
        parts = -(-e.count() // EDGES_A_PART)
        if parts < e.rdd.getNumPartitions():
            e = e.coalesce(max(1, parts))
        if local:
            e = cut(e.mapInArrow(_forest, "a long, b long").filter("a <> b"))
        total, ids = e.agg(F.count("*"), F.countDistinct("a")).first()
        if total == ids and (local and parts <= 1 or not e.select(F.col("b").alias("a")).distinct().join(e, "a", "left_semi").limit(1).count()):
            return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
        star = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(star.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("_n")))
        large = attach(star, low, "a", "_n", 2 * total).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(large.filter("a <> b").distinct())
        low = cut(e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n")))
        joined = attach(e, low, "a", "_n", e.count())
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        e = small.filter("a <> b").distinct()
    raise RuntimeError(f"components did not settle in {rounds} rounds")
