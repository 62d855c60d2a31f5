"""What several operators share: scratch tables, Arrow text blocks, words and shingles as numpy arrays.

A *block* is a run of rows of one Arrow text column with about a quarter megabyte of
text; every kernel works on one block, so a task's memory follows the block
(or its longest single text), never the partition.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 18
#: Bytes of an Arrow batch between Spark and its Python workers, unless the session names its own.
ARROW_BYTES = 4 << 20
SHINGLE_WORDS = 5

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1 << 62, dtype=np.uint64, size=256) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1 << 62, dtype=np.uint64, size=16) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def scratch(spark: SparkSession) -> str:
    """The shared folder the cluster names; where none is set, a folder of our own in local mode (as in tests), else an error."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="factweave-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/factweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(column: str, modulus: int) -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column, over all rows."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0])


def parts_for(total: int, each: int, least: int = 1) -> int:
    return max(least, -(-total // each))


def give_back() -> None:
    """Return freed memory to the system: Spark keeps Python workers between tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """``mapInArrow`` in batches of a few megabytes, so that neither side of a task holds many long rows at once."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, ddl)


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets into them); a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
    give_back()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words [^\\x20\\x09-\\x0D]+ of each row, and each row's first word."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    start = ~space
    end = start.copy()
    inside = start.copy()
    start[1:] &= space[:-1]
    end[:-1] &= space[1:]
    first = offsets[:-1][offsets[:-1] < len(data)]
    last = offsets[1:][offsets[1:] > 0] - 1
    start[first] = inside[first]
    end[last] = inside[last]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit words in place (the finaliser of a counter-based generator)."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        _POWERS[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0], _POWERS[1]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z in lower case; a long text is hashed by runs of words."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(data) > 2 * BLOCK_BYTES and len(starts) > 1:
        out = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK_BYTES, side="right")))
            at = int(starts[i])
            out[i:j] = word_hashes(data[at : int(ends[j - 1])], starts[i:j] - at, ends[i:j] - at)
            i = j
        return out
    up, down = _powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[_LOWER[data]] * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h += (ends - starts).astype(np.uint64) * _PLACE[15]
    return mix(h)


def shingles(h: np.ndarray, first: np.ndarray, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each row and each row's first; fewer words make one shingle."""
    counts = np.diff(first)
    n_out = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    out_first = np.concatenate([[0], np.cumsum(n_out)])
    out = np.zeros(out_first[-1], np.uint64)
    full = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    for j in range(k):
        full += h[j : j + len(full)] * _PLACE[j]
    keep = np.zeros(len(full) + 1, np.int32)
    long_rows = np.flatnonzero(counts >= k)
    np.add.at(keep, first[:-1][long_rows], 1)
    np.add.at(keep, first[1:][long_rows] - k + 1, -1)
    picked = full[np.cumsum(keep[:-1]) > 0] if len(full) else full
    if len(long_rows) == len(counts):
        out[:] = picked
    else:
        from_long = np.repeat(counts >= k, n_out)
        out[from_long] = picked
        for r in np.flatnonzero((counts > 0) & (counts < k)):
            n = int(counts[r])
            # Sums wrap in arrays without a warning, unlike those of single numbers.
            out[out_first[r] : out_first[r] + 1] = np.full(1, n, np.uint64) * _PLACE[14] + (h[first[r] : first[r] + n] * _PLACE[:n]).sum(dtype=np.uint64)
    return mix(out), out_first


def small(df: DataFrame, rows: int, limit: int = 500_000) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are few; beyond ``limit`` Spark shuffles instead."""
    return F.broadcast(df) if rows <= limit else df


#: A key is hot if it has more than one in so many of all rows, so there are always fewer hot keys than this.
HOT_KEYS = 1000


def join_unique(rows: DataFrame, facts: DataFrame, keys: list[str], counts: DataFrame, limit: int = 64 << 20, size: str | None = None) -> DataFrame:
    """``rows`` (a stored table) joined with ``facts``, in which a key stands once; ``counts`` has keys and ``n``, their rows at most.

    Facts of hot keys are fewer than ``HOT_KEYS`` and are broadcast, so that rows of a hot key stay where they are
    instead of meeting in one task. If facts vary in size, ``size`` names a binary column whose bytes are added up
    first; beyond ``limit`` all keys meet by a shuffle.
    """
    edge = max(HOT_KEYS, rows.count() // HOT_KEYS)
    names = F.broadcast(counts.where(F.col("n") > edge).select(*keys))
    hot = facts.join(names, keys)
    found, held = hot.agg(F.count("*"), F.coalesce(F.sum(F.length(size)) if size else F.lit(0), F.lit(0))).first()
    if not found or held > limit:
        return rows.join(facts, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(names, keys, "left_anti").join(facts, keys))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of (a, b), root the smallest node it is connected with.

    Large-star and small-star steps by turns: each is a grouping that combines before it
    shuffles and a join, so a node with very many links is no hot group.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    now, seen = stash(pairs, "links"), None
    while True:
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if seen == tuple(state):
            break
        seen = tuple(state)
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select("u", "m"))
        now = stash(star.where("a != b").distinct(), "links")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(now.select("b", "b").distinct())
