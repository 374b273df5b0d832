"""Helpers the operators share: intermediate tables, checked broadcasts, text hashing."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes a side may hold (estimated from its own rows) to be broadcast.
BROADCAST_LIMIT = 16 << 20

#: The white space that the operators' contracts name.
WS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a local master gets a temporary one; a cluster fails."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessel-")
        spark.sparkContext.setCheckpointDir(path)
    return path


#: Tables that materialize() wrote in this process.
_WRITTEN: list[str] = []


def tables_written() -> int:
    """How many intermediate tables of this process stand."""
    return len(_WRITTEN)


def drop_tables(spark: SparkSession, first: int = 0, last: int | None = None) -> None:
    """Delete the intermediate tables number first to last - 1 (all without numbers), once no result that reads them is needed."""
    jvm = spark.sparkContext._jvm
    gone = _WRITTEN[first:last]
    del _WRITTEN[first:last]
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, tag: str, light: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and reread it: cuts lineage, survives lost executors.

    light: what is left to do is cheap, so shuffled partitions are merged to the advisory
    size, not to one a core at least; small tables then have few files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with arrow_batches(spark), setting(spark, "spark.sql.adaptive.coalescePartitions.parallelismFirst", str(not light).lower()):
        df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, row_bytes: Column | int, limit: int = BROADCAST_LIMIT) -> bool:
    """Whether the rows of df, at row_bytes each, fit the broadcast limit."""
    size = df.agg(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)).alias("b")).head()["b"]
    return (size or 0) <= limit


def broadcast_if_small(df: DataFrame, row_bytes: Column | int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """df with a broadcast hint if its measured size allows it, else df for a shuffled join."""
    return F.broadcast(df) if small_enough(df, row_bytes, limit) else df


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A setting of the session for the jobs run inside."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def arrow_batches(spark: SparkSession, max_bytes: int = 2 << 20):
    """Bound the Arrow batches of jobs run inside, so texts gather neither in a Python worker nor in the buffers that feed it."""
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(max_bytes))


#: Caches that operators keep in a Python worker from task to task.
_CACHES: list[dict] = []


def worker_cache(cache: dict) -> dict:
    """Register a cache, so tasks of other operators can free it."""
    _CACHES.append(cache)
    return cache


def free_caches(keep: dict | None = None) -> None:
    """Empty the caches of earlier tasks in this worker, but for `keep`, and give unused memory back."""
    for cache in _CACHES:
        if cache is not keep:
            cache.clear()
    give_back()


def give_back() -> None:
    """Give this worker's unused memory back."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- vectorised hashing of word shingles (NumPy, used inside Arrow batches) ---

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _POWERS[name] = have = np.multiply.accumulate(have)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


#: Words hashed at a time, and bytes from which a word stands in by its digest.
_PART, _LONG_WORD = 1 << 15, 1 << 12


def shingle_hashes(text: str | None, size: int = 5) -> np.ndarray:
    """Hashes of the text's word shingles in text order (repeats included).

    Words are split at ASCII white space and lower-cased over A-Z. A text with fewer
    than `size` words gives one shingle of all its words; none gives an empty array. Long
    texts are hashed in parts that overlap by size - 1 words.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(text) > _LONG_WORD:
        words = [w if len(w) < _LONG_WORD else b"\0" + hashlib.blake2b(w).digest() for w in words]
    size = min(size, len(words))
    return np.concatenate([_hash_runs(words[i : i + _PART + size - 1], size) for i in range(0, len(words) - size + 1, _PART)])


def _hash_runs(words: list[bytes], size: int) -> np.ndarray:
    return _hash_sizes(words, [size])[0]


def _hash_sizes(words: list[bytes], sizes: Sequence[int]) -> list[np.ndarray]:
    """Hashes of the words' runs, by the size of the runs; the words' bytes are summed once."""
    flat = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * _powers("up", _BASE, len(flat)), out=sums[1:])
    before, after, down = sums[starts], sums[ends], _powers("down", _INV, len(flat))[starts]
    return [mix64((after[k - 1 :] - before[: len(words) - k + 1]) * down[: len(words) - k + 1]) for k in sizes]


def shingles_of_words(words: list[bytes], sizes: Sequence[int]) -> list[np.ndarray]:
    """`shingle_hashes` of lower-cased words in each of the sizes."""
    if len(words) > _PART or max(map(len, words), default=0) >= _LONG_WORD:
        text = b" ".join(words).decode("utf-8", "surrogatepass")
        return [shingle_hashes(text, k) for k in sizes]
    return _hash_sizes(words, [min(k, len(words)) for k in sizes]) if words else [np.empty(0, np.uint64) for _ in sizes]


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(text, size))


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b| over sorted distinct hashes; empty sets never match."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
