"""What several operators need: the shared folder, tables, and byte-level text work on Arrow columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that the contracts count as white space: space and \t \n \v \f \r.
BLANKS = b" \t\n\x0b\x0c\r"
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[list(BLANKS)] = True
#: Bytes of text worked on at once, and of an Arrow batch between Spark and Python; they bound a worker's memory.
CHUNK_BYTES = 1 << 19
ARROW_BYTES = 4 << 20
#: A key with more than one in so many rows, or more than half a partition's share of them, is joined apart.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; only a local session may do without it and gets one made here."""
    context = spark.sparkContext
    set_to = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not set_to:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_to = tempfile.mkdtemp(prefix="tidemark-")
        context.setCheckpointDir(set_to)
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(set_to)
    return set_to


@contextmanager
def freeing(spark: SparkSession):
    """Steps run in here give back their shuffle files as they end: what they made stands in the shared folder."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; the plan starts anew from its files."""
    shared_dir(df.sparkSession)
    with freeing(df.sparkSession):
        return df.select("*").checkpoint()  # a new plan, made while freeing is on


def stored(df: DataFrame, **options: str) -> DataFrame:
    """Write to a Parquet table in the shared folder and read that back, so later plans can prune columns; ``options`` are the writer's."""
    path = f"{shared_dir(df.sparkSession)}/t-{uuid.uuid4().hex}"
    with freeing(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {name.rpartition("/")[0] for name in df.inputFiles()}:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow``; batches are bounded by bytes unless the session says how, as texts differ too much to be counted."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name) == f"{64 << 20}b":  # Spark's own default
        df.sparkSession.conf.set(name, str(ARROW_BYTES))
    return df.mapInArrow(run, schema)


def hot_share(spark: SparkSession) -> int:
    """A key is hot with more than one in so many rows; there are no more hot keys than this."""
    return max(HOT_SHARE, 2 * partitions(spark))


def join_by_key(rows: DataFrame, per_key: DataFrame, keys: list[str], count: str) -> DataFrame:
    """``rows`` joined with ``per_key`` (one row a key, ``count`` of them in ``rows``), without a key meeting in one task.

    Keys that hold more than one in ``hot_share`` rows, at most that many,
    are broadcast and their rows stay where they are; the others are
    shuffled.  Both frames are read twice, so they should be stored.
    """
    total = per_key.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) * hot_share(rows.sparkSession) > total
    hot = per_key.filter(is_hot)
    if hot.isEmpty():
        return rows.join(per_key.drop(count), keys)
    known = F.broadcast(hot.drop(count))
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(per_key.filter(~is_hot).drop(count), keys)
    return cold.unionByName(rows.join(known, keys))


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Texts:
    """The bytes of consecutive texts: ``buf`` (uint8), ``starts`` and ``ends`` (bytes) of each text; null counts as empty."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int):
        self.buf, self.starts, self.ends, self.first = buf, starts, ends, first

    def __len__(self) -> int:
        return len(self.starts)

    def raw(self, i: int) -> bytes:
        """The UTF-8 bytes of text ``i``."""
        return self.buf[self.starts[i] : self.ends[i]].tobytes()


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Split a string column into runs of whole texts with about ``limit`` bytes each; one longer text comes alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    starts, ends = at[:-1].copy(), at[1:].copy()
    if column.null_count:
        null = np.asarray(column.is_null())
        ends[null] = starts[null]
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        j = min(j, n)
        lo, hi = at[i], at[j]
        yield Texts(buf[lo:hi], starts[i:j] - lo, ends[i:j] - lo, i)
        i = j


def word_bounds(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words ``[^\\x20\\x09-\\x0D]+``, and for each text the number of its first word (one more entry at the end)."""
    inside = ~_IS_BLANK[t.buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:]
    own = t.starts[t.starts < t.ends]  # a text's first byte always starts a word, its last ends one
    begins[own] |= inside[own]
    last = t.ends[t.starts < t.ends] - 1
    finishes[last] |= inside[last]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(finishes) + 1
    return starts, ends, np.append(np.searchsorted(starts, t.starts), len(starts))


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Spans of up to this many bytes are hashed together, eight bytes of each at a time.
_SHORT = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)], np.uint64)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal bytes give equal hashes wherever they stand.

    Short spans are chained in words of eight bytes through ``mixed``, longer
    ones are hashed one by one with XXH3.
    """
    n = ends - starts
    words = np.ndarray(len(buf) + 1, "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))
    h = mixed(n.astype(np.uint64) * _STEP + np.uint64(0xA24BAED4963EE407))
    of = np.flatnonzero(n <= _SHORT)
    at, left = starts[of], n[of]
    while len(of):
        more = left > 0
        of, at, left = of[more], at[more], left[more]
        word = words[at]
        part = left < 8
        word[part] &= _KEEP[left[part]]
        h[of] = mixed((h[of] ^ word) + _STEP)
        at, left = at + 8, left - 8
    for i in np.flatnonzero(n > _SHORT).tolist():
        h[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]])
    return h
