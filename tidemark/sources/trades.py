"""Trade messages of the two exchanges: parsers, readers, streams."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import vector as V
from tidemark.sources import feed
from tidemark.sources.schemas import DEPTH_SCHEMA, ORDER_SCHEMA

#: Which comma-separated field holds what, the suffix of ids, and the marks of records to keep or drop.
LAYOUT = {
    "SZ": {"bid_seq": 3, "offer_seq": 4, "security": 5, "price": 7, "volume": 8, "mark": 9, "time": 10, "suffix": ".XSHE"},
    "SH": {"security": 3, "time": 4, "price": 5, "volume": 6, "bid_seq": 8, "offer_seq": 9, "mark": 10, "suffix": ".XSHG"},
}
FILL, NOT_A_TRADE = 70, "N"


def _parsed(lines: DataFrame, exchange: str, day: Column, seq: Column) -> DataFrame:
    at = LAYOUT[exchange]
    f = F.split("value", ",")
    field = lambda name: F.get(f, at[name])
    keep = field("mark").try_cast("int") == FILL if exchange == "SZ" else ~field("mark").eqNullSafe(NOT_A_TRADE)
    number = lambda name, kind: F.coalesce(F.trim(field(name)).try_cast(kind), F.lit(0).cast(kind))
    return (
        lines.withColumn("seq", seq)
        .filter(keep & (F.size(f) > at["mark"]))
        .withColumn("at", V.at_time(day, field("time")))
        .select(
            V.suffixed(field("security"), at["suffix"]).alias("security"),
            F.lit(exchange).alias("exchange"),
            F.col("at").alias("trad_time"),
            number("price", "double").alias("price"),
            number("volume", "double").alias("volume"),
            number("bid_seq", "bigint").alias("bid_seq"),
            number("offer_seq", "bigint").alias("offer_seq"),
            V.side_of(number("bid_seq", "bigint"), number("offer_seq", "bigint")).alias("side"),
            "seq",
            *(c for c in ("source",) if c in lines.columns),
        )
    )


def parse_sz(lines: DataFrame, day: Column, seq: Column | None = None) -> DataFrame:
    """``lines`` (value) of the SZ exchange to trades; only fills are kept.  ``seq`` numbers the lines in order of arrival; by default partition by partition."""
    return _parsed(lines, "SZ", day, F.monotonically_increasing_id() if seq is None else seq)


def parse_sh(lines: DataFrame, day: Column, seq: Column | None = None) -> DataFrame:
    """``lines`` (value) of the SH exchange to trades; records marked N are dropped."""
    return _parsed(lines, "SH", day, F.monotonically_increasing_id() if seq is None else seq)


PARSERS: dict[str, Callable[..., DataFrame]] = {"SZ": parse_sz, "SH": parse_sh}

#: Bits of the file and of the place in it in an arrival number: half a million files of up to 16 TB each.
FILE_BITS, PLACE_BITS = 19, 44
_ROW_BITS = 33  # what monotonically_increasing_id leaves for a partition's rows


_AT = ("file_block_start", "file_block_length", "file_size")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, seq) of text files: files in the order of their names, lines as they stand in them.

    A line's place in its file is its split's first byte plus the rows read
    before, never more than its own offset, as a line has a byte at least.  A
    split that isn't its file's last one is as long as splits get, so it has a
    partition to itself; where a session packs several into one, that is an
    error.
    """
    lines = spark.read.text(path)
    files = sorted(lines.inputFiles())
    if len(files) >= 1 << FILE_BITS:
        raise ValueError(f"{len(files)} files; read fewer at once")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_row")
    lines = lines.select("value", *(F.col(f"_metadata.{c}").alias(f"_{c}") for c in _AT), F.input_file_name().alias("_file"), row)
    sound = (F.col("_file_block_start") + F.col("_file_block_length") >= F.col("_file_size")) | (F.col("_row") <= F.col("_file_block_length"))
    place = F.when(sound, _place(F.col("_row"))).otherwise(F.raise_error(F.lit("several splits of a file in one partition: unset spark.sql.files.maxPartitionNum")).cast("long"))
    numbers = spark.createDataFrame(list(zip(files, range(len(files)), strict=True)), "_file string, _no long")
    # at most 2**19 names; left, so that a name written otherwise is an error and not a loss
    lines = lines.withColumn("_place", place).join(F.broadcast(numbers), "_file", "left")
    return lines.select("value", V.packed((F.coalesce("_no", F.lit(-1)), FILE_BITS), ("_place", PLACE_BITS)).alias("seq"))


def _place(row):
    # the first split also reads the line that starts at its end
    return F.col("_file_block_start") + row + (F.col("_file_block_start") > 0).cast("long")


def read_trades(spark: SparkSession, paths: dict[str, str], day: str) -> DataFrame:
    """Trades of text files, one path for each exchange; ``seq`` is their order in the files."""
    out = None
    for exchange, path in paths.items():
        part = PARSERS[exchange](read_lines(spark, path), F.lit(day).cast("date"), F.col("seq"))
        out = part if out is None else out.unionByName(part)
    return out


#: What a micro-batch takes at most, by source, unless the options say otherwise: a burst waits at the source.
LIMITS = {"text": {"maxFilesPerTrigger": "1000"}, "kafka": {"maxOffsetsPerTrigger": "10000000"}}


def _counted(batches):
    """Adds ``_row``: the rows that the task has read before from the same file and split."""
    read: dict = {}
    for batch in batches:
        n = batch.num_rows
        where = list(zip(batch.column("_file_path").to_pylist(), batch.column("_file_block_start").to_pylist(), strict=True))
        row = np.zeros(n, np.int64)
        lo = 0
        for hi in range(1, n + 1):
            if hi == n or where[hi] != where[lo]:
                before = read.get(where[lo], 0)
                row[lo:hi] = np.arange(before, before + hi - lo)
                read[where[lo]] = before + hi - lo
                lo = hi
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(row)], names=[*batch.schema.names, "_row"])


def _sourced(lines: DataFrame, kind: str) -> DataFrame:
    """(value, source, seq) of streamed lines: where each comes from, names in order of arrival, and its number there."""
    value = F.col("value").cast("string").alias("value")
    if kind == "kafka":  # a security's messages should share a partition
        return lines.select(value, F.concat_ws(" ", "topic", F.lpad(F.col("partition").cast("string"), 6, "0")).alias("source"), F.col("offset").alias("seq"))
    if kind == feed.NAME:
        return lines.select(value, F.col("channel").alias("source"), F.col("offset").alias("seq"))
    # streams can't number rows, so tasks count them
    if kind == "text":
        at = [F.col("_metadata.file_path").alias("_file_path"), F.col("_metadata.file_block_start").alias("_file_block_start"), F.lpad(F.unix_micros("_metadata.file_modification_time").cast("string"), 18, "0").alias("_written")]
    else:
        at = [F.lpad(F.spark_partition_id().cast("string"), 6, "0").alias("_file_path"), F.lit(0).cast("long").alias("_file_block_start"), F.lit("").alias("_written")]
    rows = lines.select(value, *at).mapInArrow(_counted, "value string, _file_path string, _file_block_start long, _written string, _row long")
    return rows.select("value", F.concat_ws(" ", "_written", "_file_path").alias("source"), _place(F.col("_row")).alias("seq"))


def stream_trades(spark: SparkSession, sources: dict[str, dict], day: str) -> DataFrame:
    """A streaming frame of trades.  ``sources``: for each exchange a format and its options (text folder, kafka, tidemark_feed, socket).

    Within a micro-batch trades come in the order of (``source``, ``seq``): the
    file, by the time it was written, and the place in it, or the topic's
    partition (the feed's channel) and the offset.  Other formats keep no offsets; their rows count
    partition by partition.
    """
    out = None
    for exchange, spec in sources.items():
        options = dict(spec)
        kind = options.pop("format")
        if kind == feed.NAME:
            feed.register(spark)
        lines = spark.readStream.format(kind).options(**LIMITS.get(kind, {}) | options).load()
        part = PARSERS[exchange](_sourced(lines, kind), F.lit(day).cast("date"), F.col("seq"))
        out = part if out is None else out.unionByName(part)
    return out


def read_orders(*_):
    """Order messages have a schema (``ORDER_SCHEMA``) but no wire format to read."""
    raise NotImplementedError(f"no wire format for {ORDER_SCHEMA.simpleString()}")


def read_depth(*_):
    """Depth messages have a schema (``DEPTH_SCHEMA``) but no wire format to read."""
    raise NotImplementedError(f"no wire format for {DEPTH_SCHEMA.simpleString()}")


def checked_parquet(spark: SparkSession, path: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Read a feature table without the columns to ``ignore``; those of other types than tables have are refused.  Unsigned 64-bit numbers come as decimal(20,0)."""
    df = spark.read.parquet(path).drop(*ignore)
    odd = [(n, t) for n, t in df.dtypes if t not in {"string", "binary", "int", "bigint", "double", "timestamp", "timestamp_ntz", "decimal(20,0)"}]
    if odd:
        raise ValueError(f"unsupported columns: {odd}")
    return df
