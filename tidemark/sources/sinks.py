"""Sinks: Parquet layout and its reader, Arrow IPC bytes, publishers."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RETRIES, WAIT_S = 5, 0.01
#: Bytes of a security id in output tables.
ID_BYTES = 11


def to_output(df: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Output form: undefined doubles as NaN, and with a universe the ids' rows in its order."""
    doubles = [n for n, t in df.dtypes if t == "double"]
    df = df.select(*(F.coalesce(n, F.lit(float("nan"))).alias(n) if n in doubles else F.col(n) for n in df.columns))
    if universe is not None:
        df = df.join(universe.select("security", "row_no"), "security").orderBy("row_no").drop("row_no")
    return df


def to_table(df: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Output columns: ``securityid`` of fixed width, ``datetime``, and the feature's doubles."""
    out = to_output(df, universe)
    rest = [c for c in out.columns if c not in ("period", "security", "bar")]
    ids = F.rpad(F.col("security").cast("string"), ID_BYTES, "\0").cast("binary")
    return out.select(ids.alias("securityid"), F.col("bar").alias("datetime"), *rest)


def dump(df: DataFrame, path: str, feature: str) -> None:
    """Snappy Parquet at ``path``/feature/period=k/day=.../stem=HH_mm_ss_SSS in one write; written again, a bar replaces itself."""
    out = to_table(df.withColumn("_period", F.col("period"))).withColumnRenamed("_period", "period")
    out = out.select("*", F.to_date("datetime").alias("day"), F.date_format("datetime", "HH_mm_ss_SSS").alias("stem"))
    write = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "snappy")
    write.partitionBy("period", "day", "stem").parquet(f"{path}/{feature}")


def read_dump(spark: SparkSession, path: str, feature: str, period: int) -> DataFrame:
    """(period, security, bar, columns) of what ``dump`` wrote, or of single files HH_MM_SS_mmm.parquet in the same folders."""
    from tidemark.sources.trades import checked_parquet

    df = checked_parquet(spark, f"{path}/{feature}/period={period}", ignore=("day", "stem"))
    security = F.regexp_replace(F.col("securityid").cast("string"), "\\x00+$", "").alias("security")
    return df.select(F.lit(period).alias("period"), security, F.col("datetime").alias("bar"), *(c for c in df.columns if c not in ("securityid", "datetime")))


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared folder (``spark.checkpoint.dir``); on a local session without one, a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tidemark-")
    return f"{at}/out-{uuid.uuid4().hex}"


def ipc(table: pa.Table, **marks: object) -> bytes:
    """One Arrow IPC stream; ids of fixed size, times in microseconds.  ``marks`` travel in the schema's metadata."""
    kinds = {"securityid": pa.binary(ID_BYTES), "datetime": pa.timestamp("us")}
    for i, f in enumerate(table.schema):
        if f.name in kinds:
            table = table.set_column(i, f.name, table.column(i).cast(kinds[f.name]))
    table = table.replace_schema_metadata({k: str(v) for k, v in marks.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


_PACKET = "period int, bar timestamp_ntz, rows long, ipc binary"


def packets(df: DataFrame, universe: DataFrame | None = None, epoch: int = 0) -> DataFrame:
    """(period, bar, rows, ipc): the rows of each bar as one Arrow stream, made in the task that holds the bar; as many rows as the universe has, in its order."""
    place = F.col("security")
    if universe is not None:
        df, place = df.join(universe.select("security", "row_no"), "security"), F.col("row_no")
    t = to_output(df.withColumn("_place", place))
    rest = [c for c in df.columns if c not in ("period", "security", "bar", "row_no")]
    ids = F.rpad(F.col("security").cast("string"), ID_BYTES, "\0").cast("binary").alias("securityid")
    t = t.select("period", "bar", "_place", ids, F.col("bar").alias("datetime"), *rest)

    def pack(bar: pa.Table) -> pa.Table:
        period, at = bar["period"][0].as_py(), bar["bar"][0]
        rows = bar.sort_by("_place").drop_columns(["period", "bar", "_place"])
        return pa.table([pa.array([period], pa.int32()), pa.array([at.as_py()], pa.timestamp("us")), pa.array([len(rows)]), pa.array([ipc(rows, epoch=epoch, period=period)], pa.binary())], names=["period", "bar", "rows", "ipc"])

    return t.groupBy("period", "bar").applyInArrow(pack, _PACKET)


def publish(df: DataFrame, send: Callable[[bytes], bool], retries: int = RETRIES, universe: DataFrame | None = None, epoch: int = 0) -> int:
    """Send every bar of one feature from the task that packed it; returns the bytes sent, or -1 if ``send`` kept refusing a bar.

    The driver gets sums only.  A task that runs again sends its bars again,
    with the same epoch and period in the stream's metadata, by which a
    receiver knows them.
    """

    def sending(batches):
        for batch in batches:
            out = []
            for data in batch.column("ipc"):
                data, took = data.as_py(), -1
                for _ in range(retries):
                    if send(data):
                        took = len(data)
                        break
                    time.sleep(WAIT_S)
                out.append(took)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["sent"])

    sent, refused = packets(df, universe, epoch).select("ipc").mapInArrow(sending, "sent long").agg(F.sum("sent"), F.count(F.when(F.col("sent") < 0, 1))).first()
    return -1 if refused else sent or 0


def unpacked(packed: DataFrame, columns: str) -> DataFrame:
    """The rows of ``packets`` as a receiver reads them: (period, security, bar, ``columns``), a schema of doubles by name."""
    names = [c.split()[0] for c in columns.split(",")]

    def read(batches):
        for batch in batches:
            for period, data in zip(batch.column("period").to_pylist(), batch.column("ipc"), strict=True):
                t = pa.ipc.open_stream(data.as_buffer()).read_all()
                ids = [x.rstrip(b"\0").decode() for x in t["securityid"].to_pylist()]
                yield from pa.table([pa.array([period] * len(t), pa.int32()), pa.array(ids), t["datetime"], *(t[n] for n in names)], names=["period", "security", "bar", *names]).to_batches()

    return packed.select("period", "ipc").mapInArrow(read, f"period int, security string, bar timestamp_ntz, {columns}")


def deliver(df: DataFrame, feature: str, send: Callable[[bytes], bool] | None = None, path: str | None = None) -> None:
    """Publish, dump, or both."""
    if path:
        dump(df, path, feature)
    if send:
        publish(df, send)
