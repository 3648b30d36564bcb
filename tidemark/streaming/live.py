"""Features over a stream of trades, with state by security.

A stateful processor keeps the trades of buckets of securities until their
bars close and numbers them in order of arrival.  A bar closes once event time has passed
its end by the latency; a trade that comes later goes to the first bar still
open.  New trades are added to the state in chunks, so a micro-batch costs in
proportion to its own rows, and a timer at the end of the next period hands
on the trades of all that have ended by then.

Each micro-batch then runs the batch plan over the trades handed on, and over
nothing else.  What a bar needs of those before it (last close, last price,
running totals, bars counted) is a small table of one row a period, security
and day, written anew by every micro-batch that closed a bar, under its
epoch.  An epoch that runs again overwrites what it wrote, so a restart goes
on where the stream stopped.

The end of the day closes when any message of a later time comes, of whatever
security.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions import vector as V
from tidemark.operators import bars as B
from tidemark.operators import features as X
from tidemark.sources.config import Feature, publish_plan

Deliver = Callable[[str, DataFrame], None]

#: The watermark's lag.  Spark drops what comes behind the watermark, but a late trade is to be kept; so the watermark
#: lags by a day, and timers are set as much earlier.
LAG_MS = 86_400_000
_KEPT = ["trad_time", "price", "volume", "side", "bid_seq", "offer_seq", "seq"]
CLOSED = "period int, security string, bar timestamp_ntz, trad_time timestamp_ntz, price double, volume double, side int, bid_seq long, offer_seq long, seq long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def millis(at: Column) -> Column:
    """Wall-clock milliseconds since 1970, whatever the session's zone."""
    days = F.datediff(at.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return ((days * 24 + F.hour(at)) * 60 + F.minute(at)) * 60_000 + F.floor(F.extract(F.lit("SECOND"), at) * 1000).cast("long")


def _period_end(bar, minutes: int):
    """As ``vector.period_end``, in milliseconds; of a number or a series of them."""
    day = (bar - 1) // LAG_MS * LAG_MS
    return day - (day - bar) // (minutes * 60_000) * (minutes * 60_000)


def _packed(rows: pd.DataFrame) -> bytes:
    table, sink = pa.Table.from_pandas(rows[["security", "bar_ms", *_KEPT]], preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


#: Securities share the state of so many keys; a checkpoint holds for the number it was made with.
BUCKETS = 64
#: Trades of one chunk of a state.
CHUNK_ROWS = 10_000


class Collector(StatefulProcessor):
    """The trades of a bucket of securities, kept until the longest period that holds them has ended.

    A micro-batch adds chunks in the order of bars, with the first and last
    bar of each beside them, and sets one timer at most: calls go with chunks
    and micro-batches, not with bars and securities.
    """

    def __init__(self, periods: list[int], latency_ms: int, first_open: Callable[[int], int]):
        self.periods, self.latency, self.first_open = sorted(periods), latency_ms, first_open

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: trades and chunks so far, up to where periods were handed on, and the timer that is set (-1: none)
        self.at = handle.getValueState("at", "n long, parts long, done long, wake long")
        self.parts = handle.getMapState("parts", "part long", "lo long, hi long")
        self.rows = handle.getMapState("rows", "part long", "rows binary")

    def _begin(self) -> list[int]:
        return list(self.at.get()) if self.at.exists() else [0, 0, 0, -1]

    def _keep(self, part: int, rows: pd.DataFrame) -> None:
        """Store rows in the order of their bars."""
        self.rows.updateValue((part,), (_packed(rows),))
        self.parts.updateValue((part,), (int(rows["bar_ms"].iloc[0]), int(rows["bar_ms"].iloc[-1])))

    def _timer(self, end: int) -> int:
        return end + self.latency - LAG_MS

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["source", "seq"], kind="stable")
        n, parts, done, wake = self._begin()
        new["seq"] = range(n, n + len(new))
        now = timerValues.getCurrentWatermarkInMs()
        if now > 0:  # bars that end up to newest - latency are closed
            new["bar_ms"] = new["bar_ms"].clip(lower=self.first_open(now + LAG_MS - self.latency))
        new = new.sort_values("bar_ms", kind="stable")
        for i in range(0, len(new), CHUNK_ROWS):
            self._keep(parts, new.iloc[i : i + CHUNK_ROWS])
            parts += 1
        first = self._timer(min(_period_end(int(new["bar_ms"].iloc[0]), p) for p in self.periods))
        if wake == -1 or first < wake:
            if wake != -1:
                self.handle.deleteTimer(wake)
            self.handle.registerTimer(first)
            wake = first
        self.at.update((n + len(new), parts, done, wake))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, parts, done, wake = self._begin()
        fired = expiredTimerInfo.getExpiryTimeInMs()
        limit = max(done, timerValues.getCurrentWatermarkInMs() - self.latency + LAG_MS)  # what ends before it has ended, of all securities
        following = []
        for (part,), (lo, hi) in list(self.parts.iterator()):
            if any(_period_end(lo, p) < limit and _period_end(hi, p) >= done for p in self.periods):
                held = pa.ipc.open_stream(self.rows.getValue((part,))[0]).read_pandas()
                for p in self.periods:
                    end = _period_end(held["bar_ms"], p)
                    own = (end >= done) & (end < limit)
                    if own.any():
                        got = held[own].assign(period=p, bar=pd.to_datetime(end[own], unit="ms"))
                        yield got[[x.split()[0] for x in CLOSED.split(", ")]]
                left = held[sum(_period_end(held["bar_ms"], p) >= limit for p in self.periods) > 0]
                if not len(left):
                    self.rows.removeKey((part,))
                    self.parts.removeKey((part,))
                    continue
                if 2 * len(left) < len(held):
                    self._keep(part, left)
                lo, hi = int(left["bar_ms"].iloc[0]), int(left["bar_ms"].iloc[-1])
            for p in self.periods:
                end = _period_end(max(lo, limit), p)
                if end <= _period_end(hi, p):
                    following.append(end)
        wake = -1
        if following:
            wake = max(self._timer(min(following)), fired + 1)  # the timer that fired is deleted after this
            self.handle.registerTimer(wake)
        self.at.update((n, parts, limit, wake))

    def close(self) -> None:
        pass


def closed(trades: DataFrame | list[DataFrame], universe: DataFrame, periods: list[int], latency_ms: int = 50, bar: Callable[[Column], Column] = B.session_bar, first_open: Callable[[int], int] = B.first_open) -> DataFrame:
    """The trades of a stream once for each period, handed on when the period has ended: (period, security, bar, ..., seq), where ``seq`` puts a security's trades in the order in which they arrived.

    Of several streams each has a watermark of its own, and the least counts
    (Spark's default policy): a bar closes once all have passed it, and one
    that stalls holds it back.
    """
    rows = None
    for t in trades if isinstance(trades, list) else [trades]:
        if "source" not in t.columns:
            t = t.withColumn("source", F.lit(""))
        t = t.withColumns({"bar_ms": millis(bar(F.col("trad_time"))), "clock": F.timestamp_millis(millis(F.col("trad_time")))}).withWatermark("clock", f"{LAG_MS} milliseconds")
        t = B.only_traced(t, universe).select("security", "clock", "source", "bar_ms", *_KEPT)
        rows = t if rows is None else rows.unionByName(t)
    bucket = F.pmod(F.xxhash64("security"), F.lit(BUCKETS)).cast("int")
    return rows.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(Collector(periods, latency_ms, first_open), CLOSED, "Append", "EventTime")


class LiveFeatures:
    """One stream: what is computed, where its state between epochs stands, and who gets the rows.

    ``bar`` gives a time's minute bar and ``first_open`` the first bar that
    ends after a time.  With ``bars`` (bar, bar_no) every security of the
    universe has a row in every bar up to the last one that closed.  With
    ``merge_gaps`` a minute after a silent one doesn't fire, and its trades
    are collected with the next that does, as ``bars.gap_merged`` has it;
    trades wait in a table until then, or until the longest period has ended.
    """

    def __init__(self, universe: DataFrame, spec: list[Feature], store: str, deliver: Deliver, bars: DataFrame | None = None, bar: Callable[[Column], Column] = B.session_bar, latency_ms: int = 50, first_open: Callable[[int], int] = B.first_open, merge_gaps: bool = False, **options):
        self.universe, self.store, self.deliver, self.bars, self.bar = universe, store, deliver, bars, bar
        self.latency, self.first_open, self.merge_gaps, self.options = latency_ms, first_open, merge_gaps, options
        if merge_gaps and bars is None:
            raise ValueError("merge_gaps needs the day's bars")
        plan = publish_plan(spec, X.FEATURES)
        self.periods = {name: [p for p, names in plan.by_period.items() if name in names] for names in plan.by_period.values() for name in names}

    def start(self, trades: DataFrame | list[DataFrame], checkpoint: str, **trigger) -> StreamingQuery:
        """Run over a streaming frame of trades, or over several (one an exchange, say) of which none may lag behind a bar that is handed on."""
        self.universe.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
        rows = closed(trades, self.universe, [1] if self.merge_gaps else self._every(), self.latency, self.bar, self.first_open)
        return rows.writeStream.outputMode("append").foreachBatch(self.on_closed).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def _every(self) -> list[int]:
        return sorted({p for periods in self.periods.values() for p in periods})

    def _at(self, what: str, epoch: int) -> str:
        return f"{self.store}/{what}/epoch={epoch}"

    def _written(self, df: DataFrame, what: str, epoch: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self._at(what, epoch))
        return df.sparkSession.read.schema(df.schema).parquet(self._at(what, epoch))

    def _before(self, spark: SparkSession, epoch: int) -> tuple[datetime | None, int | None]:
        """Up to where bars were handed on before an epoch, and the last epoch that did."""
        if epoch == 0:
            return None, None
        return tuple(spark.read.parquet(self._at("done", epoch - 1)).first())

    def on_closed(self, rows: DataFrame, epoch: int) -> None:
        """Features of the bars that an epoch has closed."""
        spark = rows.sparkSession
        since, last = self._before(spark, epoch)
        trades = self._written(rows, "closed", epoch)
        until, day = trades.agg(F.max("bar"), F.min(X.day_of(F.col("bar")))).first()
        if until is not None:
            if self.merge_gaps:
                trades = self._merged(trades, since, until, last, epoch)
            for name, periods in self.periods.items():
                self._feature(name, trades.filter(F.col("period").isin(periods)), since, until, day, last, epoch)
            since, last = until, epoch
        done = spark.createDataFrame([(since, last)], "until timestamp_ntz, last long")
        done.write.mode("overwrite").parquet(self._at("done", epoch))

    def _merged(self, trades: DataFrame, since: datetime | None, until: datetime, last: int | None, epoch: int) -> DataFrame:
        """The trades of the periods that have ended by now, each in the minute that its own is collected with."""
        spark = trades.sparkSession
        held, active = trades.select("security", F.col("bar").alias("minute"), *_KEPT), trades.select("bar").distinct()
        if last is not None:
            held = held.unionByName(spark.read.parquet(self._at("held", last)))
            active = active.unionByName(spark.read.parquet(self._at("active", last))).distinct()
        active = self._written(active, "active", epoch)
        fires = B.gap_merged(self.bars.filter(F.col("bar") <= F.lit(until)), active)
        # some hundred bars a day
        rows = held.join(F.broadcast(fires.withColumnRenamed("bar", "minute")), "minute", "left")
        later = V.period_end("fires_at", max(self._every())) > F.lit(until)
        self._written(rows.filter(F.col("fires_at").isNull() | later).select(*held.columns), "held", epoch)
        each = rows.filter(F.col("fires_at").isNotNull()).withColumn("period", F.explode(F.lit(self._every()))).withColumn("bar", V.period_end("fires_at", F.col("period")))
        each = each.filter((F.col("bar") <= F.lit(until)) & (F.lit(since is None) | (F.col("bar") > F.lit(since).cast("timestamp_ntz"))))
        return self._written(each.select("period", "security", "bar", *_KEPT), "merged", epoch)

    def _feature(self, name: str, trades: DataFrame, since: datetime | None, until: datetime, day, last: int | None, epoch: int) -> None:
        spark, options, grid = trades.sparkSession, dict(self.options.get(name, {})), None
        keeps = name in X.BUILT_IN or name in X.STATEFUL
        if keeps and last is not None:
            options["carry"] = spark.read.parquet(self._at(f"carry/{name}", last))
        if self.bars is not None:
            ends = B.period_of(self.bars, self.periods[name]).select("period", F.col("period_end").alias("bar")).distinct().filter(F.col("bar") <= F.lit(until))
            ends = ends if since is None else ends.filter(F.col("bar") > F.lit(since))
            grid = B.dense(spark.createDataFrame([], "period int, security string, bar timestamp_ntz"), self.universe, ends)
        got = self._written(X.feature(name)(trades, grid, **options), f"out/{name}", epoch)
        if keeps:
            self._written(X.carried(name, got, trades, options.get("carry"), day), f"carry/{name}", epoch)
        self.deliver(name, got.drop(X.STATE))


def tumbling(trades: DataFrame, latency: str = "50 milliseconds") -> DataFrame:
    """Right-closed minute bars by built-in windows; trades behind the watermark are dropped."""
    # event time needs an instant; wall-clock times are read in the session's zone and given back as they were
    t = trades.withColumn("trad_time", F.col("trad_time").cast("timestamp")).withWatermark("trad_time", latency)
    w = F.window(F.col("trad_time") - F.expr("interval 1 microsecond"), "1 minute")
    return t.groupBy(w, "security").agg(F.count("*").alias("count"), F.sum(F.col("price") * F.col("volume")).alias("amount")).select(F.col("window.end").cast("timestamp_ntz").alias("bar"), "security", "count", "amount")
