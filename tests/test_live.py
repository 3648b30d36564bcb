"""Features over micro-batches with keyed state, against the batch plan."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.plans.run import run_features
from tidemark.sources import config, trades, universe
from tidemark.sources.schemas import TRADE_SCHEMA
from tidemark.streaming import live

DAY = "2024-01-02"


def at(text, day=DAY):
    return dt.datetime.fromisoformat(f"{day} {text}")


def traced(spark):
    return universe.from_json(spark, json.dumps({"sh": ["600000.XSHG"], "sh_closeprice": [7.0], "sz": ["000001.XSHE", "300002.XSHE"], "sz_closeprice": [9.5, 3.0]}))


class Feed:
    """A folder that gets a file a micro-batch, and a query that is started anew for each."""

    def __init__(self, spark, folder, spec, bars=None, latency_ms=50, **options):
        self.spark, self.folder, self.got, self.all = spark, folder, [], []
        (folder / "in").mkdir()
        self.live = live.LiveFeatures(traced(spark), spec, str(folder / "store"), self.keep, bars, latency_ms=latency_ms, **options)

    def keep(self, name, rows):
        self.got += [(name, tuple(rows.columns), tuple(r)) for r in rows.collect()]

    def send(self, rows):
        """One micro-batch of several partitions; (security, time, price, volume, side, bid, offer)."""
        full = [(s, "SZ", t, float(p), float(v), b, o, side, i) for i, (s, t, p, v, side, b, o) in enumerate(rows)]
        df = self.spark.createDataFrame(full, TRADE_SCHEMA).coalesce(1)
        df.write.mode("append").parquet(str(self.folder / "in"))
        stream = self.spark.readStream.schema(TRADE_SCHEMA).parquet(str(self.folder / "in"))
        self.got = []
        q = self.live.start(stream, str(self.folder / "checkpoint"))
        assert q.awaitTermination(240)
        self.all += self.got
        return self.got


def by_name(got):
    return sorted(f"{name} {dict(sorted(zip(cols, (round(x, 6) + 0.0 if isinstance(x, float) else x for x in row), strict=True)))}" for name, cols, row in got)


def some_trades(n, days=(DAY,), seed=1):
    r = random.Random(seed)
    out = []
    for day in days:
        times = sorted(r.choice([33_000, 34_100, *range(34_200, 36_200)]) * 1000 + r.randrange(1000) for _ in range(n))
        for ms in times:
            s = r.choice(["000001.XSHE", "000001.XSHE", "300002.XSHE", "600000.XSHG", "999999.XSHE"])
            out.append((s, at("00:00:00", day) + dt.timedelta(milliseconds=ms), r.choice([0, 9.5, 9.6, 9.7, 10]), r.randrange(1, 9) * 100, r.choice([1, -1]), r.randrange(20), r.randrange(20)))
    return out


SPEC = [
    config.Feature("candle_stick", (1, 5)),
    config.Feature("debug_trade", (1, 3)),
    config.Feature("trade_amount_std", (1, 5)),
    config.Feature("order_flow_min", (1, 5)),
    config.Feature("order_flow_min_small", (5,)),
]


@pytest.mark.parametrize("dense", [False, True])
def test_equals_batch_over_restarts(spark, tmp_path, dense):
    days = (DAY, "2024-01-03")
    rows = some_trades(160, days)
    spine = None
    if dense:
        spine = B.spine(spark, days[0]).unionByName(B.spine(spark, days[1])).filter(F.date_format("bar", "HH:mm") <= "10:10")
    feed = Feed(spark, tmp_path, SPEC, spine)
    cuts = [0, 61, 175, 240, len(rows)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        feed.send(rows[lo:hi])  # each a restart
    assert feed.send([("none", at("20:00:00", days[1]), 1, 1, 1, 2, 1)]) != []
    batch = spark.createDataFrame([(s, "SZ", t, float(p), float(v), b, o, side, i) for i, (s, t, p, v, side, b, o) in enumerate(rows)], TRADE_SCHEMA)
    want = []
    for name, df in run_features(batch, traced(spark), SPEC, spine).items():
        last = df.agg(F.max("bar")).first()[0]
        want += [(name, tuple(df.columns), tuple(r)) for r in df.filter(F.col("bar") <= F.lit(last)).collect()]
    got = by_name(feed.all)
    if dense:  # bars after the last trade aren't handed on
        final = max(t for _, t, *_ in rows)
        want = [x for x in want if x[2][x[1].index("bar")] <= final + dt.timedelta(minutes=1)]
        got = [x for x in got if x in set(by_name(want))] if len(got) > len(want) else got
    assert got == by_name(want) and len(want) > 200


def test_late_trades(spark, tmp_path):
    """A late trade goes to the first bar still open, also after a restart, and is counted once."""
    feed = Feed(spark, tmp_path, [config.Feature("debug_trade", (1, 5))])
    send = lambda *times: sorted((r[0], r[2].strftime("%M"), r[3]) for _, _, r in feed.send([("000001.XSHE", at(f"10:{t}"), 1, 1, 1, 2, 1) for t in times]))
    assert send("01:30", "02:30", "03:00.100") == [(1, "02", 1.0), (1, "03", 1.0)]
    assert send("01:40", "02:10", "04:30") == [(1, "04", 3.0)]
    assert send("05:30") == [(1, "05", 1.0), (5, "05", 6.0)]
    assert send("20:00") == [(1, "06", 1.0), (5, "10", 1.0)]


def test_closing_time(spark, tmp_path):
    """A bar closes when the newest trade is later than its end by the latency, not before."""
    feed = Feed(spark, tmp_path, [config.Feature("debug_trade", (1,))], latency_ms=500)
    send = lambda *times: sorted(r[2].strftime("%M") for _, _, r in feed.send([("000001.XSHE", at(f"10:{t}"), 1, 1, 1, 2, 1) for t in times]))
    assert send("01:30", "02:00.400") == []
    assert send("02:00.600") == ["02"]


def test_arrival_counts_over_partitions(spark, tmp_path):
    """First and last price follow the lines of the files, of which each has many splits."""
    (tmp_path / "in").mkdir()
    n = 0
    for name in ("b.csv", "a.csv"):  # the order in which they are written counts
        text = "".join(f"_,_,_,5,1,000001,_,{n + i + 1},100,70,09:31:0{i % 3}.000\n" for i in range(400))
        (tmp_path / "in" / name).write_text(text)
        n += 400
        os.utime(tmp_path / "in" / name, (1_700_000_000 + n, 1_700_000_000 + n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        stream = trades.stream_trades(spark, {"SZ": {"format": "text", "path": str(tmp_path / "in")}}, DAY)
        got = []
        run = live.LiveFeatures(traced(spark), [config.Feature("candle_stick", (1,))], str(tmp_path / "store"), lambda _, df: got.extend(df.collect()))
        assert run.start(stream, str(tmp_path / "checkpoint")).awaitTermination(240)
        (tmp_path / "in" / "z.csv").write_text("_,_,_,5,1,9,_,1,100,70,15:31:00.000\n")
        assert run.start(stream, str(tmp_path / "checkpoint")).awaitTermination(240)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {r["bar"].strftime("%M"): (r["openprice_nfq"], r["closeprice_nfq"], r["cjb"]) for r in got} == {"31": (1.0, 800.0, 268.0), "32": (2.0, 799.0, 532.0)}


def test_sources_wait_for_each_other(spark, tmp_path):
    """Of two streams a bar closes once, when both have passed it; one that stalls holds it back."""
    got = []
    run = live.LiveFeatures(traced(spark), [config.Feature("debug_trade", (1,))], str(tmp_path / "store"), lambda _, df: got.extend((r["security"][:6], r["bar"].strftime("%M"), r["count"]) for r in df.collect()))

    def send(**by):
        streams = []
        for e in ("SZ", "SH"):
            rows = [("000001.XSHE" if e == "SZ" else "600000.XSHG", e, at(f"10:{t}"), 1.0, 1.0, 2, 1, 1, i) for i, t in enumerate(by.get(e, ()))]
            spark.createDataFrame(rows, TRADE_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / e))
            streams.append(spark.readStream.schema(TRADE_SCHEMA).parquet(str(tmp_path / e)))
        got.clear()
        assert run.start(streams, str(tmp_path / "checkpoint")).awaitTermination(240)
        return sorted(got)

    assert send(SZ=["01:10", "03:10"]) == []  # nothing of the other yet
    assert send(SH=["00:30", "01:30"], SZ=["05:00"]) == [("600000", "01", 1.0)]
    # after a restart each source must be heard of anew
    assert send(SH=["04:30"], SZ=["05:10"]) == [("000001", "02", 1.0), ("000001", "04", 1.0), ("600000", "02", 1.0)]


def bars_with_trades(state, bar, rows):
    """As the built-in ``debug_trade``: amount, count, and the running count of the day's bars with trades."""
    state["n"] += rows.num_rows > 0
    amount = sum(p * v for p, v in zip(rows["price"].to_pylist(), rows["volume"].to_pylist(), strict=True))
    return [amount, rows.num_rows, state["n"] if rows.num_rows else 0]


def test_user_feature_with_state(spark, tmp_path):
    """A feature with a state of its own equals the built-in one, in batch and over micro-batches."""
    from tidemark.operators import features as X

    X.register_stateful("my_trade", ["amount", "count", "term_count"], lambda: {"n": 0}, bars_with_trades)
    spec = [config.Feature("my_trade", (1, 5)), config.Feature("debug_trade", (1, 5))]
    rows = some_trades(60, (DAY, "2024-01-03"), seed=4)
    batch = spark.createDataFrame([(s, "SZ", t, float(p), float(v), b, o, side, i) for i, (s, t, p, v, side, b, o) in enumerate(rows)], TRADE_SCHEMA)
    spine = B.spine(spark, DAY).filter("bar_no <= 9")
    for bars in (None, spine):
        out = run_features(batch, traced(spark), spec, bars)
        mine, built_in = (by_name([("x", tuple(df.columns), tuple(r)) for r in df.collect()]) for df in (out["my_trade"], out["debug_trade"]))
        assert mine == built_in and len(mine) > 30
    feed = Feed(spark, tmp_path, spec)
    for lo, hi in ((0, 50), (50, 90), (90, 120)):
        feed.send(rows[lo:hi])
    feed.send([("none", at("20:00:00", "2024-01-03"), 1, 1, 1, 2, 1)])
    mine, built_in = ([("x", *rest) for name, *rest in feed.all if name == n] for n in ("my_trade", "debug_trade"))
    assert by_name(mine) == by_name(built_in) and len(mine) > 100


def test_silent_minutes(spark, tmp_path):
    """With silent minutes the live bars are those of ``gap_merged``."""
    spec = [config.Feature("debug_trade", (1, 5)), config.Feature("candle_stick", (1, 5))]
    spine = B.spine(spark, DAY).filter("bar_no <= 24")
    silent = {"09:33", "09:34", "09:38", "09:41", "09:43", "09:44", "09:49"}
    rows = [r for r in some_trades(400, seed=7) if r[1] < at("09:53:30") and (r[1] + dt.timedelta(seconds=59, milliseconds=999)).strftime("%H:%M") not in silent]
    feed = Feed(spark, tmp_path, spec, spine, merge_gaps=True)
    for lo, hi in ((0, 40), (40, 80), (80, len(rows))):
        feed.send(rows[lo:hi])
    feed.send([("none", at("20:00:00"), 1, 1, 1, 2, 1)])
    batch = spark.createDataFrame([(s, "SZ", t, float(p), float(v), b, o, side, i) for i, (s, t, p, v, side, b, o) in enumerate(rows)], TRADE_SCHEMA)
    batch = B.only_traced(batch, traced(spark)).withColumn("bar", B.session_bar(F.col("trad_time")))
    merged = batch.join(B.gap_merged(spine, batch.select("bar")), "bar").filter("fires_at IS NOT NULL").drop("bar")
    last = merged.agg(F.max("fires_at")).first()[0]
    want = []
    for name, df in run_features(merged, traced(spark), spec, spine, F.col("fires_at")).items():
        want += [(name, tuple(df.columns), tuple(r)) for r in df.filter(F.col("bar") <= F.lit(last)).collect()]
    got = [x for x in feed.all if x[2][x[1].index("bar")] <= last]
    assert by_name(got) == by_name(want) and len(want) > 100
    assert merged.filter("fires_at > date_trunc('minute', trad_time - interval 1 microsecond) + interval 1 minute AND hour(trad_time) = 9 AND minute(trad_time) > 31").count() > 0


def test_many_small_days_share_a_task(spark):
    """Days of many securities pass through one call a task, each with its own state, whatever the Arrow batches' bounds."""
    from tidemark.operators import features as X

    calls = spark.sparkContext.accumulator(0)

    def count(state, bar, rows):
        state["n"] += rows.num_rows
        calls.add(1)
        return [rows.num_rows, state["n"]]

    X.register_stateful("my_counts", ["count", "total"], lambda: {"n": 0}, count)
    rows = [(1, f"S{i % 40:02d}", at(f"10:{i % 7 + 1:02d}:00", day), at("10:00:00", day), 1.0, 1.0, 1, 1, 1, i) for day in (DAY, "2024-01-03") for i in range(700)]
    df = spark.createDataFrame(rows, "period int, security string, bar timestamp_ntz, trad_time timestamp_ntz, price double, volume double, side int, bid_seq long, offer_seq long, seq long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        plan = X.FEATURES["my_counts"](df)
        got = plan.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, totals = {}, {}
    for _, s, b, *_ in sorted(rows, key=lambda r: r[2]):
        want[s, b] = want.get((s, b), 0) + 1
    for s, b in sorted(want):
        totals[s, b] = totals.get((s, b.date()), 0) + want[s, b]
        totals[s, b.date()] = totals[s, b]
    assert {(r["security"], r["bar"]): (r["count"], r["total"]) for r in got} == {k: (n, totals[k]) for k, n in want.items()} and calls.value == len(want)
    assert sum(r[X.STATE] is not None for r in got) == 80  # one a day and security
    assert "CoGroup" not in plan._jdf.queryExecution().toString()


class FakeState:
    """A state store in memory that counts its calls."""

    def __init__(self):
        self.states, self.timers, self.calls = {}, set(), 0

    def _state(self, name):
        held, me = self.states.setdefault(name, {}), self

        class State:
            def exists(self):
                me.calls += 1
                return () in held

            def get(self):
                me.calls += 1
                return held[()]

            def update(self, value):
                me.calls += 1
                held[()] = value

            def getValue(self, key):
                me.calls += 1
                return held[key]

            def updateValue(self, key, value):
                me.calls += 1
                held[key] = value

            def containsKey(self, key):
                me.calls += 1
                return key in held

            def removeKey(self, key):
                me.calls += 1
                del held[key]

            def iterator(self):
                me.calls += 1
                return iter(held.items())

        return State()

    def getValueState(self, name, schema):
        return self._state(name)

    def getMapState(self, name, *schema):
        return self._state(name)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_calls_of_the_collector_go_with_micro_batches():
    """Many securities and bars need few timers and calls to the state, and every trade is handed on once a period."""
    import pandas as pd

    day = 19_000 * live.LAG_MS
    store, collector = FakeState(), live.Collector([1, 5], 50, lambda ms: (ms // 60_000 + 1) * 60_000)
    collector.init(store)
    out, sent = [], []
    for n in range(4):  # micro-batches of a quarter of an hour, the last trades of each early
        new = pd.DataFrame({"security": [f"S{i % 30}" for i in range(600)], "source": "", "seq": range(600), "bar_ms": [day + (n * 15 + i % 15 + 1) * 60_000 for i in range(600)]})
        new = new.assign(trad_time=pd.Timestamp("2022-01-01"), price=1.0, volume=1.0, side=1, bid_seq=1, offer_seq=1)
        now = 0 if n == 0 else day + n * 15 * 60_000 - live.LAG_MS
        sent.append(new)
        list(collector.handleInputRows((0,), iter([new]), Now(now)))
        end = day + (n * 15 + 15) * 60_000 + 51 - live.LAG_MS
        for at_ in sorted(x for x in store.timers if x < end):
            out += list(collector.handleExpiredTimer((0,), Now(end), Now(at_)))
            store.timers.discard(at_)
    got, want = pd.concat(out), pd.concat(sent)
    for p, part in got.groupby("period"):
        ends = pd.to_datetime(live._period_end(want["bar_ms"], int(p)), unit="ms")
        assert part.groupby(["security", "bar"]).size().to_dict() == want.groupby(["security", ends.rename("bar")]).size().to_dict()
    assert (got.groupby(["period", "security"])["seq"].nunique() == 80).all() and not store.timers and not store.states["rows"]
    assert store.calls < 100
