"""Parsers, configuration, universe, bars, sinks and streams."""

import datetime as dt
import json

import pyarrow as pa
import pyarrow.parquet
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import features as X
from tidemark.plans.run import completed, run_features
from tidemark.sources import config, sinks, trades, universe
from tidemark.streaming import live

DAY = "2024-01-02"
SZ = ["_,_,_,5,1,000001,_,10.00,100,70,09:30:01.000", "_,_,_,5,1,000001,_,0,100,52,09:30:01.010", "_,_,_,5,5,000001,_,x,100,70,09:31:00.000", "_,_,_,7,1,300002,_,3.5,10,70,09:31:00.001", "short,line"]
SH = ["_,_,_,600000,09:30:02.500,7.25,300,_,3,6,S", "_,_,_,600000,09:25:00.000,7.20,300,_,3,6,N"]


def lines(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def all_trades(spark):
    day = F.lit(DAY).cast("date")
    return trades.parse_sz(lines(spark, SZ), day).unionByName(trades.parse_sh(lines(spark, SH), day))


def test_parsers(spark):
    got = sorted((r["security"], r["side"], r["price"], r["volume"], str(r["trad_time"])) for r in all_trades(spark).collect())
    assert got == [
        ("000001.XSHE", -1, 0.0, 100.0, f"{DAY} 09:31:00"),
        ("000001.XSHE", 1, 10.0, 100.0, f"{DAY} 09:30:01"),
        ("300002.XSHE", 1, 3.5, 10.0, f"{DAY} 09:31:00.001000"),
        ("600000.XSHG", -1, 7.25, 300.0, f"{DAY} 09:30:02.500000"),
    ]


def test_bars(spark):
    rows = [("09:10:00", "09:25:00"), ("09:25:00", "09:25:00"), ("09:27:00", "09:30:00"), ("09:31:00", "09:31:00"), ("09:31:00.001", "09:32:00")]
    df = spark.createDataFrame([(dt.datetime.fromisoformat(f"{DAY} {a}"), dt.datetime.fromisoformat(f"{DAY} {b}")) for a, b in rows], "t timestamp_ntz, want timestamp_ntz")
    assert df.filter(B.session_bar(F.col("t")) != F.col("want")).count() == 0
    spine = B.spine(spark, DAY)
    assert spine.count() == 242
    ends = {(r["period"], r["bar"]): r["period_end"] for r in B.period_of(spine, [5], "counter").collect()}
    assert ends[5, dt.datetime.fromisoformat(f"{DAY} 09:31:00")] == dt.datetime.fromisoformat(f"{DAY} 09:33:00")
    clock = {(r["period"], r["bar"]): r["period_end"] for r in B.period_of(spine, [5]).collect()}
    assert clock[5, dt.datetime.fromisoformat(f"{DAY} 09:31:00")] == dt.datetime.fromisoformat(f"{DAY} 09:35:00")


def test_gap_merge(spark):
    spine = B.spine(spark, DAY).filter("bar_no <= 8")
    at = lambda m: dt.datetime.fromisoformat(f"{DAY} 09:{m}:00")
    active = spark.createDataFrame([(at(m),) for m in (31, 32, 34, 35)], "bar timestamp_ntz")
    got = {r["bar"]: r["fires_at"] for r in B.gap_merged(spine, active).collect()}
    assert got[at(32)] == at(32) and got[at(33)] == at(35) and got[at(34)] == at(35)


def test_config(tmp_path):
    plan = config.publish_plan(config.SHIPPED)
    assert [len(plan.by_period[p]) for p in (1, 5, 15, 30)] == [7, 6, 6, 4] and len(plan.outputs) == 23
    with pytest.raises(ValueError, match="unknown"):
        config.publish_plan([config.Feature("nothing", (1,))])
    spec = config.endpoints(plan, 100, "h")
    assert spec["trade"][0]["port"] == list(range(100, 107)) and spec["trade"][1]["port"][0] == 107
    (tmp_path / "p.json").write_text(json.dumps({"trade": [{"open": True, "name": "candle_stick", "period": [1, 5]}], "order": [], "depth": []}))
    assert config.load_publish(str(tmp_path / "p.json")) == [config.Feature("candle_stick", (1, 5))]
    (tmp_path / "s.json").write_text(json.dumps({"system": {"min_period": 60000, "collect_latency(ms)": 50, "port_begin": 1}, "mode": {"dump": True, "dump_dir": "x"}}))
    assert config.load_system(str(tmp_path / "s.json")).dump_dir == "x"
    (tmp_path / "f.json").write_text(json.dumps({"debug_trade": ["amount", "count"]}))
    assert config.load_feature_format(str(tmp_path / "f.json")) == {"debug_trade": ["amount", "count"]}
    (tmp_path / "c.json").write_text(json.dumps(spec))
    again, ports = config.load_period_call(str(tmp_path / "c.json"))
    assert again == plan and ports[1, "candle_stick"] == 100 and len(ports) == 23
    (tmp_path / "u.json").write_text(json.dumps({"trade": {"sh": {"ip": "1.2.3.4", "port": 5, "channel": ""}}}))
    assert config.load_subscribe(str(tmp_path / "u.json"))["trade", "SH"].address == "tcp://1.2.3.4:5"


def small_universe(spark):
    return universe.from_json(spark, json.dumps({"sh": ["600000.XSHG"], "sh_closeprice": [7.0], "sz": ["000001.XSHE", "300002.XSHE"], "sz_closeprice": [9.5, 3.0]}))


def test_run_features(spark):
    bars = B.spine(spark, DAY).filter("bar_no <= 12")
    spec = [config.Feature("candle_stick", (1, 5)), config.Feature("debug_trade", (1,)), config.Feature("order_flow_min", (1,), open=False)]
    out = run_features(all_trades(spark), small_universe(spark), spec, bars)
    assert set(out) == {"candle_stick", "debug_trade"}
    rows = out["candle_stick"].collect()
    assert sum(r["period"] == 1 for r in rows) == 12 * 3
    got = {(r["period"], r["security"], r["bar"].strftime("%H:%M")): r for r in rows}
    assert got[1, "300002.XSHE", "09:32"]["closeprice_nfq"] == 3.5 and got[1, "300002.XSHE", "09:31"]["closeprice_nfq"] == 3.0
    assert got[5, "300002.XSHE", "09:35"]["cjb"] == 1
    assert completed([out["candle_stick"], out["debug_trade"]]).count() == 12
    last = run_features(all_trades(spark), small_universe(spark), [config.Feature("candle_stick", (5,))], period_input="last_minimum")["candle_stick"]
    assert last.count() == 0
    with pytest.raises(ValueError, match="unknown"):
        X.feature("nothing")
    X.register("mine", lambda t, grid=None: t.groupBy(*X.KEY).count())
    assert X.feature("mine")(B.keyed(all_trades(spark), [1])).count() == 3
    assert run_features(all_trades(spark), small_universe(spark), [config.Feature("mine", (1, 5))])["mine"].count() == 6


def test_periods_add_up_minutes(spark):
    many = spark.range(3000).selectExpr(
        "concat('00000', id % 3, '.XSHE') AS security", f"timestampadd(SECOND, cast(id * 7919 % 7200 AS int), timestamp_ntz'{DAY} 09:31:00') AS trad_time",
        "cast(id % 11 AS double) AS price", "cast(id % 13 + 1 AS double) AS volume", "id % 32 AS bid_seq", "id % 29 AS offer_seq", "if(id % 5 < 2, 1, -1) AS side", "id * 7919 % 7200 * 4096 + id AS seq",
    )
    everyone = universe.from_json(spark, json.dumps({"sh": [], "sh_closeprice": [], "sz": [f"00000{i}.XSHE" for i in range(3)], "sz_closeprice": [1.0] * 3}))
    rounded = lambda df, cols: sorted(str([round(x, 6) + 0.0 if isinstance(x, float) else x for x in r]) for r in df.select(*cols).collect())
    for name, how in (("candle_stick", {}), ("candle_stick", {"price_filter": "compat"}), ("debug_trade", {}), ("order_flow_min", {}), ("trade_amount_std", {}), ("trade_amount_quantile", {"first_logret": "zero"})):
        got = run_features(many, everyone, [config.Feature(name, (1, 5, 30))], **{name: how})[name]
        want = X.feature(name)(B.keyed(many, [1, 5, 30]), **how)
        assert rounded(got, want.columns) == rounded(want, want.columns) and want.count() > 300
    # every feature of the shipped list from one scan and one exchange
    from pyspark import StorageLevel

    kept = run_features(many, everyone, config.SHIPPED, keep=StorageLevel.DISK_ONLY)
    plain = run_features(many, everyone, config.SHIPPED)
    assert len(kept) == 7
    for name in ("order_flow_min_big", "trade_amount_dollar"):
        assert rounded(kept[name], plain[name].columns) == rounded(plain[name], plain[name].columns)
    many.sparkSession.catalog.clearCache()


def test_equal_orders_of_other_minutes(spark):
    """Two sales of the same three trades, dealt otherwise to the minutes, equal their mean: both are small."""
    dealt = {1: ((10.1, 1), (20.2, 1), (30.3, 3)), 2: ((10.1, 1), (20.2, 3), (30.3, 3))}
    assert (10.1 + 20.2) + 30.3 != 10.1 + (20.2 + 30.3)
    rows = [("000001.XSHE", dt.datetime(2024, 1, 2, 9, 30) + dt.timedelta(minutes=m, seconds=-30), p, 1.0, 0, no, -1, m * 100 + no * 10 + i) for no, each in dealt.items() for i, (p, m) in enumerate(each)]
    many = spark.createDataFrame(rows, "security string, trad_time timestamp_ntz, price double, volume double, bid_seq long, offer_seq long, side int, seq long")
    got = run_features(many, many.select("security").distinct(), [config.Feature("trade_amount_std", (1, 5))])["trade_amount_std"].filter("period = 5").first()
    assert (got["smallSellAmt"], got["midSellAmt"], got["bigSellAmt"], got["ultraSellAmt"]) == (pytest.approx(121.2), 0, 0, 0)


def test_amounts_on_a_grid(spark):
    from tidemark.functions import grouping as G

    xs = [1e308, float("inf"), float("nan"), None, 0.1, -12345.678901]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", *(c.alias(n) for n, c in zip("ab", G.on_grid(F.col("x")), strict=True))).collect()
    assert [str(r["x"]) for r in got] == [str(r["a"] if r["b"] is None else r["a"] + r["b"]) for r in got]
    assert all(r["b"] == 0 or abs(r["b"]) <= 2**-17 for r in got if r["b"] is not None)


def test_sinks(spark, tmp_path):
    bars = B.spine(spark, DAY).filter("bar_no = 4")
    got = run_features(all_trades(spark), small_universe(spark), [config.Feature("order_flow_min", (1,))], bars)["order_flow_min"]
    (tmp_path / "sent").mkdir()
    target = str(tmp_path / "sent")

    def send(data):  # from a task
        import uuid

        with open(f"{target}/{uuid.uuid4().hex}", "wb") as f:
            return f.write(data) > 0

    size = sinks.publish(got, send, universe=small_universe(spark), epoch=7)
    sent = [p.read_bytes() for p in (tmp_path / "sent").iterdir()]
    assert [len(x) for x in sent] == [size]
    table = pa.ipc.open_stream(sent[0]).read_all()
    assert table.num_rows == 3 and all(str(x) == "nan" for x in table["Sv"].to_pylist()) and table.schema.metadata[b"epoch"] == b"7"
    assert table["securityid"].to_pylist() == [b"600000.XSHG", b"000001.XSHE", b"300002.XSHE"]
    assert sinks.publish(got, lambda b: False, retries=2) == -1
    sinks.deliver(got, "order_flow_min", path=str(tmp_path / "dump"))
    sinks.deliver(got, "order_flow_min", path=str(tmp_path / "dump"))  # a rerun replaces the bar
    assert (tmp_path / "dump/order_flow_min/period=1" / f"day={DAY}" / "stem=09_32_00_000").is_dir()
    back = sinks.read_dump(spark, str(tmp_path / "dump"), "order_flow_min", 1)
    assert back.count() == 3 and back.filter(F.isnan("Sv")).count() == 3 and back.columns == got.columns
    assert {(r["security"], r["bar"]) for r in back.collect()} == {(r["security"], r["bar"]) for r in got.collect()}
    assert table.schema.field("securityid").type == pa.binary(11) and table.schema.field("datetime").type == pa.timestamp("us")
    # a single file of another writer, with ids of fixed size
    (tmp_path / "one/x/period=5").mkdir(parents=True)
    pa.parquet.write_table(pa.table({"securityid": pa.array([b"000001.XSHE"], pa.binary(11)), "datetime": pa.array([dt.datetime(2024, 1, 2, 9, 35)], pa.timestamp("us")), "v": [1.5]}), str(tmp_path / "one/x/period=5/09_35_00_000.parquet"))
    assert [tuple(r) for r in sinks.read_dump(spark, str(tmp_path / "one"), "x", 5).collect()] == [(5, "000001.XSHE", dt.datetime(2024, 1, 2, 9, 35), 1.5)]
    spark.sql("SELECT array(1) AS a").write.parquet(str(tmp_path / "odd"))
    with pytest.raises(ValueError, match="unsupported"):
        trades.checked_parquet(spark, str(tmp_path / "odd"))
    with pytest.raises(NotImplementedError):
        trades.read_orders()
    ids = [r["security"] for r in sinks.to_output(got, small_universe(spark)).collect()]
    assert ids[0] == "600000.XSHG"


def test_limits_give_way_to_options(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.txt").write_text(SZ[0] + "\n")
    assert trades.LIMITS["text"] and trades.LIMITS["kafka"]
    stream = trades.stream_trades(spark, {"SZ": {"format": "text", "path": str(tmp_path / "in"), "maxFilesPerTrigger": "1"}}, DAY)
    sizes = []
    q = stream.writeStream.foreachBatch(lambda b, e: sizes.append(b.count())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sizes == [1, 1, 1]


def test_arrival_is_by_line(spark):
    day = F.lit(DAY).cast("date")
    rows = ["_,_,_,5,1,000001,_,10.00,100,70,09:31:01.000", "_,_,_,5,1,000001,_,11.00,100,70,09:31:01.000", "_,_,_,5,1,000001,_,12.00,100,70,09:31:00.999"]
    got = trades.parse_sz(lines(spark, rows).coalesce(1), day).orderBy("seq")
    assert [r["price"] for r in got.collect()] == [10.0, 11.0, 12.0]
    many = trades.parse_sz(spark.range(0, 3000, 1, 1000).selectExpr("concat('_,_,_,5,1,000001,_,', id + 1, ',100,70,09:31:01.000') AS value"), day)
    assert [r["price"] for r in many.orderBy("seq").collect()] == [float(i + 1) for i in range(3000)] and many.select("seq").distinct().count() == 3000


def test_arrival_in_files(spark, tmp_path):
    """Lines of several files, each of many splits, in the order of the names and lines; empty lines and a last line without its end count."""
    (tmp_path / "a b").mkdir()
    n = 0
    for name, size, end in (("2 x.csv", 1500, ""), ("1%20.csv", 700, "\n"), ("3.csv", 1, "\n"), ("4.csv", 0, "")):
        text = [f"_,_,_,5,1,000001,_,{{}},100,70,09:31:{i % 60:02d}.000" + "\n" * (i % 3) for i in range(size)]
        (tmp_path / "a b" / name).write_text("\n".join(text) + end)
    for name in ("1%20.csv", "2 x.csv", "3.csv"):
        at = tmp_path / "a b" / name
        parts = at.read_text().split("{}")
        at.write_text("".join(p + (str(n + i + 1) if i + 1 < len(parts) else "") for i, p in enumerate(parts)))
        n += len(parts) - 1
    split, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    for size, open_cost in (("700", "0"), ("64k", "1m"), ("64k", "0")):
        spark.conf.set(split, size)
        spark.conf.set(cost, open_cost)
        try:
            got = trades.read_trades(spark, {"SZ": str(tmp_path / "a b")}, DAY)
            rows = [r["price"] for r in got.orderBy("seq").collect()]
            assert size != "700" or got.rdd.getNumPartitions() > 40
        finally:
            spark.conf.unset(split)
            spark.conf.unset(cost)
        assert rows == [float(i + 1) for i in range(n)] and n == 2201


def test_packed(spark):
    from tidemark.functions import vector as V

    df = spark.createDataFrame([(3, 5), (0, 15)], "a long, b long")
    assert [r[0] for r in df.select(V.packed(("a", 8), ("b", 4))).collect()] == [53, 15]
    for a, b in ((1, 16), (256, 0), (-1, 0), (0, -1)):
        with pytest.raises(Exception, match="not in"):
            spark.createDataFrame([(a, b)], "a long, b long").select(V.packed(("a", 8), ("b", 4))).collect()


def test_queries_round_as_their_sql_does(spark):
    """Values whose digits end in 5 at the seventh place."""
    import duckdb

    from tidemark.plans.catalog import _r6

    xs = [n / 640 for n in range(1, 4000)] + [-n / 128e4 for n in range(1, 2000)] + [None, 1e300]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INT, x DOUBLE)")
    con.execute("INSERT INTO t SELECT unnest(?), unnest(?)", [list(range(len(xs))), xs])
    got = sorted(map(tuple, _r6(spark.createDataFrame(list(enumerate(xs)), "i int, x double")).collect()))
    assert got == con.execute("SELECT i, round(x, 6) + 0.0 FROM t ORDER BY i").fetchall()


def test_universe_wider_than_a_schema(spark):
    """Closes in maps, one row a day and block, give what a column a security does; more than a pivot may have columns."""
    ids = ["600000", "000001", "300002", "123456", "000003", "600001"]
    closes = [1.0, None, 3.0, float("nan"), 5.0, 6.0]
    ordered = sorted(zip(ids, closes, strict=True))
    columns = spark.createDataFrame([("2024-01-02", *(c for _, c in ordered)), ("2024-01-03", *(9.0 for _ in ordered))], "day string, " + ", ".join(f"`{i}` double" for i, _ in ordered))
    maps = spark.createDataFrame([("2024-01-02", dict(ordered[k : k + 2])) for k in (4, 0, 2)] + [("2024-01-03", {"777777": 1.0})], "day string, closes map<string,double>")
    want = [("123456", "SH", 0.0, 0), ("600000", "SH", 1.0, 1), ("600001", "SH", 6.0, 2), ("000001", "SZ", 0.0, 3), ("000003", "SZ", 5.0, 4), ("300002", "SZ", 3.0, 5)]
    for daily in (columns, maps):
        u = universe.from_daily(daily, "day", "2024-01-02")
        for got in (u, universe.from_json_parts(universe.to_json_parts(u)), universe.from_json(spark, universe.to_json(u))):
            assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[3]) == want
    many = spark.range(12_000).selectExpr("'2024-01-02' AS day", "lpad(cast(id AS string), 6, '0') AS id").groupBy("day", F.substring("id", 1, 3)).agg(F.map_from_entries(F.collect_list(F.struct("id", F.lit(1.0)))).alias("closes"))
    got = universe.from_json_parts(universe.to_json_parts(universe.from_daily(many.select("day", "closes"), "day", "2024-01-02")))
    assert got.agg(F.count("*"), F.count_distinct("row_no"), F.max("row_no")).first() == (12_000, 12_000, 11_999)
