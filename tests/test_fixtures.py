"""The worked examples of the blueprint: one synthetic batch and one bar with four price levels."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features as X
from tidemark.sources.schemas import CANDLE_COLUMNS, ORDER_FLOW_COLUMNS, TRADE_AMOUNT_COLUMNS

T0 = dt.datetime(2024, 1, 2, 9, 30)
COLUMNS = "period int, security string, bar timestamp_ntz, trad_time timestamp_ntz, price double, volume double, bid_seq long, offer_seq long, side int, seq long"
LEVELS = [(1, 10.00, 100, 5, 1), (1, 10.01, 200, 5, 2), (-1, 10.01, 50, 3, 6), (-1, 10.00, 400, 4, 6), (1, 10.02, 300, 8, 7), (-1, 9.99, 100, 1, 9)]


@pytest.fixture(scope="module")
def one_bar(spark):
    rows = [(1, "A", T0, T0 + dt.timedelta(milliseconds=i), p, float(v), b, o, s, i) for i, (s, p, v, b, o) in enumerate(LEVELS)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def batches(spark):
    rows = []
    for r in range(1, 4):
        for k in range(3):
            for i in range(100):
                at = T0 + dt.timedelta(minutes=r)
                rows.append((1, f"S{k}", at, at + dt.timedelta(milliseconds=i), k + 1.0, 10.0, 0, 0, i % 2, i))
    return spark.createDataFrame(rows, COLUMNS)


def values(df, names):
    r = df.collect()
    assert len(r) == 1
    return [r[0][n] for n in names]


def test_candle(one_bar):
    assert values(X.candle_stick(one_bar), CANDLE_COLUMNS) == pytest.approx([6, 3, 3, 1150, 600, 550, 11507.5, 6008.0, 5499.5, 9.99, 10.02, 10.00, 9.99])


@pytest.mark.parametrize(
    ("kind", "want"),
    [
        ("dollar", [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 6008.0, 5499.5, 2.39698577]),
        ("std", [0, 0, 0, 0, 4500.5, -0.00090868, -0.00090868, 6008.0, 0, 2.40062048, 0, 999.0, -0.00272604]),
        ("quantile", [0, 4500.5, -0.00090868, 0, 0, 0, -0.00090868, 3006.0, 0, 0.00181653, 3002.0, 999.0, 2.39607792]),
    ],
)
def test_trade_amount(one_bar, kind, want):
    assert values(X.trade_amount(one_bar, kind), TRADE_AMOUNT_COLUMNS) == pytest.approx(want, abs=1e-7)


def test_order_flow(one_bar):
    got = dict(zip(ORDER_FLOW_COLUMNS, values(X.order_flow(one_bar), ORDER_FLOW_COLUMNS), strict=True))
    want = {
        "Sv": 550, "Scjbs": 3, "Bv": 600, "Bcjbs": 3, "tradv": 1150, "cjbs": 6, "Samt": 5499.5, "Bamt": 6008.0, "tradamt": 11507.5,
        "Delta": 50, "cjbsDelta": 0, "DeltaStrength": 0.0434782609, "MaxDeltaStrength": 1, "MinDeltaStrength": -1, "DeltaStrength_avg": 0,
        "DeltaStrength_MinMaxRatio": -1, "cjbsDeltaStrength_MinMaxRatio": -1, "SD_ratio_avg": 2.5, "SD_ratio_max": 6, "SD_ratio_min": 0.5, "SD_ratio": 0.8461538462,
        "SDcjbs_ratio_avg": 1, "SDcjbs_ratio": 0, "S_equilibrium": 0, "D_equilibrium": 1, "S_equilibrium_P": None, "D_equilibrium_P": 10.02, "D_equilibrium_ratio": 0.25,
        "D_equilibrium_count": 0, "POC": 10.00, "SPOC": 10.00, "BPOC": 10.02, "cjbsPOC": 10.00, "ScjbsPOC": 9.99, "BcjbsPOC": 10.00, "S_orderDecay": 0.25, "D_orderDecay": 1.5,
        "Scjbs_orderDecay": 1, "Dcjbs_orderDecay": 1, "S_decaySlope": -65, "D_decaySlope": 100, "Scjbs_decaySlope": -0.3, "Dcjbs_decaySlope": 0.3, "Svwap": 9.9990909091, "Bvwap": 10.0133333333,
    }
    for k, v in want.items():
        assert got[k] is None if v is None else got[k] == pytest.approx(v, abs=1e-8), k


def test_order_flow_big_is_one_sided(one_bar):
    assert values(X.order_flow(one_bar, "big"), ORDER_FLOW_COLUMNS) == [None] * 68


def test_order_flow_small(one_bar):
    got = dict(zip(ORDER_FLOW_COLUMNS, values(X.order_flow(one_bar, "small"), ORDER_FLOW_COLUMNS), strict=True))
    want = {"Delta": 150, "DeltaStrength": 0.1428571429, "MinDeltaStrength": -0.6, "DeltaStrength_avg": 0.3333333333, "SD_ratio_avg": 3.25, "S_equilibrium": 0, "D_equilibrium": 1, "S_orderDecay": 8, "D_orderDecay": 1.5, "S_decaySlope": -200, "D_decaySlope": 100, "Svwap": 10.0011111111}
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-8), k
    assert got["DeltaStrength_MinMaxRatio"] is None and got["cjbsDeltaStrength_MinMaxRatio"] is None and got["Dcjbs_decaySlope"] is None


def test_synthetic_batch(batches):
    debug = {(r["security"], r["bar"]): r for r in X.debug_trade(batches).collect()}
    for k in range(3):
        for r in range(1, 4):
            row = debug[f"S{k}", T0 + dt.timedelta(minutes=r)]
            assert (row["amount"], row["count"], row["term_count"]) == (1000.0 * (k + 1), 100.0, float(r))
    candle = X.candle_stick(batches).filter("security = 'S1'").first()
    assert [candle[c] for c in CANDLE_COLUMNS] == [100, 50, 50, 1000, 500, 500, 2000, 1000, 1000, 2, 2, 2, 2]
    for size in (None, "big", "small"):
        flow = X.order_flow(batches, size).filter("security = 'S2'").orderBy("bar").collect()
        assert [r["CumTradv"] for r in flow] == [1000, 2000, 3000]
        assert (flow[0]["POC"], flow[0]["Svwap"], flow[0]["S_orderDecay"], flow[0]["S_decaySlope"]) == (3, 3, None, None)
    assert X.order_flow(batches, "big", threshold_base="order").filter("Sv IS NOT NULL").count() == 0
    chg = [r["smallOrderchg"] for r in X.trade_amount(batches, "dollar").filter("security = 'S0'").orderBy("bar").collect()]
    assert chg == pytest.approx([math.log(2), 0, 0])


def test_one_order_std(spark):
    row = (1, "A", T0, T0, 10.0, 5.0, 2, 1, 1, 0)
    got = values(X.trade_amount(spark.createDataFrame([row], COLUMNS), "std"), TRADE_AMOUNT_COLUMNS)
    assert got[:10] == [0] * 10 and got[10] == 50.0


def test_empty_bars(spark, one_bar):
    bars = [T0, T0 + dt.timedelta(minutes=1)]
    grid = spark.createDataFrame([(1, s, b, 7.5) for s in ("A", "B") for b in bars], "period int, security string, bar timestamp_ntz, prev_close double")
    candle = {(r["security"], r["bar"]): [r[c] for c in CANDLE_COLUMNS] for r in X.candle_stick(one_bar, grid).collect()}
    assert candle["A", bars[1]] == [0] * 11 + [9.99, 9.99]
    assert candle["B", bars[0]] == [0] * 11 + [7.5, 7.5]
    flow = {(r["security"], r["bar"]): r["Sv"] for r in X.order_flow(one_bar, None, grid).collect()}
    assert flow["B", bars[0]] is None and flow["A", T0] == 550
    amount = X.trade_amount(one_bar, "std", grid).filter("security = 'B'").first()
    assert [amount[c] for c in TRADE_AMOUNT_COLUMNS] == [0] * 13


def test_compat_price_filter(spark):
    rows = [(1, "A", T0, T0, 0.0, 9.0, 2, 1, 1, 0), (1, "A", T0, T0, 5.0, 2.0, 2, 1, 1, 1)]
    df = spark.createDataFrame(rows, COLUMNS)
    assert X.candle_stick(df).first()["cjb"] == 1
    row = X.candle_stick(df, price_filter="compat").first()
    assert (row["cjb"], row["bcjb"], row["openprice_nfq"], row["volume_nfq"]) == (2, 1, 0.0, 2.0)


def test_bands_add_up(spark):
    from tidemark.plans import proxy

    t = proxy.trades(spark, "/root/testdata/sf0.001")
    total = {(r["security"], r["bar"]): r["a"] for r in t.groupBy("security", "bar").agg(F.sum(F.col("price") * F.col("volume")).alias("a")).collect()}
    for kind in ("dollar", "std", "quantile"):
        for r in X.trade_amount(t, kind).collect():
            parts = [r[c] for c in TRADE_AMOUNT_COLUMNS if c.endswith("Amt")]
            assert sum(parts) == pytest.approx(total[r["security"], r["bar"]])
    for r in X.order_flow(t).filter("Sv IS NOT NULL").collect():
        assert r["MinDeltaStrength"] <= r["DeltaStrength_avg"] <= r["MaxDeltaStrength"] and 1 <= r["POC"] <= 11


@pytest.mark.parametrize("name", ["order_flow_min", "order_flow_min_small", "trade_amount_dollar"])
def test_tasks_go_with_rows(batches, monkeypatch, name):
    """More trades make more tasks, not larger ones, with the same rows."""
    from tidemark.functions import grouping as G

    rows = lambda df: sorted(str(r) for r in df.collect())
    few = rows(X.FEATURES[name](batches))
    monkeypatch.setattr(G, "TASK_ROWS", 30)
    many = X.FEATURES[name](batches)
    assert many.rdd.getNumPartitions() == 30 and rows(many) == few
