"""From trades and a publish plan to one table a feature."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import grouping as G
from tidemark.operators import bars as B
from tidemark.operators import features as X
from tidemark.sources.config import Feature, publish_plan


def run_features(trades: DataFrame, universe: DataFrame, spec: list[Feature], bars: DataFrame | None = None, bar: Column | None = None, phase: str = "clock", period_input: str = "accumulated", keep: StorageLevel | None = None, **options) -> dict[str, DataFrame]:
    """Feature name to rows (period, security, bar, columns), dense over the universe if ``bars`` (bar, bar_no) are given.

    ``options``: keyword arguments by feature name.  The periods of one
    feature share one plan.  If its rows add up they are made of minute rows
    (counts, candles, orders or price levels), else every trade goes once to
    each period; trades outside the universe are dropped.  With ``keep`` the
    traced trades are exchanged once, by security and minute, and kept at that
    storage level: all features then share one scan and one exchange, and a
    lost part is made anew from its source.  User features count like any
    other once registered.
    """
    plan = publish_plan(spec, X.FEATURES)
    traced = B.only_traced(trades, universe).withColumn("minute", B.session_bar(F.col("trad_time")) if bar is None else bar)
    if keep is not None:
        traced = traced.repartition("security", "minute").persist(keep)
    out: dict[str, DataFrame] = {}
    many: int | None = None
    for f in spec:
        periods = [p for p, names in plan.by_period.items() if f.name in names]
        if not f.open or not periods:
            continue
        own, rows = dict(options.get(f.name, {})), traced
        if f.name in X.BUILT_IN and f.name.startswith(("trade_amount", "order_flow")) and "tasks" not in own:
            many = trades.count() if many is None else many
            own["tasks"] = G.tasks(many * len(periods))
        if f.name in X.MINUTES and len(periods) > 1 and period_input == "accumulated":
            rows = X.MINUTES[f.name](traced, ["security", "minute"], **own)
        keyed = B.keyed(rows, periods, F.col("minute"), phase, bars, period_input)
        grid = None
        if bars is not None:
            ends = B.period_of(bars, periods, phase).select("period", F.col("period_end").alias("bar")).distinct()
            grid = B.dense(traced.sparkSession.createDataFrame([], "period int, security string, bar timestamp_ntz"), universe, ends)
        out[f.name] = X.feature(f.name)(keyed, grid, **own).drop(X.STATE)
    return out


def completed(frames: list[DataFrame]) -> DataFrame:
    """(period, bar) that every exchange's frame has."""
    both = frames[0].select("period", "bar").distinct()
    for f in frames[1:]:
        both = both.join(f.select("period", "bar").distinct(), ["period", "bar"], "left_semi")
    return both
