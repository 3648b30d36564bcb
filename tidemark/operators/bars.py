"""Bars and periods: which bar a trade belongs to, the session's spine, dense output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import vector as V

#: The call auction's bar and the opening bar end here; minute bars follow.
AUCTION, OPEN = "09:25:00", "09:30:00"
SESSIONS = (("09:30:00", "11:30:00"), ("13:00:00", "15:00:00"))


def session_bar(at: Column) -> Column:
    """The bar of a time: up to 09:25, up to 09:30, then right-closed minutes."""
    day = F.date_trunc("DAY", at).cast("timestamp_ntz")
    auction, opening = (F.timestamp_add("SECOND", F.lit(s), day) for s in (33_900, 34_200))
    return F.when(at <= auction, auction).when(at <= opening, opening).otherwise(V.bar_end(at))


def first_open(ms: int) -> int:
    """The first bar of ``session_bar`` that ends after a time; both in milliseconds of wall-clock time since 1970."""
    day, rest = divmod(ms, 86_400_000)
    for end in (33_900_000, 34_200_000):
        if rest < end:
            return day * 86_400_000 + end
    return (ms // 60_000 + 1) * 60_000


def spine(spark: SparkSession, day: str, sessions=SESSIONS) -> DataFrame:
    """(bar, bar_no) of a day: auction, opening, then every minute of the sessions."""
    parts = [spark.sql(f"SELECT explode(array(timestamp_ntz'{day} {AUCTION}', timestamp_ntz'{day} {OPEN}')) AS bar")]
    for lo, hi in sessions:
        parts.append(spark.sql(f"SELECT explode(sequence(timestamp_ntz'{day} {lo}' + interval 1 minute, timestamp_ntz'{day} {hi}', interval 1 minute)) AS bar"))
    bars = parts[0]
    for p in parts[1:]:
        bars = bars.unionByName(p)
    return bars.withColumn("bar_no", F.row_number().over(Window.orderBy("bar")))


def period_of(bars: DataFrame, periods: list[int], phase: str = "clock") -> DataFrame:
    """(bar, period, period_end): ``clock`` counts minutes from midnight, ``counter`` bars of the day; a period that isn't full has no end then."""
    many = bars.withColumn("period", F.explode(F.lit(periods)))
    if phase == "clock":
        return many.select("bar", "period", V.period_end("bar", F.col("period")).alias("period_end"))
    no = (F.ceil(F.col("bar_no") / F.col("period")) * F.col("period")).cast("int").alias("end_no")
    ends = bars.select(F.col("bar_no").alias("end_no"), F.col("bar").alias("period_end"))
    return many.select("bar", "period", no).join(ends, "end_no").select("bar", "period", "period_end")


def keyed(trades: DataFrame, periods: list[int], bar: Column | None = None, phase: str = "clock", bars: DataFrame | None = None, period_input: str = "accumulated") -> DataFrame:
    """Trades with (period, bar), once for each period.

    ``period_input="last_minimum"`` keeps only the last minute of each period.
    The counter phase and gaps need the ``bars`` (bar, bar_no) of the day.
    """
    got = trades.withColumn("minute_bar", session_bar(F.col("trad_time")) if bar is None else bar)
    if phase == "clock":
        got = got.withColumn("period", F.explode(F.lit(periods))).withColumn("bar", V.period_end("minute_bar", F.col("period")))
    else:
        ends = period_of(bars, periods, phase).select(F.col("bar").alias("minute_bar"), "period", F.col("period_end").alias("bar"))
        got = got.join(ends, "minute_bar")
    if period_input == "last_minimum":
        got = got.filter(F.col("minute_bar") == F.col("bar"))
    return got.drop("minute_bar")


def gap_merged(bars: DataFrame, active: DataFrame) -> DataFrame:
    """(bar, fires_at): a bar fires only if the minute before it had messages; others are collected with the next that fires."""
    w = Window.orderBy("bar")
    known = bars.join(active.select("bar").distinct().withColumn("on", F.lit(True)), "bar", "left")
    fires = F.when(F.col("bar_no") <= 2, F.col("bar")).when(F.col("on") & (F.lag("on").over(w) | (F.col("bar_no") == 3)), F.col("bar"))
    known = known.withColumn("f", fires)
    ahead = F.first("f", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return known.select("bar", ahead.alias("fires_at"))


def dense(features: DataFrame, universe: DataFrame, ends: DataFrame) -> DataFrame:
    """Every security of the universe at every (period, bar) of ``ends``, with its features or NULLs.

    The bars of a day, some hundreds, travel as one array to the universe, which stays where it is.
    """
    all_ends = ends.select("period", "bar").distinct().agg(F.collect_list(F.struct("period", "bar")).alias("_ends"))
    each = universe.select("security", "prev_close", "row_no").crossJoin(all_ends)  # one row on the right
    grid = each.select("security", "prev_close", "row_no", F.explode("_ends").alias("_e")).select("_e.period", "_e.bar", "security", "prev_close", "row_no")
    return grid.join(features, ["period", "security", "bar"], "left")


def only_traced(trades: DataFrame, universe: DataFrame) -> DataFrame:
    """Trades of the universe's securities."""
    return trades.join(universe.select("security"), "security", "left_semi")


def after(at: Column, time: str) -> Column:
    """Whether a time of day, to the microsecond, is later than ``time`` (HH:mm:ss)."""
    return F.date_format(at, "HH:mm:ss.SSSSSS") > F.lit(f"{time}.000000")


def looked_up(rows: DataFrame, universe: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of the universe's securities with ``columns`` of it; one row of the universe a security."""
    return rows.join(universe.select("security", *columns), "security")


def next_bar_if_late(events: DataFrame, keys: list[str], arrival: list[str], bar: str = "bar") -> DataFrame:
    """``collected``: an event that arrives after its bar was closed by a later one goes to that later bar."""
    seen = F.max(bar).over(Window.partitionBy(*keys).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("collected", seen)
