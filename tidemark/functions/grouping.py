"""Grouped aggregates, their row-aligned (transform) forms, and statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.vector import Name, col, safe_divide
from tidemark.sources.sinks import scratch

KINDS = ("count", "sum", "max", "min", "first", "last", "mean")


def _aggregate(kind: str, value: str, order: list[str]) -> Column:
    # one column of a plain type keeps the hash aggregate
    by = F.col(order[0]) if len(order) == 1 else F.struct(*order) if order else None
    return {
        "count": lambda: F.count(F.lit(1)),
        "count_as_double": lambda: F.count(F.lit(1)).cast("double"),
        "sum": lambda: F.sum(value),
        "max": lambda: F.max(value),
        "min": lambda: F.min(value),
        "first": lambda: F.min_by(value, by),
        "last": lambda: F.max_by(value, by),
        "mean": lambda: F.avg(value),
    }[kind]()


def aggregate(df: DataFrame, keys: list[str], value: str, order: list[str], kinds=KINDS) -> DataFrame:
    """One row a group; first and last follow ``order``, which must be unique."""
    return df.groupBy(*keys).agg(*(_aggregate(k, value, order).alias(f"{value}_{k}") for k in kinds))


def transform(df: DataFrame, keys: list[str], value: str, order: list[str], kinds=KINDS) -> DataFrame:
    """The same aggregates beside every row of the group; joined from one partial aggregation, so a large group isn't sorted in one task."""
    per = aggregate(df, keys, value, order, kinds)
    safe = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    on = safe[0]
    for more in safe[1:]:
        on &= more
    per = per.select(*(F.col(k).alias(f"_{k}") for k in keys), *(f"{value}_{k}" for k in kinds))
    return df.join(per, on).drop(*(f"_{k}" for k in keys))


#: Rows that one task sorts or groups; more of them make more tasks.
TASK_ROWS = 200_000


def tasks(rows: int) -> int:
    """How many tasks so many rows ask for."""
    return math.ceil(rows / TASK_ROWS)


def exchanged(df: DataFrame, keys: list[str], n: int | None = None) -> DataFrame:
    """``df`` parted by ``keys`` into ``n`` tasks, else as many as its rows, counted first, ask for.

    So a task's share stays the same however large a table gets; adaptive
    execution, which goes by compressed bytes, leaves such an exchange alone.
    """
    n = tasks(df.count()) if n is None else n
    return spread(df, keys, n) if n > 1 else df.repartition(*keys)


def spread(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``df`` parted by ``keys`` into ``n`` tasks; as it is, where one task is enough for its rows."""
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *keys) if n > 1 else df


def quantile(x: Name, p) -> Column:
    """Exact, linear over (n - 1) p; 0 for no values."""
    return F.coalesce(F.percentile(col(x), p), F.lit(0.0))


def quantile_distinct(x: str, p: float, places: int = 8) -> Column:
    """Exact quantile of the distinct values, rounded; NULL and NaN don't count."""
    return F.expr(f"percentile(DISTINCT round(nanvl({x}, cast(null as double)), {places}), {p})")


#: Steps of a unit on which sums up to 2^37 are exact.
GRID = 65536.0


def on_grid(x: Column) -> tuple[Column, Column]:
    """A double as the nearest multiple of 1 / ``GRID`` and what is left.

    The sums of the former are exact, and those of the latter too small for
    their order to count, so the sum of both sums is the nearest double to the
    total whatever was added first.
    """
    near = F.when(F.abs(x) < 2.0**53, F.rint(x * F.lit(GRID)) / F.lit(GRID)).otherwise(x)
    return near, F.nanvl(x - near, F.lit(0.0))  # infinite ones have no rest


def _halves(x: Column) -> tuple[Column, Column]:
    """A double as the sum of two with half as many digits each."""
    big = x * F.lit(134217729.0)
    high = big - (big - x)
    return high, x - high


def interpolated(lo: Column, hi: Column, part: Column) -> Column:
    """lo (1 - part) + hi part, of which the first product isn't rounded by itself: a fused multiplication and addition, as in DuckDB, whose limits orders may equal."""
    rest = F.lit(1.0) - part
    a, b = lo * rest, hi * part
    (lo_high, lo_low), (rest_high, rest_low) = _halves(lo), _halves(rest)
    lost = lo_high * rest_high - a + lo_high * rest_low + lo_low * rest_high + lo_low * rest_low
    both = a + b
    of_b = both - a
    return both + (a - (both - of_b) + (b - of_b) + lost)


def with_quantiles(df: DataFrame, keys: list[str], value: str, ps: dict[str, float], distinct: bool = False) -> DataFrame:
    """Columns with the exact quantiles of each group (of its ``distinct`` values) beside its rows, from ranks in windows; NULL doesn't count."""
    in_order, everything = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last()), Window.partitionBy(*keys)
    place = F.when(F.col(value).isNotNull(), (F.dense_rank() if distinct else F.row_number()).over(in_order))
    got = df.withColumn("_place", place).withColumn("_many", F.max("_place").over(everything))
    at = {n: (F.col("_many") - 1) * F.lit(p) for n, p in ps.items()}
    ends = {}
    for n, x in at.items():
        ends |= {f"_{end}{n}": F.max(F.when(F.col("_place") == f(x) + 1, F.col(value))).over(everything) for end, f in (("lo", F.floor), ("hi", F.ceil))}
    got = got.withColumns(ends)
    got = got.withColumns({n: interpolated(F.col(f"_lo{n}"), F.col(f"_hi{n}"), x - F.floor(x)) for n, x in at.items()})
    return got.drop("_place", "_many", *ends)


def quantile_mod(x: str, p: float) -> Column:
    """Index n p counted from 1: the mean of two neighbours at a whole index, else the next value.  Holds the group in memory, so for bars, not for whole tables."""
    v = f"array_sort(collect_list({x}))"
    n = f"size({v}) * {p}"
    return F.expr(f"CASE WHEN size({v}) = 0 THEN 0D WHEN floor({n}) < 1 THEN element_at({v}, 1) WHEN {n} = floor({n}) AND floor({n}) < size({v}) THEN (element_at({v}, cast({n} as int)) + element_at({v}, cast({n} as int) + 1)) / 2 ELSE element_at({v}, cast(ceil({n}) as int)) END")


#: Bins of a window, and distinct values that are put in order at once.
BINS, FEW = 256, 1000
#: Groups whose windows are broadcast; some fifty bytes each.
SMALL = 10_000


def quantiles_of_heavy(df: DataFrame, keys: list[str], value: str, p: float, distinct: bool = False, few: int = FEW) -> DataFrame:
    """(keys, q): what ``quantile`` (or, of the ``distinct`` values, ``percentile``) gives, for groups of any size.

    Values are counted first.  Then each group's window, its range at first,
    is cut into ``BINS``, the bins' counts are added up over all tasks, and
    the window shrinks to the bins that hold the two ranks in question, until
    it holds ``few`` different values.  So no task holds a group's values.
    Counted values and windows stand in scratch tables; windows are broadcast
    up to ``SMALL`` groups.  NULL and NaN don't count; a group without values
    has no row; keys that are NULL form a group.
    """
    spark = df.sparkSession

    def written(x: DataFrame) -> DataFrame:
        at = scratch(spark)
        x.write.parquet(at)
        return spark.read.schema(x.schema).parquet(at)

    x = F.col("_x")
    rows = df.select(F.struct(*keys).alias("_key"), F.col(value).cast("double").alias("_x")).filter(x.isNotNull() & ~F.isnan(x))
    rows = written(rows.groupBy("_key", "_x").agg((F.lit(1) if distinct else F.count("*")).cast("long").alias("_n")))
    per = rows.groupBy("_key").agg(F.sum("_n").alias("_all"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count("*").alias("_several"))
    at = (F.col("_all") - 1) * F.lit(p)
    # ranks from 0: the two that a quantile lies between
    windows = written(per.select("_key", F.floor(at).alias("_rank"), (at - F.floor(at)).alias("_part"), "_lo", "_hi", F.lit(0).cast("long").alias("_below"), "_several"))
    hint = F.broadcast if windows.count() <= SMALL else lambda w: w
    before = lambda by: F.coalesce(F.sum("_n").over(Window.partitionBy("_key").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def inside() -> DataFrame:
        w = hint(windows.withColumnRenamed("_key", "_of"))
        return rows.join(w, rows["_key"].eqNullSafe(F.col("_of"))).filter(x.between(F.col("_lo"), F.col("_hi"))).drop("_of")

    wide = (F.col("_several") > few) & (F.col("_lo") < F.col("_hi"))
    while not windows.filter(wide).isEmpty():
        place = F.least(F.lit(BINS - 1), F.floor((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BINS)).cast("int")
        kept = ["_key", "_rank", "_part", "_below"]
        # what is narrow already stays in one bin
        bins = inside().groupBy(*kept, F.when(wide, place).otherwise(0).alias("_bin")).agg(F.sum("_n").alias("_n"), F.min("_x").alias("_from"), F.max("_x").alias("_to"), F.count("*").alias("_in"))
        bins = bins.withColumn("_first", F.col("_below") + before("_bin"))
        holds = (F.col("_first") <= F.col("_rank") + 1) & (F.col("_first") + F.col("_n") > F.col("_rank"))
        new = bins.filter(holds).groupBy("_key", "_rank", "_part").agg(F.min("_from").alias("_lo"), F.max("_to").alias("_hi"), F.min("_first").alias("_below"), F.sum("_in").alias("_several"))
        windows = written(new.select(*windows.columns))
    last = inside().withColumn("_first", F.col("_below") + before("_x"))
    value_at = lambda r: F.max(F.when((F.col("_first") <= r) & (F.col("_first") + F.col("_n") > r), x))
    got = last.groupBy("_key", "_part").agg(value_at(F.col("_rank")).alias("_a"), value_at(F.col("_rank") + 1).alias("_b"))
    return got.select("_key.*", (F.col("_a") + F.when(F.col("_part") > 0, F.col("_part") * (F.col("_b") - F.col("_a"))).otherwise(0.0)).alias("q"))


def std(x: Name) -> Column:
    """Sample deviation; NULL for one value."""
    return F.stddev_samp(col(x))


def correlation(x: Name, y: Name) -> Column:
    """Pearson correlation; NULL where either is constant."""
    # F.corr is worked out for every group before a condition around it counts, and divides by zero in ANSI mode
    return safe_divide(F.covar_samp(col(x), col(y)), F.stddev_samp(col(x)) * F.stddev_samp(col(y)))


def slope(y: Name, x: Name) -> Column:
    """Least-squares slope of y over x; NULL where either is constant or there is one row."""
    return F.when(F.var_samp(col(y)) > 0, safe_divide(F.covar_samp(col(y), col(x)), F.var_samp(col(x))))


def at_max(out: Name, by: Name, largest: Name) -> Column:
    """``out`` where ``by`` is ``largest`` (its maximum in the group, by a window); of several the smallest ``out``."""
    return F.min(F.when(col(by) == col(largest), col(out)))


def outer_merge(left: DataFrame, right: DataFrame, key: str, fill: float | None = 0.0) -> DataFrame:
    """All keys of both sides; values missing on one side become ``fill`` (None: NULL)."""
    out = left.join(right, key, "full_outer")
    return out if fill is None else out.fillna(fill, [c for c in out.columns if c != key])


def stacked(frames: list[DataFrame], columns: list[str], distinct: bool = False) -> DataFrame:
    """The rows of all frames below each other; each gives its columns in the order of ``columns``, by whatever names."""
    out = None
    for df in frames:
        df = df.toDF(*columns)
        out = df if out is None else out.unionByName(df)
    return out.distinct() if distinct else out


def running(x: Name, keys: list[str], order: list[str]) -> Column:
    """Running total within ``keys``."""
    return F.sum(col(x)).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def filled_forward(x: Name, keys: list[str], order: list[str]) -> Column:
    """The last value that isn't NULL in the rows before this one."""
    return F.last(col(x), ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
