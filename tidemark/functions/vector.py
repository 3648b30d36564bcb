"""Column functions.  Undefined values are NULL inside plans; only sinks write NaN."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

Name = Column | str


def col(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


def null_if_inf(x: Name) -> Column:
    """Infinite to NULL."""
    return F.when(F.abs(col(x)) == float("inf"), None).otherwise(col(x))


def null_if_nan(x: Name) -> Column:
    """NaN to NULL, so that it neither compares nor aggregates."""
    return F.when(F.isnan(col(x)), None).otherwise(col(x))


def zero_if_nan(x: Name) -> Column:
    """NaN and NULL to 0."""
    return F.coalesce(F.nanvl(col(x), F.lit(0.0)), F.lit(0.0))


def safe_divide(x: Name, y: Name) -> Column:
    """x / y, NULL where y is 0 or the quotient is infinite."""
    return null_if_inf(F.try_divide(col(x).cast("double"), col(y).cast("double")))


def ieee_divide(x: Name, y: Name) -> Column:
    """x / y as floating point has it: infinite over 0, NaN for 0 / 0."""
    x, y = col(x).cast("double"), col(y).cast("double")
    at_zero = F.when(x > 0, float("inf")).when(x < 0, float("-inf")).when(x == 0, float("nan"))
    return F.when(y == 0, at_zero).otherwise(F.try_divide(x, y))


def is_positive(x: Name, over: float = 0.0) -> Column:
    """Whether a number is known and larger than ``over``."""
    return F.coalesce(col(x) > over, F.lit(False))


def is_buy(side: Name = "side") -> Column:
    return col(side) == 1


def bands(x: Name, limits: dict[str, Name]) -> dict[str, Column]:
    """Which band a value lies in: ``limits`` descend; each band lies above its limit and up to the one before, the last one, ``small``, up to the last limit."""
    out, x = {}, col(x)
    limits = {n: F.lit(v) if isinstance(v, (int, float)) else col(v) for n, v in limits.items()}
    names = list(limits)
    for name, before in zip(names, [None, *names], strict=False):
        out[name] = x > limits[name] if before is None else (x > limits[name]) & (x <= limits[before])
    return out | {"small": x <= limits[names[-1]]}


def amount(price: Name = "price", volume: Name = "volume") -> Column:
    return col(volume) * col(price)


def log_return(price: Name, last: Name) -> Column:
    """ln(price + 1) - ln(last + 1); an unknown last price is 0, an undefined result 0."""
    return F.coalesce(null_if_nan(null_if_inf(F.ln(col(price) + 1) - F.ln(F.coalesce(col(last), F.lit(0.0)) + 1))), F.lit(0.0))


def rounded(x: Name, places: int = 8) -> Column:
    """Half away from zero."""
    return F.round(col(x), places)


def total(columns: list[Name]) -> Column:
    """Sum of several columns of a row."""
    return reduce(add, map(col, columns))


def sum_of_arrays(arrays: list[Name]) -> Column:
    """Element-wise sum of arrays of equal length."""
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), map(col, arrays))


def shifted(x: Name, by: int, over: WindowSpec, fill=None) -> Column:
    """Values moved down by ``by`` rows (up if negative), with ``fill`` at the edge."""
    fill = [] if fill is None else [fill]
    return (F.lag(col(x), by, *fill) if by >= 0 else F.lead(col(x), -by, *fill)).over(over)


def with_runs(df: DataFrame, flag: str, keys: list[str], order: list[str], out: str) -> DataFrame:
    """``out``: length so far of the run of equal ``flag`` values, times the flag (gaps and islands)."""
    over = Window.partitionBy(*keys).orderBy(*order)
    change = F.coalesce((F.col(flag) != F.lag(flag).over(over)).cast("int"), F.lit(1))
    df = df.withColumn("_c", change).withColumn("_i", F.sum("_c").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*keys, "_i").orderBy(*order)
    return df.withColumn(out, F.row_number().over(inside) * F.col(flag).cast("int")).drop("_c", "_i")


def side_of(bid: Name, offer: Name) -> Column:
    """1 where the bid came later, else -1."""
    return F.when(col(bid) > col(offer), 1).otherwise(-1)


def suffixed(security: Name, suffix: str, width: int = 11) -> Column:
    """Security id of fixed width whose last characters are the exchange's suffix."""
    n = width - len(suffix)
    return F.concat(F.rpad(F.substring(col(security), 1, n), n, "\0"), F.lit(suffix))


def bar_end(at: Name) -> Column:
    """End of the right-closed minute that holds a time."""
    return F.date_trunc("MINUTE", col(at) - F.expr("interval 1 microsecond")).cast("timestamp_ntz") + F.expr("interval 1 minute")


def period_end(bar: Name, minutes: int | Column) -> Column:
    """End of the ``minutes``-long right-closed period, counted from midnight, that ends at or after a bar's end."""
    minutes = F.lit(minutes) if isinstance(minutes, int) else minutes
    day = F.date_trunc("DAY", col(bar) - F.expr("interval 1 microsecond")).cast("timestamp_ntz")
    passed = F.timestamp_diff("MINUTE", day, col(bar))
    return F.timestamp_add("MINUTE", (F.ceil(passed / minutes) * minutes).cast("int"), day)


def time_of_day(text: Name) -> Column:
    """``hh:mm:ss.xxx`` as milliseconds since midnight; NULL if it isn't one."""
    s = col(text)
    part = lambda i, n: F.substring(s, i, n).try_cast("int")
    return ((part(1, 2) * 60 + part(4, 2)) * 60 + part(7, 2)).cast("long") * 1000 + F.coalesce(part(10, 3), F.lit(0))


def time_text(ms: Name) -> Column:
    """Milliseconds since midnight as ``hh:mm:ss.xxx``; the inverse of ``time_of_day``."""
    x = col(ms).cast("long")
    part = lambda by, n: F.pmod(F.floor(x / by), F.lit(n))
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(x / 3_600_000), part(60_000, 60), part(1000, 60), F.pmod(x, F.lit(1000)))


def same_minute(x: Name, y: Name) -> Column:
    """Whether two times lie in the same clock minute."""
    return F.date_trunc("MINUTE", col(x)) == F.date_trunc("MINUTE", col(y))


def next_minute(at: Name) -> Column:
    """Start of the clock minute after a time's."""
    return F.date_trunc("MINUTE", col(at)).cast("timestamp_ntz") + F.expr("interval 1 minute")


def passed(since: Name, until: Name, ms: int) -> Column:
    """Whether at least ``ms`` milliseconds lie between two times."""
    return F.timestamp_diff("MICROSECOND", col(since), col(until)) >= ms * 1000


def at_time(day: Name, text: Name) -> Column:
    """A day's wall-clock time ``hh:mm:ss.xxx``."""
    return F.timestamp_add("MILLISECOND", time_of_day(text), col(day).cast("timestamp_ntz"))


def packed(*parts: tuple[Name, int]) -> Column:
    """One long of several numbers, the first one leading, each in so many bits (63 in all); one that doesn't fit is an error."""
    out = None
    for x, bits in parts:
        x = col(x).cast("long")
        fits = F.when((x >= 0) & (x < 1 << bits), x).otherwise(F.raise_error(F.concat(F.lit(f"not in {bits} bits: "), x.cast("string"))).cast("long"))
        out = fits if out is None else F.shiftleft(out, bits) + fits
    return out


def file_stem(at: Name) -> Column:
    """``HH_MM_SS_mmm``."""
    return F.date_format(col(at), "HH_mm_ss_SSS")
