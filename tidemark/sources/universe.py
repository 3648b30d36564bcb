"""The traced securities with their previous close."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Id prefixes of the SZ exchange.
SZ_PREFIXES = ("30", "00")


def exchange_of(security: Column) -> Column:
    """SZ or SH, by the id's prefix."""
    return F.when(F.substring(security, 1, 2).isin(*SZ_PREFIXES), "SZ").otherwise("SH")


#: Securities of a JSON text of ``to_json_parts``.
PART = 1000


def _numbered(rows: DataFrame) -> DataFrame:
    """(security, exchange, prev_close, row_no) of rows that have a ``block`` and a place ``at`` in it: sh ids first, in the order of blocks and places.

    Rows are counted by block first, so only the blocks, one in some thousand
    rows, are put in order at once.
    """
    blocks = rows.groupBy("exchange", "block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("exchange", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("exchange", "block").orderBy("at")) - 1
    got = rows.withColumn("_place", place).join(blocks.select("exchange", "block", before.alias("_before")), ["exchange", "block"])
    return got.select("security", "exchange", "prev_close", (F.col("_before") + F.col("_place")).cast("int").alias("row_no"))


def from_daily(daily: DataFrame, date_column: str, day: str) -> DataFrame:
    """(security, exchange, prev_close, row_no) from a wide table of closes, the row of ``day``; missing closes 0, sh ids first.

    A column holds a security, by its name, or, as a map from id to close, a
    block of them: a table with more securities than a schema can have columns
    comes as one row a day and block, blocks in the order of their least ids
    and ids in order within them.
    """
    kinds = dict(daily.dtypes)
    of_one = [c for c in daily.columns if c != date_column and not kinds[c].startswith("map")]
    of_many = [c for c in daily.columns if kinds[c].startswith("map")]
    row = daily.filter(F.col(date_column).cast("date") == F.lit(day).cast("date"))
    parts = []
    if of_one:
        pairs = F.array(*(F.struct(F.lit(c).alias("security"), F.col(f"`{c}`").cast("double").alias("prev_close"), F.lit(i).alias("at")) for i, c in enumerate(of_one)))
        parts.append(row.select(F.lit("").alias("block"), F.explode(pairs).alias("x")).select("block", "x.*"))
    for c in of_many:
        least = F.array_min(F.map_keys(f"`{c}`")).alias("block")
        each = row.select(least, F.posexplode(F.array_sort(F.map_entries(f"`{c}`"))).alias("at", "x"))
        parts.append(each.select("block", F.col("x")["key"].alias("security"), F.col("x")["value"].cast("double").alias("prev_close"), "at"))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    u = u.withColumn("exchange", exchange_of(F.col("security"))).withColumn("prev_close", F.coalesce(F.nanvl("prev_close", F.lit(0.0)), F.lit(0.0)))
    return _numbered(u)


def to_json(universe: DataFrame) -> str:
    """Ids and closes of both exchanges; the universe is a dimension of some thousand rows."""
    rows = universe.orderBy("row_no").collect()
    out: dict[str, list] = {}
    for e in ("sz", "sh"):
        own = [r for r in rows if r["exchange"] == e.upper()]
        out[e], out[f"{e}_closeprice"] = [r["security"] for r in own], [r["prev_close"] for r in own]
    return json.dumps(out)


def from_json(spark: SparkSession, text: str) -> DataFrame:
    """The universe of a JSON text; sh ids first."""
    spec, rows = json.loads(text), []
    for e in ("sh", "sz"):
        rows += [(s, e.upper(), float(c or 0), len(rows) + i) for i, (s, c) in enumerate(zip(spec[e], spec[f"{e}_closeprice"], strict=True))]
    return spark.createDataFrame(rows, "security string, exchange string, prev_close double, row_no int")


_TEXT = "sz array<string>, sh array<string>, sz_closeprice array<double>, sh_closeprice array<double>"


def to_json_parts(universe: DataFrame) -> DataFrame:
    """(part, value): what ``to_json`` gives in texts of ``PART`` securities each, made in tasks; for universes that are more than a dimension."""
    own = F.array_sort(F.collect_list(F.struct("row_no", "exchange", "security", "prev_close")))
    parts = universe.groupBy(F.floor(F.col("row_no") / PART).alias("part")).agg(own.alias("rows"))
    of = lambda e, field: F.transform(F.filter("rows", lambda r: r["exchange"] == e.upper()), lambda r: r[field])
    text = F.to_json(F.struct(*(of(e, field).alias(f"{e}{name}") for field, name in (("security", ""), ("prev_close", "_closeprice")) for e in ("sz", "sh"))))
    return parts.select("part", text.alias("value"))


def from_json_parts(texts: DataFrame) -> DataFrame:
    """The universe of (part, value); sh ids first."""
    spec = texts.select(F.col("part").alias("block"), F.from_json("value", _TEXT).alias("j"))
    rows = None
    for e in ("sh", "sz"):
        each = spec.select("block", F.posexplode(F.arrays_zip(F.col(f"j.{e}").alias("id"), F.col(f"j.{e}_closeprice").alias("close"))).alias("at", "x"))
        each = each.select("block", "at", F.col("x")["id"].alias("security"), F.lit(e.upper()).alias("exchange"), F.coalesce(F.col("x")["close"], F.lit(0.0)).alias("prev_close"))
        rows = each if rows is None else rows.unionByName(each)
    return _numbered(rows)
