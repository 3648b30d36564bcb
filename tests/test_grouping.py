"""Exact quantiles of heavy groups against ``percentile``."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import grouping as G


@pytest.mark.parametrize("distinct", [False, True])
def test_quantiles_of_heavy_groups(spark, distinct):
    df = spark.range(0, 20_000, 1, 8).selectExpr(
        "if(id % 3 = 0, 'hot', if(id % 1999 = 1, null, cast(id % 7 as string))) AS g", "id % 2 AS h",
        "case when id % 50 = 0 then null when id % 51 = 0 then double('nan') when id % 3 = 0 then pow(id * 7919 % 20011, 3) when id % 7 = 2 then 4.0 else id * 31 % 101 / 7.0 end AS x",
    )
    for p in (0.0, 0.5, 0.953, 1.0):
        got = {(r["g"], r["h"]): r["q"] for r in G.quantiles_of_heavy(df, ["g", "h"], "x", p, distinct, few=20).collect()}
        x = F.expr(f"percentile({'DISTINCT' if distinct else ''} nanvl(x, cast(null as double)), {p})")
        want = {(r["g"], r["h"]): r["q"] for r in df.groupBy("g", "h").agg(x.alias("q")).filter("q IS NOT NULL").collect()}
        assert got == pytest.approx(want, rel=1e-12) and len(got) == 18
    assert G.quantiles_of_heavy(df.filter("false"), ["g"], "x", 0.5).count() == 0


def test_statistics_of_constant_groups(spark):
    """Groups in which one side is constant have no correlation, and no error in ANSI mode."""
    rows = [("y", float(i), 5.0) for i in range(4)] + [("x", 2.0, float(i)) for i in range(4)] + [("one", 1.0, 1.0)] + [("both", float(i), 3.0 * i) for i in range(4)]
    got = spark.createDataFrame(rows, "g string, x double, y double").groupBy("g").agg(G.correlation("y", "x").alias("r"), G.slope("y", "x").alias("b"))
    got = {r["g"]: (r["r"], r["b"]) for r in got.collect()}
    assert got == {"y": (None, None), "x": (None, None), "one": (None, None), "both": (pytest.approx(1.0), pytest.approx(3.0))}


def test_quantiles_beside_rows_are_those_of_duckdb(spark):
    """To the last bit, as rows are compared with them."""
    import random

    import duckdb

    r = random.Random(3)
    rows = [(g, float(r.randrange(1, 550))) for g in range(400) for _ in range(r.randrange(1, 40))] + [(0, None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (g INT, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    df = spark.createDataFrame(rows, "g int, x double")
    for distinct in (False, True):
        got = G.with_quantiles(df, ["g"], "x", {"a": 0.95, "b": 0.99}, distinct).groupBy("g").agg(F.max("a"), F.max("b"), F.count("*")).collect()
        of = "DISTINCT " if distinct else ""
        want = con.execute(f"SELECT g, quantile_cont({of}x, 0.95), quantile_cont({of}x, 0.99), count(*) FROM t GROUP BY g").fetchall()
        assert sorted(map(tuple, got)) == sorted(want) and len(want) == 400
