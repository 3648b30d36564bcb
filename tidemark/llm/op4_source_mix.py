"""Mixing sources to target weights by the cube method.

Each source gets a target number of words.  Its rate, target over size, is
split into whole copies of every document and a fractional inclusion
probability.  The cube method then moves those probabilities, three
documents at a time, along the null space of two constraints (documents and
words of the source) until all but two of a block are 0 or 1.  Blocks are
dealt by a hash of the document, so no source, however large, meets in one
task; what the blocks leave open goes to the next, smaller level.  The last
two or fewer documents of a source are landed so that its words come nearest
to the target.

Defined cases: a null text or one without words has size 0 and is never
taken in part (its probability stays whole: it gets the whole copies of the
rate only); null sources form one source, ordered last; repeated rows are
separate documents, of which equal ones may be told apart by nothing, so the
result is the same whichever of them is taken; an empty table gives an empty
result; a source of size 0 has target 0; extra columns are dropped by ``mix``
and, of any name, pass through ``mixed``.

The table of sources is broadcast and worked out on the driver up to
``FEW_SOURCES``; beyond that targets come from repeated aggregates, and a
source of very many documents is joined apart (``join_by_key``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import shared

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
#: Documents that one task balances at a time.
BLOCK = 4096
#: Sources whose table is small enough for the driver and for a broadcast.
FEW_SOURCES = 100_000
#: A probability this near to 0 or 1 counts as decided.
EPS = 1e-9


def targets(sizes: list[int], weights: list[float], share: float = 1.0, cap: float = CAP) -> list[float]:
    """Split ``share`` of all sizes by weight; a target above ``cap`` times its size stops there and the rest is shared anew."""
    left, free, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        total = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / total > cap * sizes[i]}
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = cap * sizes[i]
        left -= sum(out[i] for i in over)
        free -= over
    return out


def flight(p: list[float], size: list[float], draw) -> None:
    """Flight phase, in place: while three documents are open, move them along the null vector of (1, size) until one is decided."""
    pool: list[int] = []
    for k in range(len(p)):
        if EPS < p[k] < 1 - EPS:
            pool.append(k)
        while len(pool) == 3:
            a, b, c = pool
            u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = min((1 - p[i]) / v if v > 0 else -p[i] / v for i, v in zip(pool, u, strict=True) if v)
            down = min(p[i] / v if v > 0 else (p[i] - 1) / v for i, v in zip(pool, u, strict=True) if v)
            step = up if draw() * (up + down) < down else -down
            for i, v in zip(pool, u, strict=True):
                p[i] = min(1.0, max(0.0, p[i] + step * v))
            pool = [i for i in pool if EPS < p[i] < 1 - EPS]
    for k in range(len(p)):
        if not EPS < p[k] < 1 - EPS:
            p[k] = float(round(p[k]))


def landing(p: list[float], size: list[float], short: float) -> None:
    """Decide the documents still open, at most two: the choice whose words come nearest to ``short``, ties to fewer."""
    open_ = [k for k in range(len(p)) if EPS < p[k] < 1 - EPS]
    best = min(range(1 << len(open_)), key=lambda m: (abs(sum(size[k] for j, k in enumerate(open_) if m >> j & 1) - short), m))
    for j, k in enumerate(open_):
        p[k] = float(best >> j & 1)


def _balance(last: bool):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("tie", "ascending"), ("size", "ascending"), ("doc_id", "ascending"), ("p", "ascending")])
        p, size = table["p"].to_pylist(), [float(x) for x in table["size"].to_pylist()]
        rng = np.random.default_rng([len(p), int(sum(size)) % (1 << 32), (table["tie"][0].as_py() or 0) % (1 << 32)])
        # what the block should take; decided documents of size 0 change nothing
        want = sum(x * y for x, y in zip(p, size, strict=True))
        flight(p, size, rng.random)
        if last:
            landing(p, size, want - sum(y for x, y in zip(p, size, strict=True) if x == 1.0))
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))

    return run


def _word_counts(batches):
    for batch in batches:
        n = np.zeros(batch.num_rows, np.int64)
        for t in shared.chunks(batch.column("text")):
            n[t.first : t.first + len(t)] = np.diff(shared.word_bounds(t)[2])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n)], names=[*batch.schema.names, "size"])


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``text``, without ``size``) with ``size``, the number of words of the text."""
    return shared.mapped(docs, _word_counts, T.StructType([*docs.schema.fields, T.StructField("size", T.LongType())]))


def key_of(column: str, kind: str = "string"):
    """A value as a string that is never null, so that null is a key of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast(kind).cast("string")), F.lit(""))


def plan(sizes: DataFrame, weights=WEIGHTS, share: float = 1.0, cap: float = CAP, few: int = FEW_SOURCES) -> DataFrame:
    """One row per source: key, source, docs, source_size, target, rate."""
    spark = sizes.sparkSession
    per = shared.stored(sizes.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("docs")))
    columns = "key string, source string, docs long, source_size long, target double, rate double"
    if per.count() <= few:
        by = sorted(((r["source"], r["n"] or 0, r["docs"]) for r in per.collect()), key=lambda x: (x[0] is None, x[0] or ""))
        t = targets([n for _, n, _ in by], [weights[i % len(weights)] for i in range(len(by))], share, cap)
        rows = [("" if s is None else f"={s}", s, d, n, x, x / n if n else 0.0) for (s, n, d), x in zip(by, t, strict=True)]
        return spark.createDataFrame(rows, columns)
    # Spark's own numbering of sorted rows: counts of partitions, then places
    placed = per.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(lambda x: (*x[0], x[1])).toDF("source string, n long, docs long, at long")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int"))
    free = shared.stored(placed.select("source", F.coalesce("n", F.lit(0)).alias("n"), "docs", weight.alias("w")))
    left, done = share * (free.agg(F.sum("n")).first()[0] or 0), []
    while True:
        total = free.agg(F.sum("w")).first()[0]
        over = free.filter(F.lit(left) * F.col("w") / F.lit(total) > cap * F.col("n")) if total else free
        if not total or over.isEmpty():
            break
        done.append(over.withColumn("target", cap * F.col("n")))
        taken = cap * over.agg(F.sum("n")).first()[0]
        free = shared.stored(free.filter(F.lit(left) * F.col("w") / F.lit(total) <= cap * F.col("n")))
        left -= taken
    out = free.withColumn("target", F.lit(left) * F.col("w") / F.lit(total or 1.0))
    for more in done:
        out = out.unionByName(more)
    rate = F.when(F.col("n") > 0, F.col("target") / F.col("n")).otherwise(0.0)
    return out.select(key_of("source").alias("key"), "source", "docs", F.col("n").alias("source_size"), "target", rate.alias("rate"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, cap: float = CAP, block: int = BLOCK, few: int = FEW_SOURCES) -> DataFrame:
    """``docs`` (doc_id, source, text) to doc_id, source, size, source_size, target, copies: how often the mix takes each document."""
    base = shared.stored(sized(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")).drop("text"))
    per = shared.stored(plan(base, weights, share, cap, few))
    small = per.count() <= few

    def with_source(rows: DataFrame, table: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(table.drop("docs")), "key") if small else shared.join_by_key(rows, table, ["key"], "docs")

    rated = with_source(base.withColumn("key", key_of("source")), per.drop("source"))
    whole = F.floor(F.col("rate") + F.lit(EPS))
    rated = rated.withColumn("whole", whole).withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - whole))
    rated = rated.withColumn("tie", F.xxhash64("doc_id", "source", "size"))
    open_ = rated.filter((F.col("p") > EPS) & (F.col("size") > 0))
    done = [rated.filter((F.col("p") <= EPS) | (F.col("size") <= 0)).withColumn("p", F.lit(0.0))]
    schema, level = open_.schema, 0
    while True:
        counts = shared.stored(open_.groupBy("key").agg(F.count("*").alias("docs")))
        most = counts.agg(F.max("docs")).first()[0] or 0
        if most <= block:
            done.append(open_.groupBy("key").applyInArrow(_balance(True), schema))
            break
        parts = counts.select("key", "docs", F.ceil(F.col("docs") / F.lit(block)).cast("int").alias("parts"))
        part = F.pmod(F.xxhash64("tie", F.lit(level)), F.col("parts")).alias("part")
        dealt = with_source(open_, parts).select(*schema.names, part)
        moved = shared.stored(dealt.groupBy("key", "part").applyInArrow(_balance(False), dealt.schema).select(*schema.names))
        decided = (F.col("p") <= EPS) | (F.col("p") >= 1 - EPS)
        done.append(moved.filter(decided))
        open_, level = moved.filter(~decided), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.round("p").cast("long")).alias("copies"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as ``mix`` takes it; equal keys are dealt their copies in order."""
    # the caller's columns travel in one, so that none of their names can clash
    rest = [f"`{c}`" for c in docs.columns if c != "text"]
    rows = docs.select("text", F.struct(*rest).alias("row"), key_of("doc_id", "long").alias("doc"), key_of("source").alias("from"))
    key = ["doc", "from", "size"]
    got = mix(docs, **how).select(key_of("doc_id", "long").alias("doc"), key_of("source").alias("from"), "size", "copies")
    got = got.groupBy(*key).agg(F.sort_array(F.collect_list("copies"), asc=False).alias("copies"))
    rows = sized(rows).withColumn("at", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("text"))))
    out = rows.join(got, key).withColumn("n", F.element_at("copies", F.col("at")).cast("int"))
    out = out.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("n"))))
    return out.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: doc_id, size, source_size, target, taken; more: source, copies."""
    got = mix(shared.table(spark, sf_dir, "documents"))
    return got.withColumn("taken", F.col("size") * F.col("copies"))


#: The cube method draws; SQL can't state its choice.
SQL = None
