"""Exact top-k search by distributed histogram selection.

All scores of a query form one multiset spread over the cluster.  Each pass
scores every block of candidates against every block of queries, counts the
scores of each query in bins of a window that is known to hold its kth
score, and adds the counts up; the window shrinks to the bin that holds the
kth value, until one integer is left.  Then the candidates that reach it are
ranked, ties by the smaller id.  A task counts only bins at or above its own
kth score of a query, since the global kth can't lie below it, so it sends k
counts a query at most.  The windows stand in a table in the shared folder,
written anew in each pass.

Queries are worked on in groups of ``GROUP_BYTES``, the only thing that is
broadcast; candidates stay where they are and are read once a pass.

Defined cases: a vector that is null or holds a null, NaN or infinity takes
no part, nor does a row without an id; vectors of different lengths are
compared as if zero-padded; an empty vector scores 0; a query id that occurs
in several rows is asked once, with its smallest vector, and none of those
rows is its candidate; repeated candidate rows each take a rank; an empty
table gives an empty result; extra columns are ignored.  Scores must fit a
64-bit integer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import shared

SCALE = 1024
EVERY = 100
#: Vectors in a block of queries, and of candidates.
QUERY_BLOCK = 512
BLOCK = 4096
BINS = 256
#: Bytes of query blocks that are broadcast at a time.
GROUP_BYTES = 32 << 20


_BLOCK_OF = "{0}_ids binary, {0}_rows binary, {0}_width int, {0}_kind string"


def _packed(ids, vectors, scale: float) -> list[pa.Array]:
    """Ids and the matrix of floor(scale * x) in the narrowest integers, short vectors padded with zeros, as bytes."""
    width = max(map(len, vectors), default=0)
    m = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        m[i, : len(v)] = np.floor(np.asarray(v, np.float64) * scale)
    kind = next(k for k in ("i2", "i4", "i8") if not m.size or (m.min() >= np.iinfo(k).min and m.max() <= np.iinfo(k).max))
    return [pa.array([np.asarray(ids, np.int64).tobytes()], pa.binary()), pa.array([m.astype(kind).tobytes()], pa.binary()), pa.array([width], pa.int32()), pa.array([kind])]


def _query_block(scale: float):
    def run(table: pa.Table) -> pa.Table:
        packed = _packed(table["vec_id"].to_numpy(), table["embedding"].to_numpy(), scale)
        return pa.Table.from_arrays([*packed, table["qb"].slice(0, 1)], names=["q_ids", "q_rows", "q_width", "q_kind", "qb"])

    return run


def _candidate_blocks(scale: float):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                x = batch.slice(i, BLOCK)
                packed = _packed(x.column(0).to_numpy(), x.column(1).to_numpy(zero_copy_only=False), scale)
                yield pa.RecordBatch.from_arrays(packed, names=["c_ids", "c_rows", "c_width", "c_kind"])

    return run


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products; in float64 where every partial sum is exact, else in int64."""
    width = max(q.shape[1], c.shape[1])
    q, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, c))
    if width and q.size and c.size and float(np.abs(q.astype(np.float64)).max()) * float(np.abs(c.astype(np.float64)).max()) * width >= 2.0**53:
        return q.astype(np.int64) @ c.T.astype(np.int64)
    return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)


def _scored(row):
    """Of a pair of blocks: query ids, candidate ids, scores, and which of them count (a query's own row doesn't)."""
    q_ids, c_ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["c_ids"], np.int64)
    q = np.frombuffer(row["q_rows"], row["q_kind"]).reshape(len(q_ids), row["q_width"])
    c = np.frombuffer(row["c_rows"], row["c_kind"]).reshape(len(c_ids), row["c_width"])
    s, ok = scores(q, c), q_ids[:, None] != c_ids[None, :]
    return q_ids, c_ids, s, ok


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}


def _kth(s: np.ndarray, ok: np.ndarray, k: int) -> list[int | None]:
    low = np.iinfo(np.int64).min
    if s.shape[1] < k:
        return [None] * len(s)
    part = np.partition(np.where(ok, s, low), s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    return [int(x) if n >= k else None for x, n in zip(part, ok.sum(1), strict=True)]


def search(queries: DataFrame, candidates: DataFrame, k: int, scale: float = SCALE, bins: int = BINS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The k best of ``candidates`` (vec_id, embedding) for each of ``queries``: query_id, rank, vec_id, score."""
    sound = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    def clean(df):
        df = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        return df.filter(sound)

    asked = clean(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    by = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int")
    q = shared.stored(asked.withColumn("qb", by).groupBy("qb").applyInArrow(_query_block(scale), _BLOCK_OF.format("q") + ", qb int"))
    c = shared.stored(shared.mapped(clean(candidates), _candidate_blocks(scale), _BLOCK_OF.format("c")))
    largest = q.agg(F.max(F.length("q_rows") + F.length("q_ids"))).first()[0] or 1
    per_group = max(1, group_bytes // largest)
    found = [_searched(q.filter((F.col("qb") >= lo) & (F.col("qb") < min(lo + per_group, n_blocks))), c, lo, min(lo + per_group, n_blocks), k, bins) for lo in range(0, n_blocks, per_group)]
    out = found[0] if len(found) == 1 else shared.stored(found[0])
    for more in found[1:]:
        out = out.unionByName(shared.stored(more))
    return out


def _searched(q: DataFrame, c: DataFrame, lo: int, hi: int, k: int, bins: int) -> DataFrame:
    """The search for one group of query blocks, numbered from ``lo`` to before ``hi``, small enough to be broadcast."""
    # every block of the stated query set meets every block of candidates
    pairs = c.withColumn("qb", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1)))).join(F.broadcast(q), "qb")

    # a first window: the scores' range, by each block pair
    def ranges(batches):
        for row in _rows(batches):
            q_ids, _, s, ok = _scored(row)
            n = ok.sum(1)
            lo = np.where(ok, s, np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max)
            hi = np.where(ok, s, np.iinfo(np.int64).min).max(1, initial=np.iinfo(np.int64).min)
            kth = [x if x is not None else int(y) for x, y in zip(_kth(s, ok, k), lo, strict=True)]
            full = [x >= k for x in n]
            keep = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (q_ids, n.astype(np.int64), lo, hi, np.asarray(kth, np.int64), np.asarray(full))], names=["query_id", "n", "lo", "hi", "kth", "full"])

    seen = shared.mapped(pairs, ranges, "query_id long, n long, lo long, hi long, kth long, full boolean")
    # the global kth is no lower than any block's kth, and no lower than the least score
    window = seen.groupBy("query_id").agg(F.sum("n").alias("n"), F.greatest(F.min("lo"), F.max(F.when(F.col("full"), F.col("kth")))).alias("lo"), F.max("hi").alias("hi"))
    # read back from its files, so that its estimated size stays that of the files from pass to pass
    window = shared.stored(window.withColumn("above", F.lit(0).cast("long")).withColumn("k", F.least(F.lit(k).cast("long"), "n")))
    ids_of = shared.stored(_ids_of(q))
    while True:
        wide = window.filter(F.col("lo") < F.col("hi"))
        if wide.isEmpty():
            break
        per_block = ids_of.join(wide, "query_id").groupBy("qb").agg(F.collect_list(F.struct("query_id", "lo", "hi")).alias("w"))

        def count(batches):
            for row in _rows(batches):
                q_ids, _, s, ok = _scored(row)
                at = {int(x): i for i, x in enumerate(q_ids)}
                kth, out = _kth(s, ok, k), ([], [], [])
                for w in row["w"]:
                    i, lo, hi = at[w["query_id"]], w["lo"], w["hi"]
                    step = -(-(hi - lo + 1) // bins)
                    floor = lo if kth[i] is None else max(lo, kth[i])
                    x = s[i][ok[i] & (s[i] >= floor) & (s[i] <= hi)]
                    b, m = np.unique((x - lo) // step, return_counts=True)
                    if kth[i] is not None and kth[i] > lo and kth[i] <= hi and len(b):
                        # the lowest bin may hold scores below the block's own kth; count it whole
                        first = (kth[i] - lo) // step
                        m[b == first] = int((ok[i] & (s[i] >= lo + first * step) & (s[i] < lo + (first + 1) * step) & (s[i] <= hi)).sum())
                    out[0].extend([w["query_id"]] * len(b))
                    out[1].extend(b.tolist())
                    out[2].extend(m.tolist())
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["query_id", "bin", "m"])

        # the windows of one group of queries go to every task, like the queries themselves
        counts = shared.mapped(pairs.join(F.broadcast(per_block), "qb"), count, "query_id long, bin long, m long").groupBy("query_id", "bin").agg(F.sum("m").alias("m"))
        # bins from the top until k scores are reached; at most ``bins`` rows a query
        down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        reached = counts.withColumn("run", F.sum("m").over(down)).join(window, "query_id").filter(F.col("above") + F.col("run") >= F.col("k"))
        reached = reached.groupBy("query_id").agg(F.max(F.struct("bin", "m", "run")).alias("f")).select("query_id", "f.*")
        step = F.expr(f"cast(ceil((hi - lo + 1) / cast({bins} as decimal(20, 0))) as bigint)")
        narrowed = window.join(reached, "query_id", "left").select(
            "query_id",
            "n",
            F.when(F.col("bin").isNull(), F.col("lo")).otherwise(F.col("lo") + F.col("bin") * step).alias("lo"),
            F.when(F.col("bin").isNull(), F.col("hi")).otherwise(F.least("hi", F.col("lo") + (F.col("bin") + 1) * step - 1)).alias("hi"),
            F.when(F.col("bin").isNull(), F.col("above")).otherwise(F.col("above") + F.col("run") - F.col("m")).alias("above"),
            "k",
        )
        before, window = window, shared.stored(narrowed)
        shared.removed(before)

    floors = ids_of.join(window, "query_id").groupBy("qb").agg(F.collect_list(F.struct("query_id", "lo")).alias("w"))

    def reach(batches):
        for row in _rows(batches):
            q_ids, c_ids, s, ok = _scored(row)
            at = {int(x): i for i, x in enumerate(q_ids)}
            out = ([], [], [])
            for w in row["w"]:
                i = at[w["query_id"]]
                hit = np.flatnonzero(ok[i] & (s[i] >= w["lo"]))
                hit = hit[np.lexsort((c_ids[hit], -s[i][hit]))][:k]
                out[0].extend([w["query_id"]] * len(hit))
                out[1].extend(c_ids[hit].tolist())
                out[2].extend(s[i][hit].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["query_id", "vec_id", "score"])

    best = shared.mapped(pairs.join(F.broadcast(floors), "qb"), reach, "query_id long, vec_id long, score long")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _ids_of(q: DataFrame) -> DataFrame:
    """The query ids of each block."""

    def ids(batches):
        for row in _rows(batches):
            x = np.frombuffer(row["q_ids"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), row["qb"])), pa.array(x)], names=["qb", "query_id"])

    return shared.mapped(q.select("qb", "q_ids"), ids, "qb long, query_id long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every vec_id divisible by 100 against all rows, 10 best each."""
    vectors = shared.table(spark, sf_dir, "embeddings")
    return search(vectors.filter(F.col("vec_id") % EVERY == 0), vectors, 10)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
