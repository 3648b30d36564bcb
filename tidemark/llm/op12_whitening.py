"""Embedding whitening by a randomised range finder.

A vector's entries become the integers floor(256 c).  The fit list holds each
distinct integer vector once, packed into blocks of rows; its covariance V is
never formed unless it must be.  A random orthonormal basis Q of a few more
columns than components wanted is multiplied by V in a pass over all centred
rows and made orthonormal again; this is repeated (power passes).  In every
pass the Rayleigh-Ritz step takes the eigenvectors of Q'VQ, and V's product
gives their residuals, so a component counts as found only when V u and e u
agree to ``TOLERANCE`` of the largest eigenvalue.  If after ``PASSES`` some
don't, the basis is expanded to the full dimension, where one more pass gives
V itself and Rayleigh-Ritz all of its eigenvectors.

A pass sends one matrix of dimension x basis columns from each task, cut into
slabs; they are added in two levels in a fixed order, so reruns agree.  Only
the sum, whose size is that of the dimension, comes to the driver.

Defined cases: rows whose vector is null or holds a null, NaN or infinity are
dropped; shorter vectors count as if zero-padded to the longest; equal
vectors count once in the fit, and each of their rows is returned, as are
rows without an id; components of equal eigenvalue may be any orthonormal
basis of their space, the same for all rows; directions without variance are
no components, so one distinct vector, or none, gives an empty result;
entries or deviations beyond 64 bits are an error; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import shared

SCALE = 256
COMPONENTS = 4
#: Columns of the basis beyond the components wanted, and passes before it is expanded to the full dimension.
OVERSAMPLE = 12
PASSES = 6
#: Largest residual of a component, as a share of the largest eigenvalue.
TOLERANCE = 1e-13
#: Eigenvalues up to this share of the largest are none.
NOTHING = 1e-12
#: Vectors in a block, and bytes of a slab of a matrix.
BLOCK = 4096
SLAB_BYTES = 1 << 18
#: Tasks whose slabs are added together first.
TOGETHER = 256
_SLABS = "slab int, task long, part long, m binary"


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): the rows without nulls, NaN and infinities in their vector, as integers."""
    each = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), each.alias("v"))
    rows = rows.filter(F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    whole = lambda c: F.when(F.abs(c * scale) < 2.0**63, F.floor(c * scale)).otherwise(F.raise_error(F.lit("an entry doesn't fit 64 bits")).cast("long"))
    return rows.select("vec_id", F.transform("v", whole).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, zero-padded to ``width``."""
    offsets, values = column.offsets.to_numpy(), column.flatten().to_numpy()
    offsets = offsets - offsets[0]
    n = np.diff(offsets)
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(column)), n), np.arange(len(values)) - np.repeat(offsets[:-1], n)] = values
    return out


def _blocks(width: int):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                m = _matrix(batch.column("x").slice(i, BLOCK), width)
                yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary())], names=["rows"])

    return run


class Fit:
    """The fit list's size, sums and components: unit columns ``u`` of eigenvalues ``e``, the trace, and the error of whitened's covariance."""

    def __init__(self, n: int, sums: np.ndarray):
        self.n, self.sums = n, sums
        self.u, self.e, self.trace, self.error = np.zeros((len(sums), 0)), np.zeros(0), 0.0, 0.0

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: 64-bit integers where they suffice, else Python's."""
        most = self.n * int(np.abs(x).max(initial=0)) + int(np.abs(self.sums).max(initial=0))
        return x * self.n - self.sums if most < 2**62 else x.astype(object) * self.n - self.sums

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(np.float64) / self.n

    def squares(self, x: np.ndarray) -> list[int]:
        """The exact sum of squared deviations of each row."""
        d = self.deviations(x)
        if d.dtype == object or d.size and int(np.abs(d).max()) ** 2 * d.shape[1] >= 2**63:
            d = d.astype(object)
        return (d * d).sum(1).tolist()

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.u / np.sqrt(self.e)


def _added(tables: list[np.ndarray]) -> np.ndarray:
    """The sum in the order given; integers that may pass 64 bits are an error."""
    total = tables[0].copy()
    for m in tables[1:]:
        if total.dtype == np.int64 and int(np.abs(total).max(initial=0)) + int(np.abs(m).max(initial=0)) >= 2**63:
            raise OverflowError("a sum doesn't fit 64 bits")
        total += m
    return total


def _adder(kind: str, by: str):
    """Adds the slabs of a group, ordered by ``by``."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(by)
        m = _added([np.frombuffer(x.as_buffer(), kind) for x in table["m"]])
        return pa.table([table["slab"].slice(0, 1), table["part"].slice(0, 1), table["part"].slice(0, 1), pa.array([m.tobytes()], pa.binary())], names=["slab", "task", "part", "m"])

    return run


def summed(blocks: DataFrame, of, shape: tuple[int, int], kind: str = "f8") -> np.ndarray:
    """The sum over all blocks of the matrices ``of(rows)`` of one shape, which depends on the dimension only."""
    width, step = shape[1], max(1, SLAB_BYTES // (8 * max(1, shape[1])))

    def run(batches):
        total = np.zeros(shape, kind)
        for batch in batches:
            for x in batch.column(0):
                total = _added([total, of(np.frombuffer(x.as_buffer(), np.int64))])
        task = TaskContext.get().partitionId()
        for i in range(0, shape[0], step):
            yield pa.RecordBatch.from_arrays([pa.array([i // step], pa.int32()), pa.array([task]), pa.array([task // TOGETHER]), pa.array([total[i : i + step].tobytes()], pa.binary())], names=["slab", "task", "part", "m"])

    slabs = blocks.mapInArrow(run, _SLABS)
    for keys, by in ((["slab", "part"], "task"), (["slab"], "part")):
        slabs = slabs.groupBy(*keys).applyInArrow(_adder(kind, by), _SLABS)
    out = np.zeros(shape, kind)
    for r in slabs.select("slab", "m").collect():  # the dimension bounds them
        m = np.frombuffer(r["m"], kind).reshape(-1, width)
        out[r["slab"] * step : r["slab"] * step + len(m)] = m
    return out


def components(blocks: DataFrame, fit: Fit, wanted: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES, seed: int = 1) -> None:
    """Find ``fit``'s components over ``blocks`` of the fit list."""
    d = len(fit.sums)
    k = min(wanted, d)

    def covariance(q: np.ndarray) -> np.ndarray:
        def of(rows: np.ndarray) -> np.ndarray:
            c = fit.centred(rows.reshape(-1, d))
            return c.T @ (c @ q)

        return summed(blocks, of, q.shape) / fit.n

    def variances(rows: np.ndarray) -> np.ndarray:
        c = fit.centred(rows.reshape(-1, d))
        return (c * c).sum(0, keepdims=True)

    fit.trace = float(summed(blocks, variances, (1, d)).sum() / fit.n)
    columns, left, before = min(d, k + oversample), passes, None
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, columns)))[0]
    while True:
        if columns == d:
            q = np.eye(d)
        y = covariance(q)
        t = q.T @ y
        e, w = np.linalg.eigh((t + t.T) / 2)
        e, w = e[::-1][:k], w[:, ::-1][:, :k]
        if columns == d:
            break
        off = float(np.linalg.norm(y @ w - (q @ w) * e, axis=0).max())
        if off <= TOLERANCE * e[0]:
            break
        left -= 1
        # as many passes more as the last one's progress suggests
        rate = off / before if before else 0.0
        if left <= 0 or rate >= 1 or rate and np.log(TOLERANCE * e[0] / off) / np.log(rate) > left:
            columns = d
        before = off
        q = np.linalg.qr(y)[0]
    real = e > NOTHING * max(float(e[0]), 0.0) if k else np.zeros(0, bool)
    u = (q @ w)[:, real]
    fit.u, fit.e = u / np.linalg.norm(u, axis=0), e[real]
    if not len(fit.e):
        return

    def moments(rows: np.ndarray) -> np.ndarray:
        z = fit.whitened(rows.reshape(-1, d))
        return np.vstack([z.sum(0), z.T @ z])

    m = summed(blocks, moments, (len(fit.e) + 1, len(fit.e))) / fit.n
    fit.error = float(np.abs(m[1:] - np.outer(m[0], m[0]) - np.eye(len(fit.e))).max())


def fitted(x: DataFrame, wanted: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES) -> Fit:
    """The fit over the distinct vectors of ``x`` (x)."""
    d = x.agg(F.max(F.size("x"))).first()[0] or 0
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x"))) if d else F.col("x")
    blocks = shared.stored(shared.mapped(x.select(padded.alias("x")).distinct(), _blocks(d), "rows binary"))

    def count(rows: np.ndarray) -> np.ndarray:
        rows = rows.reshape(-1, d)
        if int(np.abs(rows).max(initial=0)) * len(rows) >= 2**63:
            raise OverflowError("a sum doesn't fit 64 bits")
        return np.append(rows.sum(0), len(rows))[None]

    total = summed(blocks, count, (1, d + 1), "i8")[0] if d else np.zeros(1, np.int64)
    fit = Fit(int(total[-1]), total[:-1])
    if fit.n > 1:
        components(blocks, fit, wanted, oversample, passes)
    shared.removed(blocks)
    return fit


def whiten(vectors: DataFrame, wanted: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES) -> DataFrame:
    """``vectors`` (vec_id, embedding) by component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    x = integers(vectors)
    fit = fitted(x, wanted, oversample, passes)
    k = len(fit.e)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows if k else 0, BLOCK):
                part = batch.slice(i, BLOCK)
                rows = _matrix(part.column("x"), len(fit.sums))
                n = len(rows)
                each = lambda a: pa.array(np.repeat(a, k))
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), each(np.full(n, fit.n)),
                    pa.array([v for v in fit.squares(rows) for _ in range(k)], pa.int64()), pa.array(fit.whitened(rows).reshape(-1)),
                    pa.array(np.tile(fit.e / fit.trace, n)), pa.array(np.full(n * k, fit.error)),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return shared.mapped(x, run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: vec_id, component, n, deviation, whitened, explained, identity_error."""
    return whiten(shared.table(spark, sf_dir, "embeddings"))


#: Eigenvectors are beyond SQL; tests hold the query against a dense eigendecomposition.
SQL = None
