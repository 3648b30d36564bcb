"""Document fingerprints by a homomorphic multiset hash of paragraphs.

A text is the multiset of its paragraphs (lines, cut after sentence ends),
without the newline or blank that closes each; how many of either there are
is added to the wide lanes only.  Each paragraph is hashed with BLAKE2b to 512 bits: four wide lanes of 64 bits
and 256 lanes of +1 or -1.  The fingerprint is the sum over the paragraphs,
of the wide lanes modulo 2**64, of the others modulo 2**16.  So the order of
paragraphs doesn't matter, and inserting or deleting one adds or subtracts
its vector (``added``).  The wide lanes tell texts apart; the small lanes are
a sketch of the multiset, from which the overlap of two texts follows by
inner products (``likeness``, with an error of about 0.06 to 0.09).

Rows are dealt once, by range of doc_id; ranges hold about ``RANGE_BYTES``
bytes of text, and a task reads its range as a stream, one document and the
next, so its memory doesn't grow with the range.

Defined cases: a null text counts as empty and its fingerprint is all zero;
two empty texts have likeness 1, an empty and another 0; texts that differ
only in the order of paragraphs have equal fingerprints; rows that share a
doc_id follow each other by the hash of their text, descending; documents
without a doc_id come last, in the same order; a single document is its own
next; a small lane can only pass its range in texts of more than 32,767
paragraphs, whose likeness then is only a guess; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import shared

LANES, WIDE = 256, 4
#: A paragraph also ends at a blank after one of these.
ENDS = b".!?"
#: Bytes of text in a range, and how many ranges there can be at most (a larger table has larger ones).
RANGE_BYTES, MAX_RANGES = 8 << 20, 1 << 15
#: Documents worked on together.
TOGETHER = 128


def unit_bounds(t: shared.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the paragraphs of all texts, which byte closes each (0: none), and the number of each text's first (one more entry at the end)."""
    buf = t.buf
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(len(t) + 1, np.int64)
    cut = buf == 10
    after = np.isin(buf, np.frombuffer(ENDS, np.uint8))
    cut[1:] |= (buf[1:] == 32) & after[:-1]  # the space after a sentence end closes its unit
    begin = np.zeros(len(buf) + 1, bool)
    begin[1:] = cut
    begin[t.starts] = True
    begin[len(buf)] = False
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(buf))
    closed = cut[ends - 1]
    return starts, ends - closed, np.where(closed, buf[ends - 1], 0).astype(np.uint8), np.append(np.searchsorted(starts, t.starts), len(starts))


def vectors(digests: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of each paragraph's digest (64 bytes): the small lanes (+1, -1) and the wide lanes."""
    d = np.frombuffer(digests, np.uint8).reshape(-1, 8 * WIDE + LANES // 8)
    wide = np.ascontiguousarray(d[:, : 8 * WIDE]).view("<u8").astype(np.uint64)
    small = np.unpackbits(d[:, 8 * WIDE :], axis=1).astype(np.int16) * 2 - 1
    return small, wide


def sums(t: shared.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all texts of a chunk."""
    starts, ends, closing, first = unit_bounds(t)
    small, wide = np.zeros((len(t), LANES), np.uint16), np.zeros((len(t), WIDE), np.uint64)
    if len(starts):
        raw = t.buf.tobytes()
        a, b = vectors(b"".join([hashlib.blake2b(raw[i:j]).digest() for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]))
        some = np.flatnonzero(first[1:] > first[:-1])
        small[some] = np.add.reduceat(a.view(np.uint16), first[:-1][some], axis=0)
        wide[some] = np.add.reduceat(b, first[:-1][some], axis=0)
        for byte in (10, 32):
            n = np.add.reduceat((closing == byte).astype(np.uint64), first[:-1][some])
            wide[some] += n[:, None] * vectors(hashlib.blake2b(bytes([byte]), person=b"closing").digest())[1]
    return small, wide


def hex_of(small: np.ndarray, wide: np.ndarray) -> list[str]:
    """The lanes, big-endian, in hex: the wide ones first."""
    return [w.tobytes().hex() + s.tobytes().hex() for s, w in zip(small.astype(">u2"), wide.astype(">u8"), strict=True)]


def added(a: str, b: str, sign: int = 1) -> str:
    """Fingerprint of the union of two multisets; with sign -1, of ``a`` without ``b``."""
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    w = np.frombuffer(x[: 8 * WIDE], ">u8").astype(np.uint64) + np.uint64(sign % (1 << 64)) * np.frombuffer(y[: 8 * WIDE], ">u8").astype(np.uint64)
    s = np.frombuffer(x[8 * WIDE :], ">u2").astype(np.uint16) + np.uint16(sign % (1 << 16)) * np.frombuffer(y[8 * WIDE :], ">u2").astype(np.uint16)
    return hex_of(s[None], w[None])[0]


def likeness(a: np.ndarray, wide_a: np.ndarray, b: np.ndarray, wide_b: np.ndarray) -> np.ndarray:
    """Shared paragraphs over the mean number of paragraphs, estimated from the small lanes; 1 for equal fingerprints, else below 1."""
    x, y = a.astype(np.int16).astype(np.float64), b.astype(np.int16).astype(np.float64)
    apart, both = ((x - y) ** 2).sum(1), (x**2).sum(1) + (y**2).sum(1)
    near = np.where(both > 0, 1 - apart / np.where(both > 0, both, 1), 0.0)
    same = (wide_a == wide_b).all(1) & (a == b).all(1)
    return np.where(same, 1.0, np.clip(near, 0.0, 1 - 1 / 64))


def _sums_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [sums(t) for t in shared.chunks(pa.array(texts, pa.large_string()))]
    return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])


_KINDS = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Rows of consecutive documents; ``texts`` has one more, the one after the last."""
    edited = []
    for text, after in zip(texts, texts[1:], strict=False):
        half = len(text) // 2
        edited.append(text[: len(text) - half] + after[:half])
    (s, w), (es, ew) = _sums_of(texts), _sums_of(edited)
    own, own_wide = s[:-1], w[:-1]
    cols = [
        ids, [len(x) for x in texts[:-1]], [hashlib.sha256(x.encode()).hexdigest() for x in edited], hex_of(own, own_wide), hex_of(es, ew),
        likeness(own, own_wide, es, ew), likeness(own, own_wide, s[1:], w[1:]),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS.values(), strict=True)], names=list(_KINDS))


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges one after another, each in descending order and closed by the next one's first row (``halo``)."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for d, text, halo in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("halo").to_pylist(), strict=True):
            texts.append(text or "")
            size += len(texts[-1])
            if len(ids) == len(texts) - 1 and ids and (halo or len(ids) >= TOGETHER or size > shared.CHUNK_BYTES):
                yield _rows(ids, texts)
                ids, texts, size = [], texts[-1:], len(texts[-1])
            if halo:
                ids, texts, size = [], [], 0
            else:
                ids.append(d)


def _above(cuts: list[int], x: Column) -> Column:
    """How many of the ascending ``cuts`` are below x, by halving steps in built-in expressions."""
    known = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    step, steps = 1 << max(len(cuts).bit_length() - 1, 0), []
    while step:
        steps.append(F.lit(step))
        step //= 2

    def further(p: Column, s: Column) -> Column:
        return F.when((p + s <= len(cuts)) & (F.get(known, p + s - 1) < x), p + s).otherwise(p)

    return F.aggregate(F.array(*steps), F.lit(0), further) if cuts else F.lit(0)


def _cuts(df: DataFrame, by: str, parts: int) -> list[int]:
    """About evenly spaced values of a column, ascending."""
    if parts < 2:
        return []
    return sorted({int(c) for c in df.approxQuantile(by, [i / parts for i in range(1, parts)], 1 / (4 * parts))})


def fingerprints(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprints of ``docs`` (doc_id, text), of their edited texts, and likenesses.

    Each range also gets the first row of the next one (the last: of the
    first), found from the ids alone.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    nil = F.col("doc_id").isNull()
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 64
    total = base.agg(F.sum(F.when(nil, 0).otherwise(size)).alias("own"), F.sum(F.when(nil, size).otherwise(0)).alias("nil")).first()
    many, many_nil = (min(MAX_RANGES, -(-(n or 0) // range_bytes)) for n in total)
    base = base.withColumn("tie", F.xxhash64("text"))
    up = _cuts(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", many)
    up_nil = _cuts(base.filter(nil), "tie", many_nil)
    # 0 holds the largest ids, the last ones the rows without an id
    own = len(up) - _above(up, F.col("doc_id"))
    base = base.withColumn("range", F.when(nil, len(up) + 1 + len(up_nil) - _above(up_nil, F.col("tie")) if many_nil else F.lit(0)).otherwise(own).cast("int"))
    # the first row of each range: by ids only where there are ids
    heads = base.filter(~nil).groupBy("range").agg(F.max("doc_id").alias("d")).collect()
    if many_nil:
        heads += [(r["range"], None) for r in base.filter(nil).select("range").distinct().collect()]
    heads = sorted((r[0], r[1]) for r in heads)
    base = base.withColumn("halo", F.lit(False))
    if heads:
        to = [(r, d, heads[i - 1][0]) for i, (r, d) in enumerate(heads)]
        moved = spark.createDataFrame(to, "r int, d long, into int")
        extra = base.join(F.broadcast(moved), (F.col("range") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")))
        extra = extra.groupBy("into").agg(F.max_by(F.struct("text"), "tie").alias("x"), F.max("doc_id").alias("doc_id"))
        extra = extra.select("doc_id", "x.text", F.xxhash64("x.text").alias("tie"), F.col("into").alias("range"), F.lit(True).alias("halo"))
        base = base.unionByName(extra)
    n = max(1, heads[-1][0] + 1) if heads else 1
    dealt = base.repartitionById(n, "range").sortWithinPartitions("range", "halo", F.desc_nulls_last("doc_id"), F.desc("tie"))
    return shared.mapped(dealt.select("doc_id", "text", "halo"), _stream, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    return fingerprints(shared.table(spark, sf_dir, "documents"))


#: The lanes are beyond SQL; tests restate them paragraph by paragraph.
SQL = None
