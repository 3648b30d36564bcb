"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches of ascending doc_id.  A batch's distinct line keys
are merge-joined against the sorted runs of all keys seen before: keys found
there lose their lines in this batch, new keys form a new run, bucketed and
sorted by hash, so that later batches join it without moving it.  When a
level holds ``FANOUT`` runs they are compacted into one of the next level.
Since batches ascend, the first holder of a key has the smallest doc_id.

A caller that keeps a ``Runs`` can dedup later documents, of larger doc_ids,
against all that it has seen.

Defined cases: a null or empty text is one empty line; documents without a
doc_id are left as they are and make no key known; rows that share a doc_id
count as one document; a line may be of any length; lines with fewer than
``MIN_POINTS`` code points after stripping always stay; an empty table gives
an empty result; extra columns of any name pass through ``dedup``, those
named like its own outputs are replaced.  Keys are told apart by 128-bit
hashes.  A key of very many documents is joined apart (``join_by_key``).
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import shared

MIN_POINTS = 10
BATCHES = 4
FANOUT = 3
_KEY = ["h1", "h2"]


def line_key(line: bytes) -> bytes | None:
    """16 bytes for a line that can be dropped, else None."""
    line = line.strip(shared.BLANKS)
    if len(line) < MIN_POINTS or len(line) < 4 * MIN_POINTS and len(line.decode()) < MIN_POINTS:
        return None
    return xxhash.xxh3_128_digest(line.lower())  # bytes.lower() touches A-Z only


def _keys(batches):
    for batch in batches:
        for t in shared.chunks(batch.column("text")):
            ids = batch.column("doc_id").slice(t.first, len(t)).to_pylist()
            doc, key = [], []
            for i, d in enumerate(ids):
                if d is not None:
                    own = {k for line in t.raw(i).split(b"\n") if (k := line_key(line))}
                    doc += [d] * len(own)
                    key += own
            h = np.frombuffer(b"".join(key), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["doc_id", *_KEY])


class Runs:
    """Levels of sorted runs; every key is in one run only.  ``close`` deletes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.levels, self.buckets = spark, [[]], shared.partitions(spark)

    def all(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _write(self, keys: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        at = f"{shared.shared_dir(self.spark)}/{name}"
        with shared.freeing(self.spark):
            keys.select(*_KEY).repartition(self.buckets, *_KEY).write.format("parquet").bucketBy(self.buckets, *_KEY).sortBy(*_KEY).option("path", at).saveAsTable(name)
        return name

    def add(self, keys: DataFrame) -> None:
        """A new run; full levels are compacted into one run of the next level."""
        self.levels[0].append(self._write(keys))
        for i, level in enumerate(self.levels):
            if len(level) < FANOUT:
                break
            merged = self.spark.table(level[0])
            for name in level[1:]:
                merged = merged.unionByName(self.spark.table(name))
            new = self._write(merged)
            if i + 1 == len(self.levels):
                self.levels.append([])
            self.levels[i + 1].append(new)
            self._drop(level)
            self.levels[i] = []

    def _drop(self, names: list[str]) -> None:
        for name in names:
            table = self.spark.table(name)
            shared.removed(table)
            self.spark.sql(f"DROP TABLE {name}")

    def close(self) -> None:
        self._drop(self.all())

    def marked(self, own: DataFrame) -> DataFrame:
        """``own`` (h1, h2, owner, n) with ``seen``: whether a run has the key."""
        flags = []
        for i, name in enumerate(self.all()):
            own = own.join(self.spark.table(name).withColumn(f"s{i}", F.lit(True)), _KEY, "left")
            flags.append(F.col(f"s{i}"))
        return own.select(*_KEY, "owner", "n", F.coalesce(*flags, F.lit(False)).alias("seen"))


def drops(docs: DataFrame, batches: int = BATCHES, runs: Runs | None = None) -> DataFrame:
    """(doc_id, h1, h2) of the lines to drop; what ``docs`` hold is added to ``runs`` if given."""
    spark = docs.sparkSession
    lines = shared.mapped(docs.select("doc_id", "text"), _keys, "doc_id long, h1 long, h2 long")
    cuts = docs.select("doc_id").approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    cuts = sorted({int(c) for c in cuts})
    batch = sum(((F.col("doc_id") > c).cast("int") for c in cuts), F.lit(0))
    lines = shared.stored(lines.withColumn("batch", batch))
    known, found = runs or Runs(spark), []
    try:
        for b in range(len(cuts) + 1):
            here = lines.filter(F.col("batch") == b).select("doc_id", *_KEY)
            own = here.groupBy(*_KEY).agg(F.min("doc_id").alias("owner"), F.count("*").alias("n"))
            marked = shared.stored(known.marked(own))
            if runs or b < len(cuts):
                known.add(marked.filter(~F.col("seen")))
            # a key with one line here that no run has loses nothing
            lost = shared.join_by_key(here, marked.filter(F.col("seen") | (F.col("n") > 1)), _KEY, "n").filter(F.col("seen") | (F.col("owner") < F.col("doc_id")))
            found.append(shared.stored(lost.select("doc_id", *_KEY).distinct()))
            shared.removed(marked)
    finally:
        if runs is None:
            known.close()
    shared.removed(lines)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def dedup(docs: DataFrame, batches: int = BATCHES, runs: Runs | None = None) -> DataFrame:
    """``docs`` with repeated lines dropped from ``text``, and n_lines (before) and n_dropped."""
    own = ["n_lines", "n_dropped"]
    keep = [f for f in docs.schema.fields if f.name not in own]
    rest = [f"`{f.name}`" for f in keep if f.name not in ("doc_id", "text")]
    # the caller's columns travel in one, so that none of their names can clash
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*rest).alias("row") if rest else F.lit(None).cast("string").alias("row"))
    lost = drops(docs, batches, runs).groupBy("doc_id").agg(F.collect_list(F.struct(*_KEY)).alias("lost"))
    joined = docs.join(lost, "doc_id", "left").select("doc_id", "row", "text", "lost")
    schema = T.StructType([*(f for f in joined.schema.fields if f.name != "lost"), *(T.StructField(n, T.LongType()) for n in own)])

    def run(batches):
        for whole in batches:
            for t in shared.chunks(whole.column("text")):
                batch = whole.slice(t.first, len(t))
                text, n, d = [], [], []
                for i, lost in enumerate(batch.column("lost").to_pylist()):
                    lines = t.raw(i).split(b"\n")
                    stay = lines
                    if lost:
                        gone = {np.array([x["h1"], x["h2"]], np.int64).tobytes() for x in lost}
                        stay = [x for x in lines if line_key(x) not in gone]
                    text.append(b"\n".join(stay))
                    n.append(len(lines))
                    d.append(len(lines) - len(stay))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(text, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], names=schema.names)

    got = shared.mapped(joined, run, schema)
    return got.select(*(F.col(f.name) if f.name in ("doc_id", "text") else F.col("row").getField(f.name).alias(f.name) for f in keep), *own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: doc_id, n_lines, n_dropped, kept_sha256."""
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, t.i, t.line,
         translate(regexp_replace(regexp_replace(t.line, '^[ \t\n\x0B\f\r]+', ''), '[ \t\n\x0B\f\r]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(list_zip(range(len(s)), s)) AS z FROM
         (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)) x,
       LATERAL (SELECT z[1] AS i, z[2] AS line) t
), o AS (SELECT key, min(doc_id) AS owner FROM l WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT l.*, o.owner IS NOT NULL AND o.owner < l.doc_id AS gone FROM l LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
