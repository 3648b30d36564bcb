"""Substring dedup by hashing lines and passages of words.

A unit is a line (paragraph) of ``LINE_CHARS`` or more characters, or any
``PASSAGE`` consecutive words of a text, whatever its line breaks and
neighbours.  Units are normalised (A-Z lower-cased, blanks between words made
one) and hashed; digests are grouped over all documents, the occurrence of
smallest rank (doc_id, then hash of the text, then start) is kept and every
other one is removed, of a passage only what it doesn't share with the kept
one.  What is removed of a document is the union of both, in offsets of the
original text.  Shorter lines, which clean documents share by chance or by
custom, stay (``op8_line_dedup`` is there for them).

Passages are hashed in two steps, neither of which loses any.  The anchor of
a passage is the least hash of ``SHINGLE`` words in it, so equal passages have
equal anchors; anchors number about one in thirteen words.  Only passages
whose anchor stands in two places or more are hashed themselves.  Those of an
anchor are compared in one task, unless the anchor holds more than one in
``shared.hot_share`` places: its passages are grouped one by one, and the kept
places of the most frequent (at most ``KNOWN``) go to every task.

Defined cases: null and empty texts have no units; documents without a
doc_id take no part; rows that share doc_id and text are one document, those
that share only the doc_id are several, and each is cut by its own spans;
repeats within a document count; a repeat nested in another one is merged
with it; an empty table gives an empty result; extra columns of any name pass
through ``dedup``, one named ``removed`` is replaced.  Digests of lines have
128 bits, those of passages 64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import shared

#: Characters of a line, blanks between words made one, from which it is a unit.
LINE_CHARS = 200
#: Words of a passage, and of the shingles of which the least is its anchor.
PASSAGE, SHINGLE = 50, 25
#: Passages of hot anchors whose kept places are sent to every task: those with more than one in so many places.
KNOWN = 50_000
_KEY = ["h1", "h2"]
#: What ranks documents: the id, and a hash of the text for rows that share it.
_DOC = ["doc_id", "tie"]


def units(text: bytes, least: int = LINE_CHARS) -> list[tuple[bytes, int, int]]:
    """(digest, start, end) in bytes of every line that is a unit."""
    out, at = [], 0
    for line in text.split(b"\n"):
        if len(line) >= least:
            joined = b" ".join(line.lower().split())
            if len(joined) >= 4 * least or len(joined.decode(errors="replace")) >= least:
                lead = len(line) - len(line.lstrip(shared.BLANKS))
                out.append((xxhash.xxh3_128_digest(joined), at + lead, at + len(line)))
        at += len(line) + 1
    return out


def _points(raw: bytes | np.ndarray) -> np.ndarray:
    """Code points before each byte."""
    return np.append(0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


def _lines_of(least: int):
    def run(batches):
        for batch in batches:
            for t in shared.chunks(batch.column("text")):
                of, key, spans = [], [], [np.zeros((0, 2), np.int64)]
                for i in range(len(t)):
                    raw = t.raw(i)
                    if found := units(raw, least):
                        at = np.array([x[1:] for x in found], np.int64)
                        spans.append(at if raw.isascii() else _points(raw)[at])
                        of += [i] * len(found)
                        key += [x[0] for x in found]
                h, span, own = np.frombuffer(b"".join(key), np.int64).reshape(-1, 2), np.concatenate(spans).astype(np.int32), pa.array(of, pa.int64())
                ids = [batch.column(c).slice(t.first, len(t)).take(own) for c in _DOC]
                yield pa.RecordBatch.from_arrays([*ids, *(pa.array(x.copy()) for x in (h[:, 0], h[:, 1], span[:, 0], span[:, 1]))], names=[*_DOC, *_KEY, "start", "end"])

    return run


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of two runs of words as one hash."""
    return shared.mixed(a * np.uint64(0xD1342543DE82EF95) + b)


def _least(g: np.ndarray, n: int) -> np.ndarray:
    """For each n consecutive hashes the place of the least, the leftmost of equal ones."""
    value, at, have = g, np.arange(len(g)), 1
    while have < n:
        step = min(have, n - have)
        left = value[:-step] <= value[step:]
        value, at = np.where(left, value[:-step], value[step:]), np.where(left, at[:-step], at[step:])
        have += step
    return at


def _passages(t: shared.Texts) -> tuple[np.ndarray, ...]:
    """Of every passage: text number, start and end (bytes in ``t.buf``), hash, anchor, and the anchor's word in the text."""
    starts, ends, first = shared.word_bounds(t)
    n = len(starts) - PASSAGE + 1
    if n < 1:
        return tuple(np.zeros(0, x) for x in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64))
    g = word = shared.span_hashes(shared.lowered(t.buf), starts, ends)
    for bit in f"{SHINGLE:b}"[1:]:
        have = len(word) - len(g) + 1
        g = _joined(g[:-have], g[have:])
        if bit == "1":
            g = _joined(g[:-1], word[2 * have :])
    at = _least(g, PASSAGE - SHINGLE + 1)
    text = np.repeat(np.arange(len(t)), np.diff(first))
    i = np.flatnonzero(text[:n] == text[PASSAGE - 1 :])
    text, at = text[i], at[i]
    return text, starts[i], ends[i + PASSAGE - 1], _joined(g[i], g[i + PASSAGE - SHINGLE]), g[at], at - first[text]


def _begins(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """True where another anchor begins."""
    new = np.ones(len(at), bool)
    new[1:] = (text[1:] != text[:-1]) | (at[1:] != at[:-1])
    return new


def _anchors(batches):
    for batch in batches:
        for t in shared.chunks(batch.column("text")):
            text, _, _, _, anchor, at = _passages(t)
            new = _begins(text, at)
            ids = [batch.column(c).slice(t.first, len(t)).take(pa.array(text[new])) for c in _DOC]
            yield pa.RecordBatch.from_arrays([pa.array(anchor[new].view(np.int64)), *ids, pa.array(at[new].astype(np.int32))], names=["anchor", *_DOC, "at"])


def _runs(batches):
    """Of each anchor in ``wanted`` the passages around it: their hashes, starts and ends (code points)."""
    for batch in batches:
        wanted = np.unique(np.asarray(batch.column("wanted").flatten()).astype(np.int64).view(np.uint64))
        for t in shared.chunks(batch.column("text")):
            text, start, end, hashes, anchor, at = _passages(t)
            if not len(wanted) or not len(text):
                continue
            i = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, anchor), len(wanted) - 1)] == anchor)
            # bytes to code points
            points = _points(t.buf)
            base = points[t.starts[text[i]]]
            new = i[_begins(text[i], at[i])]
            cut = pa.array(np.append(np.searchsorted(i, new), len(i)).astype(np.int32))
            inner = [pa.array(hashes[i].view(np.int64)), *(pa.array((points[x[i]] - base).astype(np.int32)) for x in (start, end))]
            ids = [batch.column(c).slice(t.first, len(t)).take(pa.array(text[new])) for c in _DOC]
            yield pa.RecordBatch.from_arrays([pa.array(anchor[new].view(np.int64)), *ids, pa.array(at[new].astype(np.int32)), *(pa.ListArray.from_arrays(cut, x) for x in inner)], names=["anchor", *_DOC, "at", "hashes", "starts", "ends"])


_SPANS = "doc_id long, tie long, start int, end int, first_doc_id long"


def _again(batches):
    """Spans of passages seen before, from runs in the order of anchor, document and place; one anchor's passages are held at a time."""
    last, seen = None, {}
    for batch in batches:
        out = []
        for anchor, d, tie, hashes, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("anchor", *_DOC, "hashes", "starts", "ends")), strict=True):
            if anchor != last:
                last, seen = anchor, {}
            span = None
            for h, start, end in zip(hashes, starts, ends, strict=True):
                first = seen.setdefault(h, (d, tie, start, end))
                if first[0] == d and first[1] == tie:
                    # the kept occurrence stays whole where another one overlaps it
                    start = max(start, first[3]) if start > first[2] else end
                if start >= end:
                    continue
                if span and span[4] == first[0] and span[2] <= start <= span[3]:
                    span[3] = max(span[3], end)
                else:
                    span = [d, tie, start, end, first[0]]
                    out.append(span)
        cols = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, kinds, strict=True)], names=[*_DOC, "start", "end", "first_doc_id"])


def _place() -> Column:
    return F.struct(*_DOC, "start")


def _firsts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each digest that stands at several places: the smallest (first, first_end), and how many there are (n)."""
    # partial sums first, so a unit of a third of all documents is one row a task; only repeated digests go on
    first = rows.groupBy(*keys).agg(F.min(_place()).alias("first"), F.max(_place()).alias("last"), F.min_by("end", _place()).alias("first_end"), F.count("*").alias("n"))
    return shared.stored(first.filter(F.col("first") < F.col("last")).select(*keys, "first", "first_end", "n"))


def _not_first(rows: DataFrame, first: DataFrame, keys: list[str]) -> DataFrame:
    """Spans of ``rows`` (stored; doc_id, tie, start, end and a digest) whose digest stands at a smaller place too."""
    gone = shared.join_by_key(rows, first, keys, "n").filter(_place() > F.col("first"))
    # within one document the kept occurrence stays whole where another one overlaps it
    own = (F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.tie") == F.col("tie"))
    start = F.when(own, F.greatest("start", "first_end")).otherwise(F.col("start"))
    return gone.select(*_DOC, start.alias("start"), "end", F.col("first.doc_id").alias("first_doc_id")).filter("start < end")


def _spans_of_known(rows: list):
    """Of runs, the spans of passages whose kept places are known (``rows``: h, first, first_end), those that overlap as one."""
    rows = sorted((r["h"], r["first"]["doc_id"], r["first"]["tie"], r["first"]["start"], r["first_end"]) for r in rows)
    known, first_doc, first_tie, first_start, first_end = (np.array(c, np.int64) for c in zip(*rows, strict=True))

    def run(batches):
        for batch in batches:
            of = np.repeat(np.arange(batch.num_rows), np.asarray(batch.column("hashes").value_lengths()))
            h, start, end = (np.asarray(batch.column(c).flatten()).astype(np.int64) for c in ("hashes", "starts", "ends"))
            doc, tie = (np.asarray(batch.column(c))[of] for c in _DOC)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            own = (first_doc[at] == doc) & (first_tie[at] == tie)
            gone = (known[at] == h) & ~(own & (start <= first_start[at]))
            # the kept occurrence stays whole where another one overlaps it
            start = np.where(own, np.maximum(start, first_end[at]), start)
            i = np.flatnonzero(gone & (start < end))
            new = np.ones(len(i), bool)
            new[1:] = (np.diff(i) > 1) | (of[i][1:] != of[i][:-1]) | (first_doc[at[i]][1:] != first_doc[at[i]][:-1])
            begin = np.flatnonzero(new)
            low, high = (np.minimum.reduceat(start[i], begin), np.maximum.reduceat(end[i], begin)) if len(i) else (start[:0], end[:0])
            i = i[begin]
            yield pa.RecordBatch.from_arrays([pa.array(doc[i]), pa.array(tie[i]), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(first_doc[at[i]])], names=[*_DOC, "start", "end", "first_doc_id"])

    return run


def passages(docs: DataFrame) -> DataFrame:
    """Spans of the passages of ``docs`` (doc_id, tie, text; none null) that stand at a smaller place too."""
    anchors = shared.stored(shared.mapped(docs, _anchors, "anchor long, doc_id long, tie long, at int"))
    place = F.struct(*_DOC, "at")
    twice = anchors.groupBy("anchor").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).filter(F.col("first") < F.col("last"))
    twice = shared.stored(twice.select("anchor", "n"))
    hot = shared.stored(twice.filter(F.col("n") * shared.hot_share(docs.sparkSession) > (twice.agg(F.sum("n")).first()[0] or 0)).select("anchor"))
    wanted = shared.stored(shared.join_by_key(anchors, twice, ["anchor"], "n").groupBy(*_DOC).agg(F.collect_set("anchor").alias("wanted")))
    shared.removed(anchors)
    runs = shared.mapped(docs.join(wanted, _DOC), _runs, "anchor long, doc_id long, tie long, at int, hashes array<long>, starts array<int>, ends array<int>")
    if hot.isEmpty():
        return shared.stored(shared.mapped(_in_order(runs), _again, _SPANS))
    runs = shared.stored(runs)
    cold = shared.stored(shared.mapped(_in_order(runs.join(F.broadcast(hot), "anchor", "left_anti")), _again, _SPANS))
    runs_of_hot = runs.join(F.broadcast(hot), "anchor").select(*_DOC, "hashes", "starts", "ends")
    each = runs_of_hot.select(*_DOC, F.explode(F.arrays_zip("hashes", "starts", "ends")).alias("x"))
    each = shared.stored(each.select(*_DOC, F.col("x.hashes").alias("h"), F.col("x.starts").alias("start"), F.col("x.ends").alias("end")))
    first = _firsts(each, ["h"])
    is_known = F.col("n") * KNOWN > (first.agg(F.sum("n")).first()[0] or 0)
    known = first.filter(is_known).collect()  # no more than KNOWN rows
    if known:
        rare = shared.stored(each.join(F.broadcast(first.filter(is_known).select("h")), "h", "left_anti"))
        shared.removed(each)
        each = rare
    spans = _not_first(each, first.filter(~is_known), ["h"])
    if known:
        spans = spans.unionByName(shared.mapped(runs_of_hot, _spans_of_known(known), _SPANS))
    spans = shared.stored(spans)
    shared.removed(runs, each, first)
    return cold.unionByName(spans)


def _in_order(runs: DataFrame) -> DataFrame:
    return runs.repartition("anchor").sortWithinPartitions("anchor", *_DOC, "at")


def _repeats(docs: DataFrame, least: int) -> DataFrame:
    """Spans to remove by document (doc_id, tie), merged where they overlap or touch."""
    docs = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(*_DOC, "text")
    longer = passages(docs)
    lines = shared.stored(shared.mapped(docs, _lines_of(least), "doc_id long, tie long, h1 long, h2 long, start int, end int"))
    gone = _not_first(lines, _firsts(lines, _KEY), _KEY).unionByName(longer).distinct()
    by_start = Window.partitionBy(*_DOC).orderBy("start", "end", "first_doc_id")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    merged = gone.withColumn("reach", reach).withColumn("new", F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach") + 1), 1).otherwise(0))
    merged = merged.withColumn("island", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    return merged.groupBy(*_DOC, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("first_doc_id", F.struct("start", "end", "first_doc_id")).alias("first_doc_id")).drop("island")


def _ranked(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text", *more)


def repeats(docs: DataFrame, least: int = LINE_CHARS) -> DataFrame:
    """Removed spans: doc_id, start, end (code points, end exclusive), first_doc_id (of the first unit's kept occurrence)."""
    return _repeats(_ranked(docs), least).drop("tie")


def dedup(docs: DataFrame, least: int = LINE_CHARS) -> DataFrame:
    """``docs`` with ``text`` freed of repeats, and ``removed``: the original offsets (start, end) cut out."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "removed")]
    # the caller's columns travel in one, so that none of their names can clash
    rows = _ranked(docs, F.struct(*(f"`{c}`" for c in rest)).alias("row") if rest else F.lit(0).alias("row"))
    spans = _repeats(rows, least).groupBy(*_DOC).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed"))
    got = rows.join(spans, _DOC, "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<struct<start:int,end:int>>")))
    # what stands before each span, and after the last
    left = F.transform("removed", lambda x, i: F.substr(F.col("text"), F.when(i > 0, F.get("removed", i - 1)["end"]).otherwise(0) + 1, x["start"] - F.when(i > 0, F.get("removed", i - 1)["end"]).otherwise(0)))
    text = F.concat(F.array_join(left, ""), F.substr(F.col("text"), F.element_at("removed", -1)["end"] + 1))
    text = F.when(F.size("removed") > 0, text).otherwise(F.col("text"))
    columns = {"doc_id": F.col("doc_id"), "text": text.alias("text")} | {c: F.col("row").getField(c).alias(c) for c in rest}
    return got.select(*(columns[c] for c in docs.columns if c != "removed"), "removed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: one row per removed span: doc_id, start, end, first_doc_id."""
    return repeats(shared.table(spark, sf_dir, "documents"))


#: Overlapping units with shared ends make poor SQL; a brute-force version checks it.
SQL = None
