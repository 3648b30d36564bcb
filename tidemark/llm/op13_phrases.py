"""Phrase collocation mining over compressed position bitmaps.

Documents are cut into shards of about ``SHARD_BYTES`` of text.  In a shard
every word stands at a position, and one position stays free between pieces,
so no run of positions crosses a piece or a document.  A word of a language
has a bitmap of its positions, kept as its non-zero bytes.  A
phrase's bitmap is that of its first words, shifted by one, AND that of its
last; its popcount is the phrase's count in the shard, and counts add up over
shards.  Phrases grow depth-first: a slice of first words is extended to full
length before the next one is begun, which bounds the memory.

Only what can be frequent is extended.  After each length the counts of all
shards are summed, and the phrases that reach ``least`` mark their hash in a
bitmap of ``BITS`` bits, no larger however many there are; a phrase is
extended only if its first and its last words are marked.  A mark too many
costs time, never a wrong count: in the end phrases are counted by their
text.  Words are told apart by 64-bit hashes within a shard.

Defined cases: a null or empty text has no words; a null lang is ``und``, as
is the lang of that name; rows that share a doc_id each count; a text longer
than a shard is cut between pieces, so a single piece is never cut; phrases
that tie in score and count rank by their UTF-8 bytes; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import shared

LEAST = 30
LONGEST = 4
TOP = 2000
#: A candidate is dropped if a longer one that contains it has this share, in percent, of its count.
CONTAINED = 80
SCALE = 2_000_000
NO_LANG = "und"
SHARD_BYTES = 2 << 20
#: Bits of the bitmap of frequent phrases of one length.
BITS = 1 << 27
#: ANDs done at once.
ANDS = 1 << 19
#: Hashes of phrases that a task adds up before it hands them on.
MERGED = 1 << 20
#: Bytes that end a piece, and those that part words.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Low bits of a hash by which counts are added up; of phrases that share them all are kept if their sum is frequent.
HASH_BITS = 40
_LOW = np.uint64((1 << HASH_BITS) - 1)
_SLAB = 1 << 15
_SHARD = "words array<string>, langs array<string>, of array<int>, starts binary, blocks binary, bits binary"


def _flags(which: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(which)] = True
    return out


_IS_END, _IS_GAP = _flags(ENDS), _flags(ENDS + BLANKS)


def _place(h: np.ndarray, j: int) -> np.ndarray:
    """What a word's hash adds to a phrase's as its ``j``-th word."""
    return shared.mixed(h + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))


def _parts(t: shared.Texts, limit: int) -> Iterator[shared.Texts]:
    """``t`` itself, or one long text cut after ends of pieces."""
    if len(t) > 1 or len(t.buf) <= limit:
        yield t
        return
    ends = np.flatnonzero(_IS_END[t.buf]) + 1
    lo = 0
    while lo < len(t.buf):
        k = int(np.searchsorted(ends, lo + limit, "right"))
        hi = int(ends[k - 1]) if k and ends[k - 1] > lo else int(ends[k]) if k < len(ends) else len(t.buf)
        hi = len(t.buf) if len(t.buf) - lo <= limit else hi
        yield shared.Texts(t.buf[lo:hi], np.zeros(1, np.int64), np.full(1, hi - lo), t.first)
        lo = hi


def positions(t: shared.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its start, end, text and position; positions of neighbours in a piece differ by one, others by more."""
    inside = ~_IS_GAP[t.buf]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    own = t.starts[(t.starts > 0) & (t.starts < len(t.buf)) & (t.starts < t.ends)]
    split = own[inside[own] & inside[own - 1]]  # words that touch over the edge of two texts
    starts = np.sort(np.concatenate([np.flatnonzero(edge == 1), split]))
    ends = np.sort(np.concatenate([np.flatnonzero(edge == -1), split]))
    text = np.searchsorted(t.starts, starts, "right") - 1
    piece = np.cumsum(_IS_END[t.buf])[starts] if len(starts) else starts
    new = (np.diff(piece, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0)
    return starts, ends, text, np.arange(len(starts)) + np.cumsum(new)


def _planes(x: np.ndarray, n: int) -> bytes:
    """The low ``n`` bytes of whole numbers, all first bytes, then all second ones: what is small compresses well."""
    return x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes()


def _unplaned(data, n: int, kind) -> np.ndarray:
    out = np.zeros((len(data) // n, np.dtype(kind).itemsize), np.uint8)
    out[:, :n] = np.frombuffer(data, np.uint8).reshape(n, -1).T
    return out.reshape(-1).view(kind)


def _or_by_key(key: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, bits = key[order], bits[order]
    at = np.flatnonzero(np.diff(key, prepend=-1) != 0)
    return key[at], np.bitwise_or.reduceat(bits, at) if len(at) else bits


def _word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, langs: list[str], of: np.ndarray) -> np.ndarray:
    """Hashes of words of languages."""
    salts = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in langs], np.uint64)
    return shared.mixed(shared.span_hashes(buf, starts, ends) ^ salts[of])


def _shard(t: shared.Texts, langs: list[str]) -> tuple | None:
    """The bitmaps of a shard: its words with their languages, and for each its non-zero blocks, as differences."""
    low = shared.Texts(shared.lowered(t.buf), t.starts, t.ends, t.first)
    starts, ends, text, at = positions(low)
    if not len(starts):
        return None
    names = sorted(set(langs))
    number = {x: i for i, x in enumerate(names)}
    lang = np.array([number[x] for x in langs])[text]
    h = _word_hashes(low.buf, starts, ends, names, lang)
    hashes, first, word = np.unique(h, return_index=True, return_inverse=True)
    width = int(at[-1] >> 3) + 1
    key, bits = _or_by_key(word.astype(np.int64) * width + (at >> 3), np.uint8(1) << (at & 7).astype(np.uint8))
    words = [low.buf[a:b].tobytes().decode() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    of = np.searchsorted(key // width, np.arange(len(hashes) + 1))
    return words, names, lang[first].tolist(), np.diff(of).astype(np.int32).tobytes(), _planes(np.diff(key % width, prepend=0), 4), bits.tobytes()


def _shards(limit: int):
    def run(batches):
        for batch in batches:
            text, lang = batch.column("text"), batch.column("lang").fill_null(NO_LANG).to_pylist()
            for t in shared.chunks(text, limit):
                for part in _parts(t, limit):
                    row = _shard(part, lang[part.first : part.first + len(part)])
                    if row:
                        names = [x.split()[0] for x in _SHARD.split(", ")]
                        kinds = [pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), *[pa.binary()] * 3]
                        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

    return run


class Shard:
    """Bitmaps of a stored shard."""

    def __init__(self, row: dict[str, pa.Scalar]):
        self.words, self.langs, self.of = row["words"].values, row["langs"].values, row["of"].values.to_numpy().astype(np.int64)
        spelled = next(shared.chunks(self.words, 1 << 62))
        self.hashes = _word_hashes(spelled.buf, spelled.starts, spelled.ends, row["langs"].as_py(), self.of)
        self.starts = np.append(0, np.cumsum(np.frombuffer(row["starts"].as_buffer(), np.int32)))
        self.blocks = np.cumsum(_unplaned(row["blocks"].as_buffer(), 4, np.int32), dtype=np.int32)
        self.bits = np.frombuffer(row["bits"].as_buffer(), np.uint8)

    def counts(self) -> np.ndarray:
        """Of each word the popcount of its bitmap."""
        return np.add.reduceat(np.bitwise_count(self.bits).astype(np.int64), self.starts[:-1])


class _Grown:
    """Phrases of one length: the words of each, its count, its bitmap's bytes (``of``, ``blocks``, ``bits``), and what makes up its hash and that of its last words."""

    def __init__(self, words, counts, of, blocks, bits, whole, last):
        self.words, self.counts, self.of, self.blocks, self.bits, self.whole, self.last = words, counts, of, blocks, bits, whole, last

    def hashes(self) -> np.ndarray:
        return shared.mixed(self.whole)


def marked(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h & np.uint64(len(bitmap) * 8 - 1)).astype(np.int64)  # the length is a power of two
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


class _Words:
    """The frequent words of a shard: which stand in a block, and what each adds to a phrase's hash by its place."""

    def __init__(self, shard: Shard, frequent: np.ndarray, longest: int):
        self.n = len(shard.hashes)
        of = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(shard.starts))
        keep = marked(frequent, shard.hashes)[of]
        self.of, self.blocks, self.bits = of[keep], shard.blocks[keep], shard.bits[keep]
        by_block = np.argsort(self.blocks, kind="stable")
        self.in_word, self.in_bits = self.of[by_block], self.bits[by_block]
        n_blocks = int(self.blocks.max()) + 2 if len(self.blocks) else 1
        self.start = np.searchsorted(self.blocks[by_block], np.arange(n_blocks + 1))
        self.size = np.diff(self.start)
        self.places = [_place(shard.hashes, j) for j in range(longest)]


def grown(shard: Shard, frequent: list[np.ndarray], longest: int, ands: int = ANDS) -> Iterator[_Grown]:
    """Phrases of 2 to ``longest`` words that may be frequent; depth-first by slices of first words.

    ``frequent`` holds the bitmaps of frequent phrases of 1, 2, ... words; a
    phrase longer than they go needs frequent words at either end.
    """
    w = _Words(shard, frequent[0], longest)
    work = np.cumsum(w.size[w.blocks])
    lo = 0
    while lo < len(w.of):
        hi = int(np.searchsorted(work, (work[lo - 1] if lo else 0) + ands, "right"))
        hi = int(np.searchsorted(w.of, w.of[min(max(hi, lo + 1), len(w.of)) - 1], "right"))  # whole words
        ids, local = np.unique(w.of[lo:hi], return_inverse=True)
        level = _Grown([ids], None, local, w.blocks[lo:hi], w.bits[lo:hi], w.places[0][ids], np.zeros(len(ids), np.uint64))
        for k in range(2, longest + 1):
            level = _extended(w, level, frequent[k - 1] if k <= len(frequent) else None, frequent[k - 2] if k > 2 else None, ands)
            if not len(level.counts):
                break
            yield level
        lo = hi


def _extended(w: _Words, level: _Grown, whole: np.ndarray | None, last: np.ndarray | None, ands: int) -> _Grown:
    """Every phrase with every word that follows it: shift, AND, popcount; only those whose hash ``whole`` marks, and whose last words' ``last`` does."""
    k = len(level.words)
    over = level.bits >> np.uint8(7)
    carried = np.flatnonzero(over)
    of = np.concatenate([level.of, level.of[carried]])
    blocks = np.concatenate([level.blocks, level.blocks[carried] + 1])
    bits = np.concatenate([level.bits << np.uint8(1), over[carried]])
    keep = np.flatnonzero(bits)
    of, blocks, bits = of[keep], blocks[keep], bits[keep]
    n = w.size[blocks]
    ends = np.cumsum(n)
    found, lo = [], 0
    while lo < len(of):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + ands, "right")))
        each = np.repeat(np.arange(lo, hi), n[lo:hi])
        other = np.arange(len(each)) + (w.start[blocks[lo:hi]] - (ends[lo:hi] - n[lo:hi] - done))[each - lo]
        both = bits[each] & w.in_bits[other]
        hit = np.flatnonzero(both)
        each, word, both = each[hit], w.in_word[other[hit]], both[hit]
        for bitmap, sums, place in ((whole, level.whole, k), (last, level.last, k - 1)):
            if bitmap is not None:
                may = np.flatnonzero(marked(bitmap, shared.mixed(sums[of[each]] + w.places[place][word])))
                each, word, both = each[may], word[may], both[may]
        found.append((of[each], word, blocks[each], both))
        lo = hi
    none = np.zeros(0, np.int64)
    of, word, blocks, bits = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none, none, np.zeros(0, np.uint8))
    key = of.astype(np.int64) * w.n + word
    order = np.argsort(key, kind="stable")
    key, blocks, bits = key[order], blocks[order], bits[order]
    at = np.flatnonzero(np.diff(key, prepend=-1) != 0)
    counts = np.add.reduceat(np.bitwise_count(bits).astype(np.int64), at) if len(at) else none
    of = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(key))))
    first, word = key[at] // w.n, key[at] % w.n
    return _Grown([*(x[first] for x in level.words), word], counts, of, blocks, bits, level.whole[first] + w.places[k][word] if k < len(w.places) else None, level.last[first] + w.places[k - 1][word])


def _rows(batches) -> Iterator[Shard]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Shard({n: batch.column(j)[i] for j, n in enumerate(batch.schema.names)})


def _merged(h: list[np.ndarray], f: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    h, f = np.concatenate([*h, np.zeros(0, np.uint64)]), np.concatenate([*f, np.zeros(0, np.int64)])
    order = np.argsort(h)
    h = h[order]
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[at], np.add.reduceat(f[order], at) if len(at) else f


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` a hash's low bits fall in, in their order."""
    return ((h & _LOW).astype(np.int64) * parts) >> HASH_BITS


def _hashed(bitmaps: list[bytes], bits: int, longest: int, parts: int, most: int = MERGED):
    """(part, h, f): hashes of phrases of ``longest`` words with their counts, packed by part; added up over the shards of a task as far as ``most`` of them go."""

    def found(s: Shard, frequent: list[np.ndarray]):
        if longest == 1:
            yield s.hashes & _LOW, s.counts()
        else:
            yield from ((level.hashes() & _LOW, level.counts) for level in grown(s, frequent, longest) if len(level.words) == longest)

    def packed(h: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        edges = np.flatnonzero(np.diff(_part(h, parts), prepend=-1))
        spans = list(zip(edges, np.append(edges[1:], len(h)), strict=True))
        rows = [(int(_part(h[a : a + 1], parts)[0]), _planes(np.diff(h[a:b].astype(np.int64), prepend=0), 5), _planes(f[a:b], 8)) for a, b in spans]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "h", "f"])

    def run(batches):
        frequent, h, f, size = _opened(bitmaps, bits), [], [], 0
        for s in _rows(batches):
            for x, n in found(s, frequent):
                h, f, size = [*h, x], [*f, n], size + len(x)
                if size > most:
                    x, n = _merged(h, f)
                    full = len(x) > most // 2
                    if full:
                        yield packed(x, n)
                    h, f, size = ([], [], 0) if full else ([x], [n], len(x))
        x, n = _merged(h, f)
        if len(x):
            yield packed(x, n)

    return run


def _often(least: int):
    """(h) of a part's hashes with ``least`` or more in all."""

    def run(table: pa.Table) -> pa.Table:
        h = [np.cumsum(_unplaned(x.as_buffer(), 5, np.int64)).astype(np.uint64) for x in table["h"]]
        x, n = _merged(h, [_unplaned(x.as_buffer(), 8, np.int64) for x in table["f"]])
        return pa.table([x[n >= least].astype(np.int64)], ["h"])

    return run


_NAMES = ["lang", "phrase", "f"]


def _spelled(bitmaps: list[bytes], bits: int, longest: int, parts: int, most: int = MERGED):
    """(part, rows): phrases of 1 to ``longest`` words with their counts, packed by part and added up as in ``_hashed``; under the empty phrase all words of the language."""

    def found(s: Shard, frequent: list[np.ndarray]) -> Iterator[pa.Table]:
        n, word = s.counts(), np.flatnonzero(marked(frequent[0], s.hashes))
        yield pa.table([s.langs.take(pa.array(s.of[word])), s.words.take(pa.array(word)), n[word], _part(s.hashes[word], parts)], [*_NAMES, "part"])
        total = np.bincount(s.of, weights=n, minlength=len(s.langs)).astype(np.int64)
        yield pa.table([s.langs, pa.array([""] * len(total)), total, np.zeros(len(total), np.int64)], [*_NAMES, "part"])
        for level in grown(s, frequent, longest):
            text = pc.binary_join_element_wise(*(s.words.take(pa.array(w)) for w in level.words), " ")
            yield pa.table([s.langs.take(pa.array(s.of[level.words[0]])), text, level.counts, _part(level.hashes(), parts)], [*_NAMES, "part"])

    def merged(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by(["part", "lang", "phrase"], use_threads=False).aggregate([("f", "sum")]).rename_columns(["part", *_NAMES]).select([*_NAMES, "part"])

    def packed(t: pa.Table) -> pa.RecordBatch:
        t = t.sort_by([("part", "ascending"), ("lang", "ascending"), ("phrase", "ascending")])
        part = t["part"].to_numpy()
        edges = np.flatnonzero(np.diff(part, prepend=-1))
        rows = [_ipc(t.slice(a, b - a).select(_NAMES)) for a, b in zip(edges.tolist(), np.append(edges[1:], len(part)).tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(part[edges], pa.int32()), pa.array(rows, pa.binary())], names=["part", "rows"])

    def run(batches):
        frequent, tables, size = _opened(bitmaps, bits), [], 0
        for s in _rows(batches):
            for t in found(s, frequent):
                tables.append(t)
                size += t.num_rows
            if size > most:
                t = merged(tables)
                full = t.num_rows > most // 2
                if full:
                    yield packed(t)
                tables, size = ([], 0) if full else ([t], t.num_rows)
        if tables:
            yield packed(merged(tables))

    return run


def _ipc(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(t.combine_chunks())
    return sink.getvalue().to_pybytes()


def _often_spelled(least: int):
    """(lang, phrase, f) of a part's phrases with ``least`` or more in all, and of the empty ones."""

    def run(table: pa.Table) -> pa.Table:
        rows = pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in table["rows"]])
        t = rows.group_by(_NAMES[:2], use_threads=False).aggregate([("f", "sum")]).rename_columns(_NAMES)
        return t.filter(pc.or_(pc.greater_equal(t["f"], least), pc.equal(t["phrase"], "")))

    return run


def _bitmap(hashes: DataFrame, bits: int = BITS) -> bytes:
    """A bitmap of ``bits`` bits with those of ``hashes`` (h) set, compressed; it comes in slabs of 4 KB."""
    at = F.col("h").bitwiseAND(F.lit(bits - 1))
    slabs = hashes.select(F.floor(at / _SLAB).cast("int").alias("slab"), (at % _SLAB).alias("at")).groupBy("slab").agg(F.bitmap_construct_agg("at").alias("set"))
    out = np.zeros(bits // 8, np.uint8)
    for r in slabs.collect():  # at most bits / 2**15 rows
        out[r["slab"] * _SLAB // 8 : (r["slab"] + 1) * _SLAB // 8] = np.frombuffer(r["set"], np.uint8)[: len(out)]
    return pa.compress(out.tobytes(), "zstd", asbytes=True)


def _opened(bitmaps: list[bytes], bits: int) -> list[np.ndarray]:
    return [np.frombuffer(pa.decompress(x, bits // 8, "zstd"), np.uint8) for x in bitmaps]


def frequencies(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = BITS, shard_bytes: int = SHARD_BYTES, most: int = MERGED) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of the words and phrases that occur ``least`` times or more, and (lang, n) of all word occurrences."""
    docs = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    # a row is a shard: small row groups, looked at after each row, keep few of them in memory
    small = {"parquet.block.size": str(shard_bytes), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1", "compression": "zstd"}
    shards = shared.stored(shared.mapped(docs, _shards(shard_bytes), _SHARD), **small)
    frequent: list[bytes] = []
    parts = shared.partitions(docs.sparkSession)
    for k in range(1, longest + 1):
        found = shards.mapInArrow(_hashed([*frequent], bits, k, parts, most), "part int, h binary, f binary").groupBy("part").applyInArrow(_often(least), "h long")
        with shared.freeing(docs.sparkSession):
            frequent.append(_bitmap(found, bits))
    out = shared.stored(shards.mapInArrow(_spelled([*frequent], bits, longest, parts, most), "part int, rows binary").groupBy("part").applyInArrow(_often_spelled(least), "lang string, phrase string, f long"))
    shared.removed(shards)
    return out.filter(F.col("phrase") != ""), out.filter(F.col("phrase") == "").select("lang", F.col("f").alias("n"))


def _joined(words: Column, start: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, contained: int = CONTAINED, bits: int = BITS, shard_bytes: int = SHARD_BYTES, most: int = MERGED) -> DataFrame:
    """Each language's ``top`` phrases of ``docs`` (text, lang): lang, rank, phrase, a, l, r, n, score."""
    known, totals = frequencies(docs, least, longest, bits, shard_bytes, most)
    w = F.col("w")
    found = known.withColumn("w", F.split("phrase", " ", -1)).filter(F.size(w) > 1).withColumnRenamed("f", "a")
    # longer candidates hold shorter ones
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size(w) - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: _joined(w, i, k))))
    held = found.filter(F.size(w) > 2).select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    whole = lambda x: F.col(x).cast("decimal(20,0)")
    left = found.join(held, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (whole("longer") * 100 < whole("a") * contained))
    # both parts of every cut, with their counts
    cuts = F.explode(F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda k: F.array(*(F.struct(k.alias("k"), F.lit(i).alias("side"), p.alias("part")) for i, p in enumerate((_joined(w, 1, k), _joined(w, k + 1, F.size(w))))))))
    parts = shared.stored(left.select("lang", "phrase", "a", cuts.alias("x")).select("lang", "phrase", "a", F.explode("x").alias("x")).select("lang", "phrase", "a", "x.*"))
    uses = parts.groupBy("lang", "part").agg(F.count("*").alias("uses"))
    counted = shared.stored(uses.join(known.withColumnRenamed("phrase", "part"), ["lang", "part"]))
    both = shared.join_by_key(parts, counted, ["lang", "part"], "uses").repartition("lang", "phrase")
    side = lambda i: F.max(F.when(F.col("side") == i, F.col("f")))
    scored = both.groupBy("lang", "phrase", "a", "k").agg(side(0).alias("l"), side(1).alias("r"))
    score = F.expr(f"(cast(a as decimal(20,0)) * {SCALE}) div (cast(l as decimal(20,0)) + r)").alias("score")
    best = scored.select("lang", "phrase", "a", F.struct(score, "k", "l", "r").alias("x")).groupBy("lang", "phrase", "a").agg(F.min("x").alias("x"))
    best = best.select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    out = first_rows(best, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return out.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def first_rows(rows: DataFrame, key: str, order: list[Column], top: int) -> DataFrame:
    """The first ``top`` rows of each key with their ``rank``: first of salted parts of a key, then of fewer, then of the whole."""
    salts = shared.partitions(rows.sparkSession)
    for n in (salts, int(salts**0.5)):
        if n > 1:
            rows = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(n)))
            place = F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order))
            rows = rows.withColumn("_at", place).filter(F.col("_at") <= top).drop("_at", "_salt")
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("rank", place.cast("long")).filter(F.col("rank") <= top)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: lang, rank, phrase, a, l, r, n, score."""
    return collocations(shared.table(spark, sf_dir, "documents"))


SQL = rf"""
WITH p AS (
  SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
h AS (SELECT lang, phrase, max(a) AS longer FROM (
  SELECT lang, a, unnest(flatten([[array_to_string(w[i:i + m - 1], ' ') for i in range(1, k - m + 2)] for m in range(2, k)])) AS phrase FROM c WHERE k > 2) GROUP BY ALL),
s AS (SELECT c.* FROM c LEFT JOIN h USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {CONTAINED} * a),
x AS (SELECT s.lang, s.phrase, a, cut, array_to_string(w[1:cut], ' ') AS p1, array_to_string(w[cut + 1:], ' ') AS p2 FROM s, (SELECT unnest([1, 2, 3]) AS cut) WHERE cut < k),
y AS (SELECT x.lang, x.phrase, a, cut, f1.f AS l, f2.f AS r, CAST({SCALE} * CAST(a AS HUGEINT) // (f1.f + f2.f) AS BIGINT) AS score FROM x JOIN f f1 ON f1.lang = x.lang AND f1.phrase = p1 JOIN f f2 ON f2.lang = x.lang AND f2.phrase = p2),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM y),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE o = 1)
SELECT z.lang, rank, phrase, a, l, r, n, score FROM z JOIN n USING (lang) WHERE rank <= {TOP}
"""
