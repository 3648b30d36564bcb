"""N-gram Jaccard join with multiple-global-order filtering.

A document is the set of its distinct word shingles.  Equal sets collapse to
one representative first.  A pair of sets that is similar enough must share
tokens in the prefix of any global order of the tokens, so candidates are
filtered by several:

* by token hash: each set sends only its prefix, lengthened so that a
  similar pair shares not one but ``l`` tokens in it (about twice the plain
  prefix);
* over those tokens by their document frequency, rarest first: a set whose
  prefix holds only tokens that no other set has, has no partner;
* over the same tokens by two more hashes.

A candidate pair must share a prefix token under the last three orders,
intersected, before its whole sets are fetched and compared exactly.  Tokens
of a candidate's whole set that no other candidate has are counted once; a
pair is a candidate only if both sets have enough other tokens.

Posting lists are never expanded into all pairs at once.  Two rounds compare
every set with one leader of its lists, the components of the links found
are labelled, and then only lists that still hold several components give
pairs, and only between different components.  A link inside a component
can't change the result, and no other candidate is left out.  Long lists are
joined apart or in parts of ``LIST`` postings, and so are the pairs of a set
that has very many, so no token and no leader meets in one task.

Defined cases: a null or empty text, or one without words, has the empty set
and no links; with fewer words than a shingle the whole sequence is one
shingle; equal sets are one class; rows that share a doc_id are one
document, linked by what either text is similar to, each with the size of
its own set; a row without doc_id keeps a null component; an empty table gives
an empty result; extra columns are ignored.  Tokens are 64-bit hashes, sets
are told apart by 128 bits.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import shared

#: Ids of candidate documents are broadcast up to this many, beyond it they are joined.
BROADCAST_IDS = 1_000_000
#: Salts of the two further token orders.
ORDERS = (2, 3)
#: Postings of a list, and pairs of a set, that one task joins; longer ones are split.
LIST = 1000
#: First prefix tokens by which a pair that an earlier token gives already is known; later repeats are dropped afterwards.
HEAD = 64


def _place(j: int) -> np.uint64:
    """What the hash of a shingle's word ``j`` is shifted by, so that order counts."""
    return np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64))


def shingle_sets(t: shared.Texts, words: int) -> list[np.ndarray]:
    """Of each text the sorted hashes of its distinct shingles."""
    low = shared.Texts(shared.lowered(t.buf), t.starts, t.ends, t.first)
    starts, ends, first = shared.word_bounds(low)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * len(t)
    h = shared.span_hashes(low.buf, starts, ends)
    n = len(h) - words + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for j in range(words):
        if n > 0:
            rolled += shared.mixed(h[j : j + n] + _place(j))
    rolled = shared.mixed(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            short = sum((shared.mixed(h[a + j : a + j + 1] + _place(j)) for j in range(b - a)), np.full(1, b - a, np.uint64))
            out.append(shared.mixed(short))
        else:
            out.append(h[:0])
    return out


def _need(n: int, num: int, den: int) -> int:
    return -(-num * n // den)


def _extended(n: int, num: int, den: int) -> int:
    """Length of the hash-order prefix: two similar sets share at least ``_least`` tokens in theirs."""
    need = _need(n, num, den)
    return n - need + min(n - need + 1, need)


def _least(n: Column, num: int, den: int) -> Column:
    """How many tokens of its prefix a set of size ``n`` must share with any similar one, that one perhaps smaller."""

    def need(x: Column) -> Column:
        return F.floor((x * num + (den - 1)) / F.lit(den)).cast("int")

    small = need(n)
    return F.least(small - need(small) + 1, need(small))


def _signatures(words: int, num: int, den: int):
    def run(batches):
        for batch in batches:
            for t in shared.chunks(batch.column("text")):
                sets = shingle_sets(t, words)
                n = np.array([len(s) for s in sets], np.int32)
                d = np.array([[int(shared.mixed(s ^ np.uint64(k)).sum(dtype=np.uint64)) for k in (0x5851F42D4C957F2D, 0x14057B7EF767814F)] for s in sets], np.uint64).reshape(-1, 2)
                ext = [s[: _extended(len(s), num, den)] if len(s) else s for s in sets]
                at = np.append(0, np.cumsum([len(e) for e in ext])).astype(np.int32)
                flat = np.concatenate([*ext, np.zeros(0, np.uint64)]).view(np.int64)
                arrays = [batch.column("doc_id").slice(t.first, len(t)), pa.array(n), pa.array(d[:, 0].copy().view(np.int64)), pa.array(d[:, 1].copy().view(np.int64)), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "d1", "d2", "ext"])

    return run


def _sets(words: int):
    def run(batches):
        for batch in batches:
            for t in shared.chunks(batch.column("text")):
                sets = shingle_sets(t, words)
                at = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(t.first, len(t)), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["rep", "tokens"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of all nodes of ``links`` (a, b): the smallest node each can reach; alternating large and small stars."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    edges = shared.checkpoint(edges)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # stored, so that the join has an exchange on either side and the edges of a hub can be split
        low = shared.stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v")).filter("u > v").distinct()
        edges = shared.checkpoint(small)
        shared.removed(low)
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == before:
            break
        before = now
    found = edges.groupBy("u").agg(F.min("v").alias("comp")).withColumnRenamed("u", "node")
    return found.unionByName(found.select(F.col("comp").alias("node"), "comp").distinct())


class _Join:
    """One join: candidates, whole sets and what has been linked so far."""

    def __init__(self, docs: DataFrame, cand: DataFrame, words: int, num: int, den: int):
        self.spark, self.cand, self.num, self.den = docs.sparkSession, cand, num, den
        ids = cand.select(F.col("rep").alias("doc_id"))
        few = cand.count() <= BROADCAST_IDS
        mine = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
        self.name = f"shingle_sets_{uuid.uuid4().hex}"
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None
        buckets = shared.partitions(self.spark)
        path = f"{shared.shared_dir(self.spark)}/{self.name}"
        sets = shared.mapped(mine.select("doc_id", "text"), _sets(words), "rep long, tokens array<long>")
        with shared.freeing(self.spark):
            sets.repartition(buckets, "rep").write.format("parquet").bucketBy(buckets, "rep").sortBy("rep").option("path", path).saveAsTable(self.name)

    def count_tokens(self) -> None:
        """The posting lists of sets that have enough tokens in common with others."""
        # tokens that no other candidate has can't be shared: ``m`` counts the others
        own = self.spark.table(self.name).select("rep", F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("df"), F.min("rep").alias("rep"))
        alone = own.filter("df = 1").groupBy("rep").agg(F.count("*").alias("alone"))
        posts = self.cand.join(alone, "rep", "left").withColumn("m", F.col("n") - F.coalesce("alone", F.lit(0)))
        # a set must share this many tokens with any similar one
        posts = posts.filter(F.col("m") * self.den >= F.col("n") * self.num)
        self.posts = shared.stored(posts.select("rep", "n", "m", F.posexplode("q1").alias("place", "t")))

    def close(self) -> None:
        shared.removed(self.spark.table(self.name))
        self.spark.sql(f"DROP TABLE {self.name}")

    def lists(self, salt: int) -> tuple[DataFrame, DataFrame]:
        """Postings with their components, and the lists that hold several: t, size, and a leader ``l``."""
        posts = self.posts
        if self.labels is None:
            posts = posts.withColumn("comp", F.col("rep"))
        else:
            known = self.labels.withColumnRenamed("node", "rep")
            posts = shared.stored(posts.join(known, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")))
        by = F.struct(F.xxhash64("rep", F.lit(salt)) if salt else F.col("rep"), "rep")
        each = posts.groupBy("t").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"), F.min_by(F.struct("rep", "n", "m", "comp"), by).alias("l"))
        return posts, shared.stored(each.filter("lo < hi").drop("lo", "hi"))

    def leader_pairs(self, salt: int) -> DataFrame:
        """Every set with one leader of its lists, the one that leads most of them."""
        posts, lists = self.lists(salt)
        met = shared.join_by_key(posts, lists, ["t"], "size").filter((F.col("l.comp") != F.col("comp")) & self._sizes("n", "m", "l.n", "l.m"))
        met = met.groupBy("rep", F.col("l.rep").alias("a")).agg(F.count("*").alias("c"))
        best = met.groupBy("rep").agg(F.max_by("a", F.struct(F.col("c"), -F.col("a"))).alias("a"))
        return best.select("a", F.col("rep").alias("b"))

    def rest(self) -> DataFrame:
        """All candidate pairs between different components, most of them only from the first token that both prefixes hold."""
        posts, lists = self.lists(0)
        parts = lists.select("t", "size", F.ceil(F.col("size") / F.lit(LIST)).cast("int").alias("parts"))
        posts = shared.join_by_key(posts, parts, ["t"], "size").join(self.cand.select("rep", F.slice("q1", F.lit(1), F.lit(HEAD)).alias("head")), "rep")
        before = F.slice("head", F.lit(1), F.least("place", F.lit(HEAD)))
        posts = shared.stored(posts.select("t", "rep", "n", "m", "comp", "parts", before.alias("before")))
        # one side of a long list is dealt to its parts, the other goes to each
        x = posts.select("t", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"), F.col("rep").alias("a"), F.col("n").alias("na"), F.col("m").alias("ma"), F.col("comp").alias("ca"), F.col("before").alias("ba"))
        y = posts.select("t", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("m").alias("mb"), F.col("comp").alias("cb"), F.col("before").alias("bb"))
        on = (x["t"] == y["t"]) & (x["part"] == y["part"]) & (F.col("ca") != F.col("cb")) & (F.col("a") < F.col("b")) & self._sizes("na", "ma", "nb", "mb") & ~F.arrays_overlap("ba", "bb")
        return x.join(y, on).select("a", "b").distinct()

    def _sizes(self, na: str, ma: str, nb: str, mb: str) -> Column:
        """Whether two sets have enough tokens that they could share: similar ones share num / (num + den) of both sizes together."""
        return F.least(ma, mb) * (self.num + self.den) >= (F.col(na) + F.col(nb)) * self.num

    def _many(self, pairs: DataFrame, side: str) -> DataFrame:
        """The sets with more than ``LIST`` pairs, and into how many parts these are split."""
        return pairs.groupBy(side).count().filter(F.col("count") > LIST).select(F.col(side).alias("rep"), F.ceil(F.col("count") / F.lit(LIST)).cast("int").alias("parts"))

    def _with_sets(self, pairs: DataFrame, side: str, tokens: str, many: DataFrame) -> DataFrame:
        """``pairs`` with the whole sets of one side; of a set with very many pairs copies go to several tasks."""
        sets = self.spark.table(self.name)
        pairs = pairs.withColumnRenamed(side, "rep")
        # the sets' own column is the key, so their buckets stay where they are
        if many.isEmpty():
            return pairs.join(sets, "rep").withColumnsRenamed({"rep": side, "tokens": tokens})
        few = pairs.join(many, "rep", "left_anti").join(sets, "rep")
        dealt = pairs.join(many, "rep").withColumn("part", F.pmod(F.xxhash64("a" if side == "b" else "b"), F.col("parts")).cast("int")).drop("parts")
        copies = sets.join(many, "rep").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        return few.unionByName(dealt.join(copies, ["rep", "part"]).drop("part")).withColumnsRenamed({"rep": side, "tokens": tokens})

    def verify(self, pairs: DataFrame) -> bool:
        """Intersect the other orders' filters, then compare whole sets; returns whether any new link was found."""
        own = self.cand.select("rep", *(f"q{k}" for k in ORDERS))
        for side in ("a", "b"):
            pairs = pairs.join(own.select(F.col("rep").alias(side), *(F.col(f"q{k}").alias(f"{side}{k}") for k in ORDERS)), side)
        for k in ORDERS:
            pairs = pairs.filter(F.arrays_overlap(f"a{k}", f"b{k}"))
        pairs = shared.stored(pairs.select("a", "b"))
        many = {side: shared.checkpoint(self._many(pairs, side)) for side in ("a", "b")}
        full = self._with_sets(self._with_sets(pairs, "b", "tb", many["b"]), "a", "ta", many["a"])
        both = F.size(F.array_intersect("ta", "tb"))
        links = full.filter(both * self.den >= (F.size("ta") + F.size("tb") - both) * self.num).select("a", "b")
        links = shared.checkpoint(links)
        if links.isEmpty():
            return False
        self.links = links if self.links is None else self.links.unionByName(links)
        self.labels = shared.checkpoint(components(self.links))
        return True


def similar(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of ``docs`` (doc_id, text); linked are sets of similarity num / den or more."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    again = shared.stored(docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1"))
    if again.isEmpty():
        return _similar(docs, words, num, den)
    # rows of one document are compared under ids of their own, below all others, and linked with each other afterwards
    least = docs.agg(F.least(F.min("doc_id"), F.lit(0).cast("long"))).first()[0]
    own = shared.stored(shared.join_by_key(docs, again, ["doc_id"], "rows").withColumn("own", F.lit(least - 1) - F.monotonically_increasing_id()))
    single = docs.join(again, "doc_id", "left_anti")
    got = shared.stored(_similar(single.unionByName(own.select(F.col("own").alias("doc_id"), "text")), words, num, den).withColumnRenamed("doc_id", "own"))
    rows = shared.stored(got.join(own.select("own", "doc_id"), "own", "left").select(F.coalesce("doc_id", "own").alias("doc_id"), "n_shingles", F.col("component_id").alias("node")))
    # the components that share a document, linked with the smallest of them
    shares = rows.join(again, "doc_id", "left_semi").select("doc_id", "node").distinct()
    links = shares.join(shares.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").select(F.col("node").alias("a"), "b")
    labels = components(links)
    sizes = rows.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("size")).join(labels, "node", "left")
    sizes = shared.stored(sizes.select("node", "first", "size", F.coalesce("comp", "node").alias("comp")))
    ends = sizes.groupBy("comp").agg(F.min("first").alias("component_id"))
    named = shared.stored(sizes.join(ends, "comp").select("node", "size", "component_id"))
    out = shared.join_by_key(rows.filter(F.col("node").isNotNull()), named, ["node"], "size").select("doc_id", "n_shingles", "component_id")
    return out.unionByName(rows.filter(F.col("node").isNull()).select("doc_id", "n_shingles", F.col("node").alias("component_id")))


def _similar(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """``similar`` for ids that occur once (or are null)."""
    sig = shared.stored(shared.mapped(docs, _signatures(words, num, den), "doc_id long, n int, d1 long, d2 long, ext array<long>"))
    ids = shared.stored(sig.select("doc_id", "n", "d1", "d2"))
    reps = sig.filter((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.first("ext").alias("ext"))
    reps = shared.stored(reps.select("rep", "n", "ext"))
    shared.removed(sig)
    posts = reps.select("rep", "n", F.explode("ext").alias("t"))
    several = shared.stored(posts.groupBy("t").agg(F.count("*").alias("df")).filter("df > 1"))
    mine = shared.join_by_key(posts, several.withColumn("size", F.col("df")), ["t"], "size").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("l"))
    quota = F.size("l") - _least(F.col("n"), num, den) + 1
    cand = mine.withColumn("k", quota).filter("k > 0")

    def prefix(order: int) -> Column:
        salted = F.array_sort(F.transform("l", lambda x: F.struct(F.xxhash64(x["t"], F.lit(order)).alias("h"), x["t"].alias("t"))))
        return F.transform(F.slice(salted, F.lit(1), F.col("k")), lambda x: x["t"]).alias(f"q{order}")

    first = F.transform(F.slice("l", F.lit(1), F.col("k")), lambda x: x["t"]).alias("q1")
    cand = shared.stored(cand.select("rep", "n", first, *(prefix(k) for k in ORDERS)))
    shared.removed(reps, several)
    join = _Join(docs, cand, words, num, den)
    try:
        join.count_tokens()
        for salt in (0, 1):
            join.verify(join.leader_pairs(salt))
        join.verify(join.rest())
    finally:
        join.close()
    shared.removed(cand, join.posts)
    by_set = ids.filter((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"))
    if join.labels is not None:
        by_set = by_set.join(join.labels.withColumnRenamed("node", "rep"), "rep", "left")
    else:
        by_set = by_set.withColumn("comp", F.lit(None).cast("long"))
    by_set = shared.stored(by_set.select("d1", "d2", "size", F.coalesce("comp", "rep").alias("component_id")))
    # copies of one set may be a third of all rows; a set of its own needs no table
    out = shared.join_by_key(ids.filter("n > 0 AND doc_id IS NOT NULL"), by_set, ["d1", "d2"], "size").select("doc_id", "n", "component_id")
    out = out.unionByName(ids.filter("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: doc_id, n_shingles, component_id at three words and 90 in 100."""
    return similar(shared.table(spark, sf_dir, "documents"), 3, 90, 100)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w
), n AS (SELECT doc_id, len(s) AS n FROM s),
t AS (SELECT doc_id, unnest(s) AS t FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS inter FROM t x JOIN t y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 90 * (x.n + y.n - inter)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a)
SELECT n.doc_id, CAST(any_value(n.n) AS BIGINT) AS n_shingles, min(r.reach) AS component_id
FROM n JOIN r ON r.node = n.doc_id GROUP BY n.doc_id
"""
