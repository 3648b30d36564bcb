"""Secret scan over an incremental blob ledger, in DataFrame functions only.

Every version of every document is addressed by the SHA-256 of its text.  The
ledger is a table in the shared folder that holds, for each (blob, rule
version) ever scanned, the spans found.  A scan takes only the pairs that the
ledger lacks, one text per blob, appends all of them to the ledger, those
without findings included, and joins what the ledger knows back to all paths.

Defined cases: a null text is the empty blob; equal texts are scanned once
and every row of theirs gets the findings; texts of any length are scanned
whole; a match that fails its length test is dropped but still consumes its
characters, as in one leftmost pass; an empty table gives an empty result;
extra columns of any name pass through ``scan``, those named like its outputs
are replaced.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import shared


@dataclass(frozen=True)
class Rule:
    """``name:start:end`` for each leftmost match of ``pattern`` whose ``group`` has at least ``least`` characters."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


#: The base kinds in their order.  Runs shorter than the least length can't hold a longer match, so the
#: length test of ``access`` and ``hex`` stands in the pattern.
BASE = (
    Rule("assign", 1, r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", 1, r"[0-9a-f]{24,}", base=True),
)
#: Kinds that the method adds.
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE + MORE
_SPAN = "array<struct<start:int,kind:int,end:int>>"
_LEDGER = f"blob string, rule string, found {_SPAN}"


def spans(text: Column, rule: Rule, kind: int) -> Column:
    """(start, kind, end) of the rule's matches, in code points: running sums over the pieces between matches."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    parts = F.split(text, rule.pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(_SPAN).alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        lo = acc["at"] + F.length(piece["0"])
        hi = lo + F.coalesce(F.length(piece["1"]), F.lit(0))
        ok = piece["1"].isNotNull()
        if rule.least:
            ok &= F.length(F.regexp_extract(piece["1"], rule.pattern, rule.group)) >= rule.least
        found = F.array(F.struct(lo.alias("start"), F.lit(kind).alias("kind"), hi.alias("end")))
        out = F.coalesce(acc["out"], F.array().cast(_SPAN))
        return F.struct(hi.alias("at"), F.when(ok, F.concat(out, found)).otherwise(out).alias("out"))

    walked = F.aggregate(F.arrays_zip(parts, hits), start, step, lambda acc: acc["out"])
    return F.when(F.size(hits) > 0, walked).otherwise(F.array().cast(_SPAN))


def scan_blobs(blobs: DataFrame, rules, ledger: DataFrame) -> DataFrame:
    """(blob, rule, found) for the pairs of ``blobs`` (blob, text) and rule versions that ``ledger`` (blob, rule, ...) lacks."""
    keys = F.array(*(F.lit(r.key) for r in rules))
    todo = blobs.withColumn("todo", keys)
    if not ledger.isEmpty():
        have = ledger.groupBy("blob").agg(F.collect_set("rule").alias("have"))
        todo = blobs.join(have, "blob", "left").withColumn("todo", F.array_except(keys, F.coalesce("have", F.array().cast("array<string>"))))
        todo = todo.filter(F.size("todo") > 0)
    each = [F.when(F.array_contains("todo", r.key), F.struct(F.lit(r.key).alias("rule"), spans(F.col("text"), r, i).alias("found"))) for i, r in enumerate(rules)]
    return todo.select("blob", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("x")).select("blob", "x.rule", "x.found")


def text_of(found: Column, rules=RULES) -> Column:
    """``kind:start:end`` by start, then kind as listed, then end, comma-joined."""
    names = F.array(*(F.lit(r.name) for r in rules))
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


class Ledger:
    """Scanned (blob, rule) pairs in Parquet files of one folder; later scans may open it again by its path."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared.shared_dir(spark)}/ledger-{uuid.uuid4().hex}"

    def rows(self) -> DataFrame:
        """(blob, rule, found) of all pairs scanned so far."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], _LEDGER)
        return self.spark.read.schema(_LEDGER).parquet(self.path)

    def add(self, new: DataFrame) -> None:
        with shared.freeing(self.spark):
            new.write.mode("append").parquet(self.path)


def scan(versions: DataFrame, rules=RULES, ledger: Ledger | None = None) -> DataFrame:
    """``versions`` (with ``text``) without the text but with ``blob`` and ``found``; pairs that ``ledger`` (None: a new one) lacks are scanned and added to it."""
    ledger = ledger or Ledger(versions.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rest = [c for c in versions.columns if c not in ("text", "blob", "found")]
    # the caller's columns travel in one, so that none of their names can clash
    addressed = versions.select(F.struct(*(f"`{c}`" for c in rest)).alias("row") if rest else F.lit(0).alias("row"), F.sha2(text, 256).alias("blob"), text.alias("text"))
    # one text per blob: copies collapse before the shuffle
    ledger.add(scan_blobs(addressed.select("blob", "text").dropDuplicates(["blob"]), rules, ledger.rows()))
    keys = [r.key for r in rules]
    known = ledger.rows().filter((F.size("found") > 0) & F.col("rule").isin(keys))
    place = F.create_map(*(F.lit(x) for i, k in enumerate(keys) for x in (k, i)))
    renumbered = F.transform("found", lambda x: F.struct(x["start"].alias("start"), F.element_at(place, F.col("rule")).alias("kind"), x["end"].alias("end")))
    # two scans at once may both have added a pair; its spans count once
    per_blob = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list(renumbered))).alias("found"))
    out = addressed.select("row", "blob").join(per_blob, "blob", "left")
    return out.select(*(F.col("row").getField(c).alias(c) for c in rest), "blob", F.coalesce("found", F.array().cast(_SPAN)).alias("found"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    got = scan(docs)
    base = F.filter("found", lambda x: x["kind"] < len(BASE))

    def count(i: int) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == i)).cast("long").alias(f"n_{BASE[i].name}")

    return got.select("doc_id", *(count(i) for i in range(len(BASE))), F.sha2(text_of(base), 256).alias("base_sha256"), text_of(F.col("found")).alias("spans"))


def _sql() -> str:
    """One pass per rule: gaps and hits of the pattern, with running lengths."""

    def per(i: int, r: Rule) -> str:
        pattern = r.pattern.replace("'", "''")
        test = f"length(regexp_extract(hit, '{pattern}', {r.group})) >= {r.least}" if r.least else "true"
        return f"""
  SELECT doc_id, start, {i} AS kind, start + length(hit) AS stop FROM (
    SELECT doc_id, hit, CAST(sum(length(gap) + coalesce(length(before), 0)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS start FROM (
      SELECT doc_id, i, gaps[i] AS gap, hits[i] AS hit, CASE WHEN i > 1 THEN hits[i - 1] END AS before FROM (
        SELECT doc_id, gaps, hits, unnest(range(1, len(hits) + 1)) AS i FROM (
          SELECT doc_id, regexp_split_to_array(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS hits FROM documents WHERE text IS NOT NULL)))
  ) WHERE {test}"""

    names = "[" + ", ".join(f"'{r.name}'" for r in RULES) + "]"
    one = f"{names}[kind + 1] || ':' || start || ':' || stop"
    counts = ", ".join(f"count(f.start) FILTER (WHERE kind = {i}) AS n_{r.name}" for i, r in enumerate(BASE))
    return f"""
WITH f AS ({" UNION ALL ".join(per(i, r) for i, r in enumerate(RULES))})
SELECT d.doc_id, {counts},
       sha256(coalesce(string_agg({one}, ',' ORDER BY start, kind, stop) FILTER (WHERE kind < {len(BASE)}), '')) AS base_sha256,
       coalesce(string_agg({one}, ',' ORDER BY start, kind, stop) FILTER (WHERE kind IS NOT NULL), '') AS spans
FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id GROUP BY d.doc_id
"""


SQL = _sql()
