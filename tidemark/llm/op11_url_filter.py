"""URL filter: rules first, and trust and distrust over the link graph for the hosts that no rule reaches.

Pages are judged by the longest rule (host and path together) that fits.  For
the others the hosts' link graph decides.  An edge leads from a page's host to
another host that pages of it link to, weighted by the number of those pages.
Trust starts at the share of a host's pages that rules allow and walks along
the links, split over what a host links to; distrust starts at the share that
rules block and walks against the links, split over what links to a host: two
personalised PageRanks, of which a share ``DAMPING`` goes on at each step, for
``STEPS`` steps at most.  A host is blocked if its distrust reaches
``THRESHOLD`` of what a wholly blocked host starts with and exceeds its trust.

Scores are whole numbers in units of 2**-32 and every edge rounds down, so
sums don't depend on their order and a walk dies out by itself.  A step sends
on only what the step before brought in.  Edges are written once, bucketed by
the host that they leave; a host with more than ``PART`` of them has them in
several buckets, and only scores are shuffled in each step.

Defined cases: a null url, or one without ``://``, has an empty host and path
and is allowed, as is a host that neither walk reaches; a path may be empty,
and then begins with no rule's path; ports and user names are part of the
host; rows that share a page_id are judged each; repeated rows count each as
pages; a null or empty html has no links; links without a host of their own
lead to the page's host and are no edges; an empty table gives an empty
result; extra columns pass through ``judge``, those named like its outputs
are replaced.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import shared


@dataclass(frozen=True)
class Rule:
    """For a host with all its subdomains, and urls whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
DAMPING = 0.85
STEPS = 32
THRESHOLD = 0.5
ONE = 1 << 32
#: Edges of a host that stand in one bucket.
PART = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A link with a host of its own: what follows ``//`` up to the next ``/``, ``?``, ``#`` or the value's end.
_WS = r"[\x20\x09-\x0D]"
LINK = rf"""(?i)[\x20\x09-\x0D"'/]href{_WS}*+={_WS}*+["']?+{_WS}*+(?:https?:)?//([^/?#"'<>\x20\x09-\x0D]+)"""


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(name, verdict) of the longest rule that fits, or null."""
    fits = [F.when(((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path)), F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))) for r in sorted(rules, key=lambda r: (-len(r.name), r.name))]
    return F.coalesce(*fits, F.lit(None).cast("struct<name:string,verdict:string>"))


def links(pages: DataFrame) -> DataFrame:
    """(source, target, w): for each pair of different hosts the pages (host, html) of the one that link to the other."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda x: F.translate(x, _UPPER, _LOWER)))
    each = pages.filter(F.col("host") != "").select(F.col("host").alias("source"), F.explode(found).alias("target"))
    return each.filter(F.col("source") != F.col("target")).groupBy("source", "target").agg(F.count("*").alias("w"))


def _table(df: DataFrame, keys: list[str]) -> str:
    """Write bucketed and sorted by ``keys`` into the shared folder."""
    spark, name = df.sparkSession, f"host_edges_{uuid.uuid4().hex}"
    n = shared.partitions(spark)
    with shared.freeing(spark):
        df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).sortBy(*keys).option("path", f"{shared.shared_dir(spark)}/{name}").saveAsTable(name)
    return name


def propagated(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, steps: int = STEPS, part: int = PART) -> DataFrame:
    """(kind, host, score) of two walks: ``seeds`` (kind, host, score) go on along ``edges`` (source, target, w) if of kind 1, against them if of kind 0."""
    spark = edges.sparkSession
    edges = shared.stored(edges)
    if edges.isEmpty():
        return seeds
    way = [F.struct(F.lit(1).alias("kind"), F.col("source").alias("host"), F.col("target").alias("to")), F.struct(F.lit(0).alias("kind"), F.col("target").alias("host"), F.col("source").alias("to"))]
    both = edges.select("w", F.explode(F.array(*way)).alias("x")).select("x.*", "w")
    degrees = shared.stored(both.groupBy("kind", "host").agg(F.sum("w").alias("total"), F.count("*").alias("n")))
    parts = F.ceil(F.col("n") / part).cast("int")
    shares = shared.join_by_key(shared.stored(both), degrees.withColumn("parts", parts).withColumn("uses", F.col("n")), ["kind", "host"], "uses")
    share = (F.lit(damping) * F.col("w") / F.col("total")).alias("share")
    shares = shares.select("kind", "host", F.pmod(F.xxhash64("to"), F.col("parts")).cast("int").alias("part"), "to", share)
    # where a score goes on, it must know in how many buckets
    onward = degrees.select("kind", F.col("host").alias("to"), parts.alias("to_parts"))
    uses = shares.groupBy("kind", "to").agg(F.count("*").alias("uses")).join(onward, ["kind", "to"], "left")
    shares = shared.join_by_key(shared.stored(shares), shared.stored(uses), ["kind", "to"], "uses")
    name = _table(shares, ["kind", "host", "part"])
    here = seeds.join(degrees.select("kind", "host", parts.alias("parts")), ["kind", "host"], "left").select("kind", "host", "score", "parts")
    walked = [seeds]
    for _ in range(steps):
        out = here.filter(F.col("parts").isNotNull() & (F.col("score") > 0)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        sent = F.floor(F.col("score").cast("double") * F.col("share"))
        got = out.join(spark.table(name), ["kind", "host", "part"]).groupBy("kind", "to").agg(F.sum(sent).alias("score"), F.max("to_parts").alias("parts"))
        here = shared.stored(got.filter(F.col("score") > 0).select("kind", F.col("to").alias("host"), "score", "parts"))
        if here.isEmpty():
            break
        walked.append(here.select("kind", "host", "score"))
    total = shared.stored(reduce(DataFrame.unionByName, walked).groupBy("kind", "host").agg(F.sum("score").alias("score")))
    table = spark.table(name)
    shared.removed(table)
    spark.sql(f"DROP TABLE {name}")
    return total


def host_verdicts(pages: DataFrame, damping: float = DAMPING, steps: int = STEPS, threshold: float = THRESHOLD, part: int = PART) -> DataFrame:
    """(host, pages, verdict, trust, distrust) for the hosts of ``pages`` (host, found, html)."""
    share = lambda v: F.floor(F.sum((F.col("found.verdict") == v).cast("int")) * float(ONE) / F.count("*"))
    hosts = pages.groupBy("host").agg(F.count("*").alias("pages"), F.coalesce(share("allow"), F.lit(0)).alias("allowed"), F.coalesce(share("block"), F.lit(0)).alias("blocked"))
    hosts = shared.stored(hosts)
    seeds = hosts.select("host", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("score")) for k, c in ((1, "allowed"), (0, "blocked"))))).alias("x")).select("x.kind", "host", "x.score").filter(F.col("score") > 0)
    score = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0))
    scores = propagated(seeds, links(pages), damping, steps, part).groupBy("host").agg(score(1).alias("trust"), score(0).alias("distrust"))
    got = hosts.select("host", "pages").join(scores, "host", "left").fillna(0, ["trust", "distrust"])
    bad = (F.col("distrust") >= int(threshold * ONE)) & (F.col("distrust") > F.col("trust"))
    return got.withColumn("verdict", F.when(bad, "block").otherwise("allow"))


def judge(pages: DataFrame, rules=RULES, damping: float = DAMPING, steps: int = STEPS, threshold: float = THRESHOLD, part: int = PART) -> DataFrame:
    """``pages`` (with url, html) without the html but with host, path, rule and verdict."""
    own = ["html", "host", "path", "rule", "verdict"]
    rest = [c for c in pages.columns if c not in own]
    # the caller's columns travel in one, so that none of their names can clash
    host, path = split_url(F.col("url"))
    rows = pages.select(F.struct(*(f"`{c}`" for c in rest)).alias("row"), F.col("url").cast("string").alias("url"), "html").select("row", "html", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    per_host = shared.stored(host_verdicts(rows, damping, steps, threshold, part).select("host", "pages", F.col("verdict").alias("method")))
    got = shared.join_by_key(rows.drop("html"), per_host, ["host"], "pages")
    return got.select(*(F.col("row").getField(c).alias(c) for c in rest), "host", "path", F.col("found.name").alias("rule"), F.coalesce("found.verdict", "method").alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: page_id, host, path, rule, verdict."""
    return judge(shared.table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    """The walks step by step; DuckDB's patterns need no possessive repeats."""
    q = lambda x: x.replace("'", "''")
    rules = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)
    steps = ""
    for i in range(STEPS):
        steps += f""",
x{i + 1} AS MATERIALIZED (SELECT e.kind, e.tgt AS host, CAST(sum(CAST(floor(CAST(x.score AS DOUBLE) * e.share) AS BIGINT)) AS BIGINT) AS score FROM x{i} x JOIN s e ON e.kind = x.kind AND e.host = x.host GROUP BY ALL)"""
    walked = " UNION ALL ".join(f"SELECT * FROM x{i}" for i in range(STEPS + 1))
    return rf"""
WITH u AS (SELECT page_id, html, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT row_number() OVER () AS id, page_id, html, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r AS (SELECT * FROM (VALUES {rules}) r(rhost, rpath, verdict)),
f AS (SELECT id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY id),
k AS MATERIALIZED (SELECT p.*, f.rule, f.verdict FROM p LEFT JOIN f USING (id)),
h AS MATERIALIZED (SELECT host, CAST(floor(count(*) FILTER (WHERE verdict = 'allow') * {float(ONE)} / count(*)) AS BIGINT) AS allowed, CAST(floor(count(*) FILTER (WHERE verdict = 'block') * {float(ONE)} / count(*)) AS BIGINT) AS blocked FROM k GROUP BY host),
l AS MATERIALIZED (SELECT host AS src, tgt, count(*) AS w FROM (
  SELECT host, unnest(list_distinct(list_transform(regexp_extract_all(html, '{q(LINK.replace('*+', '*').replace('?+', '?'))}', 1), lambda x: translate(x, '{_UPPER}', '{_LOWER}')))) AS tgt FROM k WHERE host <> '') WHERE host <> tgt GROUP BY ALL),
b AS (SELECT 1 AS kind, src AS host, tgt, w FROM l UNION ALL SELECT 0, tgt, src, w FROM l),
s AS MATERIALIZED (SELECT kind, host, tgt, {DAMPING} * w / sum(w) OVER (PARTITION BY kind, host) AS share FROM (SELECT kind, host, tgt, CAST(w AS DOUBLE) AS w FROM b)),
x0 AS MATERIALIZED (SELECT 1 AS kind, host, allowed AS score FROM h WHERE allowed > 0 UNION ALL SELECT 0, host, blocked FROM h WHERE blocked > 0){steps},
t AS (SELECT host, coalesce(sum(score) FILTER (WHERE kind = 1), 0) AS trust, coalesce(sum(score) FILTER (WHERE kind = 0), 0) AS distrust FROM ({walked}) GROUP BY host)
SELECT page_id, k.host, path, rule, coalesce(verdict, CASE WHEN distrust >= {int(THRESHOLD * ONE)} AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict FROM k LEFT JOIN t ON t.host = k.host
"""


SQL = _sql()
