"""URL filter, whitening and phrases against plain versions on small tables, with odd rows."""

import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import op11_url_filter as urls
from tidemark.llm import op12_whitening as white
from tidemark.llm import op13_phrases as phrases

# -- URL filter ----------------------------------------------------------------

PAGE = "page_id long, url string, html string, host string"


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def plain_rule(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def plain_links(html):
    return {x.lower() for x in re.findall(r"""(?i)[\s"'/]href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'<>\s]+)""", html or "")}


def walks(pages, rules, steps):
    """Trust and distrust of each host by dense matrices."""
    of = [(plain_url(u), h) for _, u, h, _ in pages]
    verdict = [(r.verdict if (r := plain_rule(*x, rules)) else None) for x, _ in of]
    edges = Counter((x[0], t) for x, h in of if x[0] for t in plain_links(h) if t != x[0])
    hosts = sorted({x[0] for x, _ in of} | {b for _, b in edges})
    at = {h: i for i, h in enumerate(hosts)}
    m = np.zeros((len(hosts),) * 2)
    for (a, b), w in edges.items():
        m[at[a], at[b]] = w
    n = np.array([max(1, sum(x[0] == h for x, _ in of)) for h in hosts])
    out = []
    for name, w in (("allow", m), ("block", m.T)):
        seed = np.array([sum(x[0] == h and v == name for (x, _), v in zip(of, verdict, strict=True)) for h in hosts]) / n
        p = w / np.maximum(w.sum(1, keepdims=True), 1)
        total, here = seed.copy(), seed
        for _ in range(steps):
            here = urls.DAMPING * here @ p
            total += here
        out.append(dict(zip(hosts, total, strict=True)))
    return out, verdict


def web(seed=5):
    r = np.random.default_rng(seed)
    hosts = [f"h{i}.{'example.com' if i % 3 else 'net' if i % 2 else 'org'}" for i in range(30)]
    pages = []
    for i in range(400):
        host = hosts[0] if i % 3 == 0 else hosts[r.integers(30)]
        to = [hosts[j] for j in r.integers(0, 30, r.integers(0, 4))]
        html = " ".join(f"""<a class=x HREF = "{('http://', '//', 'https://')[k % 3]}{t.upper() if k % 2 else t}/a?b">x</a> <a href="/own">y</a>""" for k, t in enumerate(to))
        pages.append((i, f"http://{host.upper() if i % 7 == 0 else host}/{('en', 'fr', 'es', 'de')[r.integers(4)]}/{i}?q=/en/#z", html, "x"))
    odd = [(400, None, None, "x"), (401, "no scheme", "<a href='//h1.example.com'>", "x"), (402, "://", "", None), (403, "a://H5.NET", "", None), (404, "http://net/fr/", None, None), (404, "http://u:p@x.example.com:80/en/", None, None), (None, "http://notnet/es/?", "<a href=", None), (405, "x://a.b://c/es/", "", "")]
    return pages + odd + pages[:5]


@pytest.mark.parametrize("part", [urls.PART, 2])
def test_urls(spark, part):
    pages = web()
    got = urls.judge(spark.createDataFrame(pages, PAGE), part=part, steps=6)
    assert set(got.columns) == {"page_id", "url", "host", "path", "rule", "verdict"}
    (trust, distrust), ruled = walks(pages, urls.RULES, 6)
    want = []
    for (p, u, _, _), v in zip(pages, ruled, strict=True):
        host, path = plain_url(u)
        r = plain_rule(host, path, urls.RULES)
        bad = distrust[host] >= urls.THRESHOLD and distrust[host] > trust[host]
        assert abs(distrust[host] - urls.THRESHOLD) > 1e-6 or distrust[host] in (0.5,)
        want.append((p, host, path, r and r.name, v or ("block" if bad else "allow")))
    assert sorted(map(str, ((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()))) == sorted(map(str, want))
    assert {v for *_, v in want if _[3] is None} == {"allow", "block"}


def test_walks(spark):
    pages = web(9)
    rows = spark.createDataFrame(pages, PAGE).drop("host")
    from pyspark.sql import functions as F

    host, path = urls.split_url(F.col("url"))
    rows = rows.withColumn("host", host).withColumn("found", urls.rule_of(host, path))
    got = {r["host"]: (r["trust"] / urls.ONE, r["distrust"] / urls.ONE) for r in urls.host_verdicts(rows, part=3, steps=6).collect()}
    (trust, distrust), _ = walks(pages, urls.RULES, 6)
    assert any(t > 1 for t, _ in got.values())
    for h, (t, d) in got.items():
        assert t == pytest.approx(trust[h], abs=1e-5) and d == pytest.approx(distrust[h], abs=1e-5)


def test_urls_empty(spark):
    assert urls.judge(spark.createDataFrame([], PAGE)).count() == 0


# -- whitening -----------------------------------------------------------------

VEC = "vec_id long, embedding array<float>, n int"


def dense(vectors):
    """The contract with a dense eigendecomposition and Python's integers."""
    kept = [(i, v) for i, v, *_ in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    d = max((len(v) for _, v in kept), default=0)
    x = [[int(np.floor(256 * float(np.float32(c)))) for c in v] + [0] * (d - len(v)) for _, v in kept]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centre = np.array([[(n * a - s) / n for a, s in zip(f, sums, strict=True)] for f in fit])
    v = centre.T @ centre / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    dev = [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    z = np.array([[(n * a - s) / n for a, s in zip(r, sums, strict=True)] for r in x]) @ u[:, :4] / np.sqrt(np.maximum(e[:4], 1e-300))
    return [i for i, _ in kept], n, dev, z, e


@pytest.mark.parametrize("kind", ["steep", "flat"])
def test_whitening(spark, kind):
    r = np.random.default_rng(3)
    m = r.standard_normal((300, 40)) * (0.4 ** np.arange(40) * 8 if kind == "steep" else 1)
    m = m @ np.linalg.qr(r.standard_normal((40, 40)))[0]
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(m)]
    rows += [(300 + i, rows[7][1], 1) for i in range(200)] + [(None, rows[3][1], 2)]  # a third are one vector
    rows += [(900, None, 0), (901, [None] * 40, 0), (902, [float("nan")] * 40, 0), (903, [float("inf")] * 40, 0), (904, [1.5, -0.5], 0), (905, [], 0), (905, [], 0)]
    passes = []
    plain, white.summed = white.summed, lambda b, of, shape, *a: passes.append(shape) or plain(b, of, shape, *a)
    try:
        got = white.whiten(spark.createDataFrame(rows, VEC)).collect()
    finally:
        white.summed = plain
    assert ((40, 40) in passes) == (kind == "flat") and (40, 16) in passes
    ids, n, dev, z, e = dense(rows)
    by = {}
    for g in got:
        by.setdefault((str(g["vec_id"]), g["deviation"]), {}).setdefault(g["component"], []).append(g)
    assert len(got) == 4 * len(ids) and {g["n"] for g in got} == {n} and len({g["identity_error"] for g in got}) == 1
    sign = None
    for i, d, w in zip(ids, dev, z, strict=True):
        own = np.array([by[str(i), d][c][0]["whitened"] for c in (1, 2, 3, 4)])
        sign = np.sign(own * w) if sign is None else sign
        assert own == pytest.approx(sign * w, abs=1e-9)
    one = got[0]
    assert one["identity_error"] < 1e-10
    assert [by[str(ids[0]), dev[0]][c][0]["explained"] for c in (1, 2, 3, 4)] == pytest.approx(e[:4] / e.sum(), rel=1e-9)


def test_whitening_edges(spark):
    def run(rows):
        return white.whiten(spark.createDataFrame(rows, VEC)).collect()

    assert run([]) == [] and run([(1, [0.5, 1.0], 0), (2, [0.5, 1.0], 0)]) == [] and run([(1, [], 0)]) == []
    two = run([(1, [0.0, 1.0], 0), (2, [1.0, 1.0], 0)])  # one direction with variance
    assert [(r["vec_id"], r["component"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in sorted(two)] == [(1, 1, 65536, 1.0, 1.0), (2, 1, 65536, 1.0, 1.0)]
    big = run([(1, [2.0**20], 0), (2, [-(2.0**20)], 0)])
    assert {r["deviation"] for r in big} == {(2**29) ** 2}
    with pytest.raises(Exception, match="64 bits"):
        run([(1, [3e30], 0), (2, [0.0], 0)])


# -- phrases -------------------------------------------------------------------

DOC = "doc_id long, text string, lang string, source string"


def plain_phrases(docs, least, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang, _ in docs:
        lang = lang or "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split(r"[ \t]", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3, 4):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, w), a in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i : i + k]] = max(longer[lang, w[i : i + k]], a)
    out = {}
    for (lang, w), a in found.items():
        if 100 * longer[lang, w] >= 80 * a:
            continue
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


def texts(seed=2, n=150):
    r = np.random.default_rng(seed)
    words = ["a", "B", "the", "of", "été", "x-y", "😀", "long" * 30, "q", "\x1cz", "né", "İ"]
    ends = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "! ", ":", "\r\n"]
    docs = []
    for i in range(n):
        text = "".join(words[min(r.geometric(0.25), len(words)) - 1] + ends[r.integers(len(ends))] for _ in range(r.integers(0, 60)))
        docs.append((i, text, (None, "en", "fr", "und", "en")[i % 5], "s"))
    common = "the of a B the of a B x-y " * 40
    return docs + [(n, None, "en", "s"), (n, "", None, "s"), (None, "...,,,\n\n", "en", None), (n + 1, common + ". " + common, "en", "s"), (n + 2, common, "xx", "s")] + docs[:20] + [(n + 3, " ", "yy", "s")]


@pytest.mark.parametrize(("bits", "shard", "most"), [(phrases.BITS, phrases.SHARD_BYTES, phrases.MERGED), (1 << 8, 300, 200), (1 << 16, 1000, 3000)])  # a full bitmap, tiny shards and early hand-over change nothing
def test_phrases(spark, bits, shard, most):
    docs = texts()
    got = phrases.collocations(spark.createDataFrame(docs, DOC).repartition(3), least=5, bits=bits, shard_bytes=shard, most=most)
    want = plain_phrases(docs, 5)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and len(want) > 100
    assert sorted(map(tuple, got.collect())) == want
    few = phrases.collocations(spark.createDataFrame(docs, DOC), least=5, top=7)
    assert sorted(map(tuple, few.collect())) == plain_phrases(docs, 5, 7)


def test_phrases_empty(spark):
    assert phrases.collocations(spark.createDataFrame([], DOC)).count() == 0


def test_slices(spark):
    """Any number of ANDs at once gives the same phrases."""
    import pyarrow as pa

    t = next(phrases.shared.chunks(pa.array([x[1] for x in texts()])))
    row = phrases._shard(t, ["en"] * len(t))
    names = [x.split()[0] for x in phrases._SHARD.split(", ")]
    kinds = [pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), *[pa.binary()] * 3]
    s = phrases.Shard({n: pa.scalar(x, k) for n, x, k in zip(names, row, kinds, strict=True)})
    full = [np.full(8, 255, np.uint8)] * 3
    got = []
    for ands in (1, 50, 1 << 20):
        all_ = Counter()
        for level in phrases.grown(s, full, 4, ands):
            for i, n in enumerate(level.counts.tolist()):
                all_[tuple(int(w[i]) for w in level.words)] += n
        got.append(all_)
    assert got[0] == got[1] == got[2] and len(got[0]) > 500
