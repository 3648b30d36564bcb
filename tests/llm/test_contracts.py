"""The queries of fixed contract against DuckDB, or against plain restatements, over whole small tables."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark import llm
from tidemark.llm import op4_source_mix as mix
from tidemark.llm import op7_fingerprints as fp

SF = "/root/testdata/sf0.001"
SQL = llm.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("SELECT doc_id, text, lang, source FROM documents ORDER BY doc_id").fetchall()


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, name):
    df = llm.queries()[name](spark, SF)
    res = duck.execute(SQL[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(str, res.fetchall()))


def test_language(spark, docs):
    got = rows(llm.queries()["op3_language_id"](spark, SF))
    assert len(got) == len(docs)
    right = []
    for d, text, lang, _ in docs:
        assert got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0)
        if got[d]["held_out"] and any(c.isalpha() for c in text or ""):
            right.append(got[d]["lang_pred"] == lang)
    assert np.mean(right) > 0.9


def test_mix(spark, docs):
    got = rows(llm.queries()["op4_source_mix"](spark, SF))
    again = rows(llm.queries()["op4_source_mix"](spark, SF))
    assert got == again and len(got) == len(docs)
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _, _ in docs}
    source = {d: s for d, _, _, s in docs}
    names = sorted(set(source.values()))
    sizes = [sum(n for d, n in size.items() if source[d] == s) for s in names]
    want = dict(zip(names, mix.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    assert sum(want.values()) == pytest.approx(sum(sizes))
    for s, n in zip(names, sizes, strict=True):
        own = [r for d, r in got.items() if source[d] == s]
        assert all(r["size"] == size[r["doc_id"]] and r["source_size"] == n and r["target"] == pytest.approx(want[s]) for r in own)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own) and want[s] <= 3 * n + 1e-6
        assert abs(sum(r["taken"] for r in own) - want[s]) <= max(size[r["doc_id"]] for r in own)


def test_targets():
    assert mix.targets([10, 10, 10], [5, 2, 1]) == pytest.approx([18.75, 7.5, 3.75])
    assert mix.targets([1, 100, 100], [5, 2, 1]) == pytest.approx([3, 132, 66])
    assert mix.targets([], []) == [] and mix.targets([0, 5], [1, 1]) == [0, 5]


def test_bpe(spark, docs):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = rows(llm.queries()["op6_bpe"](spark, SF))
    assert len(got) == len(docs)
    for d, text, _, _ in docs:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        assert (got[d]["n_tokens"], got[d]["ids_sha256"], got[d]["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def plain_fingerprint(text):
    """From the docstring: paragraphs are lines cut after sentence ends, without what closes them; 64 bytes of BLAKE2b each, as 4 little-endian words and 256 bits."""
    *closed, last = re.split(r"(?<=[.!?]) |\n", text)
    units = [u.encode() for u in [*closed, *([last] if last else [])]]
    newlines = text.count("\n")
    small, wide = [0] * 256, [0] * 4

    def word(d, k):
        return int.from_bytes(d[8 * k : 8 * k + 8], "little")

    for u in units:
        d = hashlib.blake2b(u).digest()
        wide = [(x + word(d, k)) % 2**64 for k, x in enumerate(wide)]
        small = [(x + (1 if d[32 + k // 8] >> (7 - k % 8) & 1 else -1)) % 2**16 for k, x in enumerate(small)]
    for n, byte in ((newlines, b"\n"), (len(closed) - newlines, b" ")):
        d = hashlib.blake2b(byte, person=b"closing").digest()
        wide = [(x + n * word(d, k)) % 2**64 for k, x in enumerate(wide)]
    return "".join(f"{x:016x}" for x in wide) + "".join(f"{x:04x}" for x in small)


def plain_likeness(a, b):
    if a == b:
        return 1.0
    x, y = ([(int(s[i : i + 4], 16) + 2**15) % 2**16 - 2**15 for i in range(64, len(s), 4)] for s in (a, b))
    both = sum(i * i for i in x) + sum(i * i for i in y)
    return min(1 - 1 / 64, max(0.0, 1 - sum((i - j) ** 2 for i, j in zip(x, y, strict=True)) / both)) if both else 0.0


def test_fingerprints(spark, docs):
    got = rows(llm.queries()["op7_fingerprints"](spark, SF))
    assert len(got) == len(docs)
    order = sorted(docs, reverse=True)
    near = []
    for (d, text, _, _), (_, after, _, _) in zip(order, [*order[1:], order[0]], strict=True):
        text, after, r = text or "", after or "", got[d]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == plain_fingerprint(text) and r["edited_fingerprint"] == plain_fingerprint(edited)
        assert r["near_edited"] == pytest.approx(plain_likeness(plain_fingerprint(text), plain_fingerprint(edited)))
        assert r["near_next"] == pytest.approx(plain_likeness(plain_fingerprint(text), plain_fingerprint(after)))
        if len(text) > 1500 and after != text:
            near.append(r["near_edited"] - r["near_next"])
    assert np.mean(near) > 0.2


def test_ranges(spark, docs):
    """Small ranges, ids that repeat and rows without an id."""
    df = spark.createDataFrame([(d, t) for d, t, _, _ in docs] + [(5, "again"), (5, "once more"), (None, "x"), (None, "y"), (None, "x")], "doc_id long, text string").repartition(4)
    one, many = (sorted(map(str, fp.fingerprints(df, n).collect())) for n in (1 << 40, 20_000))
    assert one == many and len(one) == len(docs) + 5


def test_fingerprint_algebra():
    a, b = "One.\nTwo.\n", "Three four.\n"
    assert plain_fingerprint(a + b) == plain_fingerprint(b + a) == fp.added(plain_fingerprint(a), plain_fingerprint(b))
    assert fp.added(plain_fingerprint(a + b), plain_fingerprint(b), -1) == plain_fingerprint(a)
    assert plain_fingerprint("x") != plain_fingerprint("y")
    of = lambda x: fp.hex_of(*fp._sums_of([x]))[0]
    for one, two in (("Alpha one\nBeta two", "Beta two\nAlpha one"), ("First. Second.", "Second. First."), ("a\n\nb", "b\n\na")):
        assert of(one) == of(two) == plain_fingerprint(one)
    assert len({of(x) for x in ("A. B", "A.\nB", "A. B\n", "A.  B", "A.B", "", "\n", " ")}) == 8
