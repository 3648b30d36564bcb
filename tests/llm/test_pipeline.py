"""The pipeline's stages against plain versions, each on its own input."""

import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tests.llm.test_brute_force import brute_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        stage(spark, docs, SF).write.parquet(str(at / name))
        docs = spark.read.parquet(str(at / name))
        out.append([r.asDict() for r in docs.collect()])
    return [[r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()], *out]


def test_stages(outputs):
    start, kept, deduped, single, mixed, tokens = outputs
    columns = set(start[0])
    assert all(set(x[0]) == columns for x in (kept, deduped, single, mixed))
    # language: what has letters stays as it was
    before = {r["doc_id"]: r for r in start}
    assert all(before[r["doc_id"]] == r for r in kept) and len(kept) >= 0.97 * sum(any(c.isalpha() for c in r["text"] or "") for r in start)
    # lines
    first = {}
    for r in sorted(kept, key=lambda r: r["doc_id"]):
        for x in r["text"].split("\n"):
            first.setdefault(re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\v\f\r")), r["doc_id"])
    low = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\v\f\r"))
    want = {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if len(low(x)) < 10 or first[low(x)] == r["doc_id"]) for r in kept}
    assert {r["doc_id"]: r["text"] for r in deduped} == want and all(r["n_chars"] == len(r["text"]) for r in deduped)
    # near duplicates
    comp = brute_components([(r["doc_id"], r["text"]) for r in deduped], 5, 80, 100)
    assert sorted(r["doc_id"] for r in single) == sorted(d for d, (_, c) in comp.items() if c == d)
    # mix: whole documents, each at most three times
    own = {r["doc_id"]: r for r in single}
    counts = {}
    for r in mixed:
        assert own[r["doc_id"]] == r
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert max(counts.values()) <= 3
    # tokens
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(tokens) == len(mixed)
    for r in tokens:
        assert r["ids"] == tok.encode(own[r["doc_id"]]["text"], add_special_tokens=False).ids


def test_stages_on_empty_and_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    columns = [x.split()[0] for x in schema.split(", ")][:5]
    empty = spark.createDataFrame([], schema)
    for name, stage in cp.STAGES:
        got = stage(spark, empty, SF)
        assert got.count() == 0 and set(got.columns) >= set(columns) - ({"text"} if name == cp.STAGES[-1][0] else set()), name
    words = "the quick brown fox jumps over the lazy dog near the river bank today"
    rows = [(1, words, "en", "a", 1, "x"), (1, words, "en", "a", 1, "x"), (2, words + ".", "en", None, None, "y"), (None, words + " again", None, None, 3, None), (None, words, "en", "b", 4, None), (3, None, "en", "a", 5, "z"), (4, "", None, "a", 6, "z"), (5, "123 456", "en", "b", 7, "z")]
    odd = spark.createDataFrame(rows, schema)
    kept = cp.language_id(spark, odd, SF)
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in odd.select(*columns).collect() if r["text"] and "quick" in r["text"])
    deduped = {(r["doc_id"], r["text"]) for r in cp.line_dedup(spark, kept, SF).collect()}
    assert deduped == {(1, words), (2, words + "."), (None, words + " again"), (None, words)}
    single = cp.ngram_jaccard(spark, kept, SF).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in single) == sorted(map(str, [(1, words), (1, words), (None, words + " again"), (None, words)]))
    assert {r["text"] for r in cp.mix(spark, kept, SF).collect()} <= {r["text"] for r in kept.collect()}
