"""Language identification: word-first backoff.

A known word adds its log frequency in each language; an unseen word is
scored by its character n-grams, of the longest order of which any is known,
falling back from 4 to 1.  The model is fitted on a bounded sample of
labelled texts (``SAMPLE_DOCS`` rows and ``SAMPLE_CHARS`` characters, drawn by
a hash of doc_id, evenly from all languages) and keeps every word and n-gram
of that sample; so the sample bounds what is counted on the executors and
sent to every task.  ``least`` can leave out what occurs less often.
Prediction reads whole texts and nothing else.

Defined cases: a null text or one without a letter gives ``und`` and score
0, as does every text if nothing could be learned; a null doc_id is not held
out and not learned from; a null lang is not learned from; repeated rows are
predicted each; ties between languages go to the first by code point; an
empty table gives an empty result; extra columns pass through ``predict``,
those named like its outputs are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import shared
from tidemark.llm.op6_bpe import LETTER, code_classes

#: Bounds of the sample of labelled rows, about.
SAMPLE_DOCS, SAMPLE_CHARS = 20_000, 40_000_000
ORDERS = (4, 3, 2, 1)
FOLDS = 5
NONE = "und"


@dataclass
class Model:
    """Sorted hashes and log frequencies (one column a language), of words (order 0) and of n-grams."""

    langs: list[str]
    hashes: dict[int, np.ndarray] = field(default_factory=dict)
    logs: dict[int, np.ndarray] = field(default_factory=dict)


class Words:
    """The lower-cased words (runs of letters) of a chunk of texts, in bytes and in characters."""

    def __init__(self, t: shared.Texts):
        raws = [t.raw(i).decode().lower().encode() for i in range(len(t))]
        self.buf = np.frombuffer(b"".join(raws), np.uint8)
        at = np.append(0, np.cumsum([len(r) for r in raws])).astype(np.int64)
        #: Byte at which each character starts, and the end of the buffer.
        self.chars = np.append(np.flatnonzero((self.buf & 0xC0) != 0x80), len(self.buf))
        points = np.frombuffer(self.buf.tobytes().decode().encode("utf-32-le"), np.uint32)
        letter = code_classes()[points] == LETTER
        first = np.zeros(len(points) + 1, bool)
        text_at = np.searchsorted(self.chars[:-1], at)
        first[text_at] = True
        begins = letter.copy()
        begins[1:] &= ~letter[:-1] | first[1:-1]
        ends = letter.copy()
        ends[:-1] &= ~letter[1:] | first[1:-1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        #: Number of each text's first word, and of all words.
        self.first = np.searchsorted(self.starts, text_at)
        self.hash = shared.span_hashes(self.buf, self.chars[self.starts], self.chars[self.ends]) if len(self.starts) else np.zeros(0, np.uint64)

    def grams(self, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams of some words, and to which of these words each belongs."""
        count = np.maximum(self.ends[which] - self.starts[which] - n + 1, 0)
        of = np.repeat(np.arange(len(which)), count)
        at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + self.starts[which][of]
        return (shared.span_hashes(self.buf, self.chars[at], self.chars[at + n]) if len(at) else np.zeros(0, np.uint64)), of


def _counts(batches):
    for batch in batches:
        for t in shared.chunks(batch.column("text")):
            w = Words(t)
            langs = np.array(batch.column("lang").slice(t.first, len(t)).to_pylist(), object)
            of = np.repeat(np.arange(len(t)), np.diff(w.first))
            for lang in sorted(set(langs)):
                mine = np.flatnonzero((langs == lang)[of])
                for order in (0, *ORDERS):
                    h, n = np.unique(w.hash[mine] if order == 0 else w.grams(mine, order)[0], return_counts=True)
                    out = [pa.array([lang] * len(h), pa.string()), pa.array(np.full(len(h), order, np.int32)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(out, names=["lang", "n", "h", "c"])


def _rates(sizes: dict[str, tuple[int, int]], sample_docs: int, sample_chars: int) -> dict[str, float]:
    """Share of each language's rows to take, of sizes (rows, characters): as many rows and characters of each, what small languages leave going to the larger."""
    rates = dict.fromkeys(sizes, 1.0)
    for k, left in enumerate((sample_docs, sample_chars)):
        for i, (lang, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1][k], x[0]))):
            want = min(n[k], max(1, left // (len(sizes) - i)))
            rates[lang] = min(rates[lang], want / max(1, n[k]) if n[k] else 1.0)
            left -= want
    return rates


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, least: int = 1) -> Model:
    """Fit on ``labelled`` (doc_id, text, lang), on all of it or on a sample of about that size, dealt evenly to the languages."""
    labelled = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("chars"))
    rates = _rates({r["lang"]: (r["n"], r["chars"]) for r in sizes.collect()}, sample_docs, sample_chars)
    sample = labelled
    if any(x < 1 for x in rates.values()):
        rate = F.create_map(*(F.lit(x) for pair in rates.items() for x in pair))[F.col("lang")]
        sample = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.ceil(rate * (1 << 40)))
    counted = shared.mapped(sample.select("text", "lang"), _counts, "lang string, n int, h long, c long").groupBy("lang", "n", "h").agg(F.sum("c").alias("c"))
    counted = shared.stored(counted)
    sums = {(r["lang"], r["n"]): r["c"] for r in counted.groupBy("lang", "n").agg(F.sum("c").alias("c")).collect()}
    rows = counted if least < 2 else counted.join(counted.groupBy("n", "h").agg(F.sum("c").alias("all")).filter(F.col("all") >= least).select("n", "h"), ["n", "h"]).select(*counted.columns)
    model = Model(sorted({lang for lang, _ in sums}))
    at = {lang: i for i, lang in enumerate(model.langs)}
    for order in (0, *ORDERS):
        x = rows.filter(F.col("n") == order).select("lang", "h", "c").toArrow()
        of = np.array([at[lang] for lang in x["lang"].unique().to_pylist()], np.int64)[np.asarray(x["lang"].combine_chunks().dictionary_encode().indices)] if len(x) else np.zeros(0, np.int64)
        h, back = np.unique(x["h"].to_numpy().view(np.uint64), return_inverse=True)
        c = np.full((len(h), len(at)), 0.5)
        np.add.at(c, (back, of), x["c"].to_numpy().astype(np.float64))
        every = np.array([sums.get((lang, order), 0) for lang in model.langs], np.float64) + 0.5 * max(1, len(h))
        model.hashes[order], model.logs[order] = h, np.log(c / every).astype(np.float32)
    shared.removed(counted)
    return model


def _found(model: Model, order: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes the model knows, and their rows."""
    table = model.hashes[order]
    if not len(table):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    pos = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return table[pos] == h, pos


def word_scores(model: Model, w: Words, which: np.ndarray) -> np.ndarray:
    """Log score of each of the words in each language, less the mean over the languages."""
    out = np.zeros((len(which), len(model.langs)))
    known, pos = _found(model, 0, w.hash[which])
    out[known] = model.logs[0][pos[known]]
    left = np.flatnonzero(~known)
    for order in ORDERS:
        if not len(left):
            break
        h, of = w.grams(which[left], order)
        hit, pos = _found(model, order, h)
        n = np.bincount(of[hit], minlength=len(left))
        total = np.stack([np.bincount(of[hit], model.logs[order][pos[hit], i], len(left)) for i in range(len(model.langs))], 1)
        some = n > 0
        out[left[some]] = total[some] / n[some, None]
        left = left[~some]
    return out - out.mean(1, keepdims=True)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1: the languages' posterior at equal priors)."""
    own = ["lang_pred", "score"]
    keep = [f for f in docs.schema.fields if f.name not in own]
    schema = T.StructType([*keep, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # no more than the sample's words and n-grams

    def run(batches):
        m = sent.value
        for whole in batches:
            for t in shared.chunks(whole.column(text)):
                batch = whole.slice(t.first, len(t))
                w = Words(t)
                lang, score = [NONE] * len(t), np.zeros(len(t))
                if len(w.hash) and m.langs:
                    _, which, back = np.unique(w.hash, return_index=True, return_inverse=True)
                    each = word_scores(m, w, which)[back]
                    has = np.flatnonzero(np.diff(w.first))
                    s = np.add.reduceat(each, w.first[:-1][has], axis=0)
                    p = np.exp(s - s.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    for i, k, x in zip(has.tolist(), p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                        lang[i], score[i] = m.langs[k], x
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(lang, pa.string()), pa.array(score)], names=schema.names)

    return shared.mapped(docs.select(*(f"`{f.name}`" for f in keep)), run, schema)


def held_out():
    """Whether a document is of the fold that is never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def learned(docs: DataFrame) -> Model:
    """The model of the contract: fitted on labelled documents outside the held-out fold."""
    return fit(docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0).select("doc_id", "text", "lang"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: doc_id, held_out, lang_pred, score."""
    docs = shared.table(spark, sf_dir, "documents")
    got = predict(docs.select("doc_id", "text"), learned(docs))
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: A fitted model is beyond SQL; held-out accuracy checks it.
SQL = None
