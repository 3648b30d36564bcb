"""BPE encoding and decoding: speculate and verify.

Words (the byte-level pre-tokenizer's pieces) are encoded by greedy longest
match over the vocabulary.  A sequence of tokens is what merging by rank
gives exactly if every token stands for itself and every adjacent pair,
merged alone, falls into the same two tokens.  So all adjacent pairs of all
new words of a batch are tested at once against a table of pairs that grows
as new ones are met; words with a failing pair, and only those, are merged
exactly.  Words met before are looked up by hash and compared byte by byte, so
the ids don't rest on the hash.  Decoding gathers the bytes of the ids.

Defined cases: a null text counts as empty and has no tokens; the special
token's string in a text becomes its id; repeated rows are encoded each;
invalid UTF-8 can't occur in a string column; an empty table gives an empty
result; extra columns pass through ``encode``.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import shared

#: The suffixes that the byte-level pre-tokenizer splits off, and the code points it counts as white space.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SPACE, LETTER, NUMBER, OTHER = range(4)
#: Words and pairs kept per worker before the tables of known ones start anew.
KNOWN_WORDS = 1_000_000


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def code_classes() -> np.ndarray:
    """Of each code point: white space, letter, number or other."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.array([kind.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)], np.uint8)
    out[list(WHITE)] = SPACE
    return out


def word_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pre-tokenizer's words start: ``points`` are code points, ``first`` marks those that open a segment.

    A word is a run of letters, of numbers or of other characters, with one
    space before it if there is one; other white space before a word stands
    for itself; an apostrophe with one of ``SUFFIXES`` is split off.
    """
    n = len(points)
    kind = code_classes()[points]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    solid = np.flatnonzero(start & (kind != SPACE) & ~first)
    before = solid - 1
    spaced = points[before] == 32
    start[solid[spaced]] = False
    start[before[spaced | (kind[before] == SPACE)]] = True
    quote = np.flatnonzero(start & (points == 39))
    for suffix in SUFFIXES:
        k = len(suffix)
        q = quote[quote + k < n]
        same = np.ones(len(q), bool)
        for j, c in enumerate(suffix):
            same &= (points[q + 1 + j] == ord(c)) & ~first[q + 1 + j]
        q = q[same]
        start[q + 1] = False
        after = q + 1 + k
        after = after[after < n]
        start[after[(kind[after] == LETTER)]] = True
    return start


class Bpe:
    """A byte-level BPE vocabulary read from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbol = byte_symbols()

        def raw(token: str) -> bytes:
            return bytes(symbol[c] for c in token)

        self.special = {x["content"].encode(): x["id"] for x in spec["added_tokens"]}
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if t.encode() not in self.special}
        self.n = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * self.n
        for t, i in [*vocab.items(), *self.special.items()]:
            self.bytes[i] = t
        self.byte_id = np.array([vocab[bytes([b])] for b in range(256)], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        pair = [(vocab[raw(a)] * self.n + vocab[raw(b)], vocab[raw(a) + raw(b)]) for a, b in merges]
        keys = np.array([k for k, _ in pair], np.int64)
        by = np.argsort(keys, kind="stable")
        self.merge_keys, self.merge_rank, self.merge_into = keys[by], by, np.array([v for _, v in pair], np.int64)[by]
        #: The tokens that their own bytes merge to.
        tokens = list(vocab)
        self.own = {t: vocab[t] for t, got in zip(tokens, self.exact(tokens), strict=True) if got == [vocab[t]]}
        #: By its first two bytes, how long such a token can be.
        self.reach: dict[bytes, int] = {}
        for t in self.own:
            self.reach[t[:2]] = max(len(t), self.reach.get(t[:2], 0))
        self.sizes, self.begin, self.flat = self._table(self.bytes)
        self.decimal = self._table([b"%d," % i for i in range(self.n)])
        self.merged_exactly = 0
        self.forget_pairs()
        self.forget_words()

    @staticmethod
    def _table(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(b) for b in strings], np.int64)
        return sizes, np.cumsum(sizes) - sizes, np.frombuffer(b"".join(strings), np.uint8)

    def forget_pairs(self) -> None:
        self.pairs, self.fit = np.zeros(0, np.int64), np.zeros(0, bool)

    def forget_words(self) -> None:
        """Start the table of known words anew: hashes (sorted) and the words' numbers; by number, where each word's ids and bytes are, and those."""
        self.known, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.count, self.raw_at, self.raw_size = (np.zeros(0, np.int64) for _ in range(4))
        self.ids, self.raw = np.zeros(0, np.int32), np.zeros(0, np.uint8)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the words with these hashes, -1 for unknown ones."""
        if not len(self.known):
            return np.full(len(hashes), -1)
        pos = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[pos] == hashes, self.number[pos], -1)

    def learn(self, words: list[bytes], hashes: np.ndarray) -> None:
        """Encode new words (of ascending, distinct hashes) and add them to the table."""
        got = self.propose_and_verify(words)
        count, size = np.array([len(g) for g in got], np.int64), np.array([len(w) for w in words], np.int64)
        into = np.searchsorted(self.known, hashes)
        self.known, self.number = np.insert(self.known, into, hashes), np.insert(self.number, into, len(self.at) + np.arange(len(words)))
        new = (len(self.ids) + np.cumsum(count) - count, count, len(self.raw) + np.cumsum(size) - size, size)
        self.at, self.count, self.raw_at, self.raw_size = (np.concatenate(x) for x in zip((self.at, self.count, self.raw_at, self.raw_size), new, strict=True))
        self.ids = np.concatenate([self.ids, np.array([x for g in got for x in g], np.int32)])
        self.raw = np.concatenate([self.raw, np.frombuffer(b"".join(words), np.uint8)])

    def unlike(self, buf: np.ndarray, begins: np.ndarray, sizes: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Which words differ from the known ones of numbers ``pos``, whose hashes they have."""
        size = np.where(self.raw_size[pos] == sizes, sizes, 0)
        differs = _gathered(buf, begins, size) != _gathered(self.raw, self.raw_at[pos], size)
        of = np.searchsorted(np.cumsum(size), np.flatnonzero(differs), side="right")
        return np.union1d(of, np.flatnonzero(self.raw_size[pos] != sizes))

    def exact(self, words: list[bytes]) -> list[list[int]]:
        """Merge rank by rank, many words at a time: in each round every word merges its leftmost pair of lowest rank."""
        none, out = len(self.merge_keys), [[] for _ in words]
        sizes = np.array([len(w) for w in words], np.int64)
        ids = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        while len(ids):
            rank, at = np.full(len(ids), none), np.zeros(len(ids), np.int64)
            key = ids[:-1] * self.n + ids[1:]
            pos = np.minimum(np.searchsorted(self.merge_keys, key), none - 1)
            hit = (self.merge_keys[pos] == key) & (word[1:] == word[:-1])
            rank[:-1][hit], at[:-1] = self.merge_rank[pos[hit]], pos
            begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, begins), np.diff(np.append(begins, len(ids))))
            over = least == none
            if over.any():
                done, of = ids[over], word[over]
                cut = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                for w, got in zip(of[cut].tolist(), np.split(done, cut[1:]), strict=True):
                    out[w] = got.tolist()
            best = np.flatnonzero((rank == least) & ~over)
            best = best[np.append(True, word[best][1:] != word[best][:-1])] if len(best) else best
            ids[best] = self.merge_into[at[best]]
            keep = ~over
            keep[best + 1] = False
            ids, word = ids[keep], word[keep]
        return out

    def greedy(self, word: bytes) -> list[int]:
        """Longest match from the left over tokens that stand for themselves."""
        own, reach, out, i, n = self.own, self.reach, [], 0, len(word)
        while i < n:
            j = min(n, i + reach.get(word[i : i + 2], 1))
            while (t := own.get(word[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which pairs of tokens, merged alone, stay these two tokens; a pair is worked out once and kept."""
        key = left * self.n + right
        new = np.setdiff1d(key, self.pairs)
        if len(new):
            pairs = [(k // self.n, k % self.n) for k in new.tolist()]
            got = self.exact([self.bytes[a] + self.bytes[b] for a, b in pairs])
            fit = np.array([g == [a, b] for g, (a, b) in zip(got, pairs, strict=True)], bool)
            at = np.searchsorted(self.pairs, new)
            self.pairs, self.fit = np.insert(self.pairs, at, new), np.insert(self.fit, at, fit)
        return self.fit[np.searchsorted(self.pairs, key)]

    def propose_and_verify(self, words: list[bytes]) -> list[list[int]]:
        """Propose by longest match, test every adjacent pair at once, merge the failing words exactly."""
        if not words:
            return []
        if len(self.pairs) > KNOWN_WORDS:
            self.forget_pairs()
        got = [self.greedy(w) for w in words]
        flat = np.array([t for g in got for t in g], np.int64)
        ends = np.cumsum([len(g) for g in got])
        inner = np.ones(len(flat), bool)
        inner[ends - 1] = False
        at = np.flatnonzero(inner)
        bad = np.unique(np.searchsorted(ends, at[~self.fits(flat[at], flat[at + 1])], side="right")).tolist()
        for i, g in zip(bad, self.exact([words[i] for i in bad]), strict=True):
            got[i] = g
        self.merged_exactly += len(bad)
        return got

    def encode(self, t: shared.Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a chunk, and the number of ids of each text."""
        buf, n_texts = t.buf, len(t)
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(n_texts, np.int64)
        head = (buf & 0xC0) != 0x80
        at_byte = np.flatnonzero(head)
        points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
        first = np.zeros(len(buf), bool)
        first[t.starts[t.starts < t.ends]] = True
        spans = self._special_spans(t)
        for lo, hi in spans:
            first[lo] = True
            if hi < len(buf):
                first[hi] = True
        first = first[at_byte]
        start = word_starts(points, first)
        begins = at_byte[start]
        if spans:
            inside = np.zeros(len(buf) + 1, np.int64)
            for lo, hi in spans:
                inside[lo + 1] += 1
                inside[hi] -= 1
            begins = begins[np.cumsum(inside)[begins] == 0]
        ends = np.append(begins[1:], len(buf))
        h = shared.span_hashes(buf, begins, ends)
        if len(self.known) > KNOWN_WORDS:
            self.forget_words()
        unique, where, back = np.unique(h, return_index=True, return_inverse=True)
        number = self.numbers(unique)
        new = np.flatnonzero(number < 0)
        raw = buf.tobytes()

        def words(which: np.ndarray) -> list[bytes]:
            return [raw[a:b] for a, b in zip(begins[which].tolist(), ends[which].tolist(), strict=True)]

        if len(new):
            number[new] = len(self.at) + np.arange(len(new))
            self.learn(words(where[new]), unique[new])
        pos = number[back]
        at, count, table = self.at[pos], self.count[pos], self.ids
        special = np.flatnonzero(np.isin(begins, [lo for lo, _ in spans])) if spans else np.zeros(0, np.int64)
        alone = np.setdiff1d(self.unlike(buf, begins, ends - begins, pos), special)
        own = [*((i, [self.special[w]]) for i, w in zip(special.tolist(), words(special), strict=True)), *zip(alone.tolist(), self.propose_and_verify(words(alone)), strict=True)]
        if own:
            count[[i for i, _ in own]] = [len(g) for _, g in own]
            sizes = np.array([len(g) for _, g in own], np.int64)
            at[[i for i, _ in own]] = len(table) + np.cumsum(sizes) - sizes
            table = np.concatenate([table, np.array([x for _, g in own for x in g], np.int32)])
        ids = _gathered(table, at, count)
        of = np.searchsorted(begins, t.starts)
        of_end = np.searchsorted(begins, t.ends)
        total = np.append(0, np.cumsum(count))
        return ids, total[of_end] - total[of]

    def _special_spans(self, t: shared.Texts) -> list[tuple[int, int]]:
        """Byte spans of special tokens' strings, leftmost first, none over a text's end."""
        raw, out = t.buf.tobytes(), []
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                i = int(np.searchsorted(t.starts, at, side="right")) - 1
                ok = at + len(s) <= t.ends[i]
                if ok:
                    out.append((at, at + len(s)))
                at = raw.find(s, at + (len(s) if ok else 1))
        return sorted(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens one after another; what isn't UTF-8 is replaced."""
        raw = _gathered(self.flat, self.begin[ids], self.sizes[ids]).tobytes()
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = raw.decode(errors="replace").encode()
        return raw

    def in_decimal(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        sizes, begin, flat = self.decimal
        return _gathered(flat, begin[ids], sizes[ids]).tobytes()[:-1]


def _gathered(flat: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The pieces ``flat[at : at + count]`` one after another."""
    if not len(count):
        return flat[:0]
    ends = np.cumsum(count)
    return flat[np.repeat(at - (ends - count), count) + np.arange(ends[-1])]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Bpe:
    """One vocabulary per worker process."""
    return Bpe(path)


def encode(docs: DataFrame, path: str, text: str = "text", ids: bool = False) -> DataFrame:
    """``docs`` without the text, with n_tokens, ids_sha256, decoded_sha256 and, on wish, the ids themselves."""
    own = ["n_tokens", "ids_sha256", "decoded_sha256"]
    keep = [f for f in docs.schema.fields if f.name not in (text, *own, "ids")]
    more = [T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else []
    schema = T.StructType([*keep, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), *more])

    def run(batches):
        bpe = vocabulary(path)
        for whole in batches:
            for t in shared.chunks(whole.column(text)):
                batch = whole.slice(t.first, len(t))
                flat, n = bpe.encode(t)
                ends = np.cumsum(n)
                each = [flat[hi - k : hi] for k, hi in zip(n.tolist(), ends.tolist(), strict=True)]
                out = [*(batch.column(f.name) for f in keep), pa.array(n, pa.int64())]
                out.append(pa.array([hashlib.sha256(bpe.in_decimal(x)).hexdigest() for x in each], pa.string()))
                out.append(pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in each], pa.string()))
                if ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat, pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return shared.mapped(docs.select(*(F.col(f.name) for f in keep), text), run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


#: Tokenization by rank merging is beyond SQL.
SQL = None
