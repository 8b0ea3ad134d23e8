"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

The features are densities of learned lexicon words and word beginnings, how near they stand to words
of the second person, capitals, punctuation, and rates of obfuscated spelling. Lexicon, trees and
calibration are learned from separate parts of a bounded sample of labelled rows, so that none
of them sees how the one before fits its own rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathsonde.llm.common import cut, slices

#: Labelled rows to learn from, at most; entries of the lexicon; lengths of word beginnings.
TRAIN_ROWS, LEXICON, BEGINNINGS = 12_000, 3_000, range(4, 9)
#: Toxic rows that hold an entry, at least, and its least log odds.
MIN_ROWS, MIN_ODDS = 3, 1.5
TREES, DEPTH, RATE, BINS, SHRINK = 120, 3, 0.1, 48, 5.0
#: Words that are remembered by a worker; characters of texts that are counted together, about; words that are told apart at once.
WORDS, GROUP, PIECE = 300_000, 1 << 21, 1 << 19

#: Words of the second person in English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner euch euer ihr tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro su".split())
#: Characters that stand for letters.
LEET = str.maketrans("013457@$!", "oieastasi")

#: ASCII characters that are no part of a word; those that count as strong.
MARKS, STRONG = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~", frozenset("!?*#$%&")
#: Single marks that are not strong and stand for no letter.
PLAIN = frozenset(MARKS) - STRONG - {"@"}
#: By byte of UTF-8: a to z; these marks; what follows LEAD in one of the letters from ß to ÿ.
LOWER, TAIL, NEXT = (np.isin(np.arange(256), list(x)) for x in (b"abcdefghijklmnopqrstuvwxyz", "".join(PLAIN).encode(), {*range(0x9F, 0xC0)} - {0xB7}))
LEAD = 0xC3
#: Masks of the first bytes of eight; bits of a hash.
FIRST, HASH_BITS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64), 20
EDGES = re.compile(r"^\W+|\W+$")
LETTER = re.compile(r"[^\W\d_]")
INNER = re.compile(r"[\W\d_]+")

FEATURES = (
    "word_hits", "word_weight", "word_best", "beginning_hits", "beginning_weight", "hits", "kinds_of_hits", "hidden_hits", "second_person",
    "near_second_person", "capitals", "shouted", "punctuation", "marks", "digits", "mixed", "single_letters", "words", "word_length",
)


def plain_word(raw: str) -> str:
    """Without marks at its ends, in lower case."""
    core = raw.strip(MARKS)
    return (core if core.isalnum() else EDGES.sub("", core)).lower()


def entries_of(word: str) -> list[str]:
    """What the lexicon may hold of a word: the word, and its beginnings with a hyphen behind."""
    return [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) >= n)] if len(word) > 2 else []


def _counts(df: DataFrame) -> DataFrame:
    """``(entry, toxic, clean)``: rows of ``(text, toxic)`` that hold each entry; a partial count for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n[y].update({e for w in {plain_word(x) for x in (text or "").split()} for e in entries_of(w)})
        keys = list(n[1])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([n[1][k] for k in keys], pa.int64()), pa.array([n[0][k] for k in keys], pa.int64())], ["entry", "toxic", "clean"])
        rest = [k for k in n[0] if k not in n[1]]
        yield pa.RecordBatch.from_arrays([pa.array(rest, pa.string()), pa.array([0] * len(rest), pa.int64()), pa.array([n[0][k] for k in rest], pa.int64())], ["entry", "toxic", "clean"])

    parts = df.mapInArrow(run, "entry string, toxic long, clean long")
    return parts.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(df: DataFrame, size: int = LEXICON) -> dict[str, float]:
    """Log odds of the ``size`` entries that most speak for label 1, from rows ``(text, toxic)``."""
    rows = {r[0]: r[1] for r in df.groupBy("toxic").count().collect()}
    if not rows.get(0) or not rows.get(1):
        return {}
    odds = F.log((F.col("toxic") + 0.5) / (rows[1] + 1)) - F.log((F.col("clean") + 0.5) / (rows[0] + 1))
    best = _counts(df).withColumn("odds", odds).filter((F.col("toxic") >= MIN_ROWS) & (F.col("odds") >= MIN_ODDS))
    best = best.orderBy(F.desc(F.col("odds") * F.log1p("toxic")), "entry").limit(size)
    return {r.entry: r.odds for r in best.select("entry", "odds").collect()}


class Words(dict):
    """Remembers what ``make`` gives for at most WORDS words, in two generations: words in use outlive the others."""

    def __init__(self, make: Callable[[str], int]) -> None:
        self.make, self.old = make, {}

    def __missing__(self, raw: str) -> int:
        got = self.old.get(raw)
        if got is None:
            got = self.make(raw)
        if len(self) >= WORDS // 2:
            self.old = dict(self)
            self.clear()
        self[raw] = got
        return got


def _heads(words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of non-empty words with eight zeros behind them, where each word starts, and its first eight bytes as a number (with what stands behind it)."""
    starts = np.frombuffer(words.buffers()[1], dtype=np.int64)[: len(words) + 1]
    data = np.append(np.frombuffer(words.buffers()[2], dtype=np.uint8)[: starts[-1]], np.zeros(8, dtype=np.uint8))
    return data, starts, np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)[starts[:-1]]).view(np.uint64)[:, 0]


def _hash(head: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    return ((head ^ np.asarray(salt, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)


class Features:
    """Dense features of texts by a lexicon."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon, self.memo = lexicon, Words(self._word)
        self.known = {w: min(255, round(16 * lexicon.get(w, 0.0))) | (w in SECOND_PERSON) << 16 for w in {*lexicon, *SECOND_PERSON}}
        self.begins: dict[str, list[tuple[str, float]]] = {}
        for e, v in sorted(lexicon.items(), key=lambda x: -x[1]):
            if e.endswith("-") and len(e) - 1 in BEGINNINGS:
                self.begins.setdefault(e[: BEGINNINGS[0]], []).append((e[:-1], v))
        # hashes of what known words and beginnings have in their first eight bytes; a word may share one by chance
        self.may_hit = np.zeros(1 << HASH_BITS, dtype=bool)
        for words, salted in ([w for w in self.known if w], False), ([b for bs in self.begins.values() for b, _ in bs], True):
            _, starts, head = _heads(pa.array(words, pa.large_string()))
            size = np.minimum(8, np.diff(starts))
            self.may_hit[_hash(head & FIRST[size], size if salted else 0)] = True

    def _word(self, raw: str) -> int:
        """What a word adds, packed: 8 bits each of word and beginning odds in sixteenths, four flags, and counts of up to 63."""
        if plain := raw.islower() and raw.isalpha():
            core = word = raw
        else:
            core = raw.strip(MARKS)
            word = core.lower()
            if not (core.isalpha() and word.isalpha()):  # lower case can add a mark
                return self._mixed_word(raw)
        n = len(core)
        out = self.known.get(word, 0) | (n if n < 63 else 63) << 20
        if word[: BEGINNINGS[0]] in self.begins:
            out |= min(255, round(16 * self._begins(word))) << 8
        if n == 1:
            out |= 1 << 50
        if plain:
            return out
        if marks := len(raw) - n:
            ends = raw.replace(core, "", 1)
            if ends in PLAIN:
                out |= 1 << 38
            else:
                out |= min(63, marks) << 38 | min(63, sum(map(STRONG.__contains__, ends))) << 44
                if ("$" in ends or "!" in ends or "@" in ends) and not self.lexicon.get(word) and (found := self.lexicon.get(self._bare(raw))):
                    out |= 1 << 17 | min(255, round(16 * found))
        if not core.islower() and (upper := sum(map(str.isupper, core))):
            out |= min(63, upper) << 26 | (n > 2 and upper == n) << 18
        return out

    def _begins(self, word: str) -> float:
        """The highest odds of a word's beginnings; a word shorter than one is its own beginning, again."""
        for begin, odds in self.begins.get(word[: BEGINNINGS[0]], ()):
            if word.startswith(begin):
                return odds
        return 0.0

    def _bare(self, raw: str) -> str:
        return INNER.sub("", raw.lower().translate(LEET))

    def _mixed_word(self, raw: str) -> int:
        """``_word`` of any word, also with digits, marks inside or marks beyond ASCII."""
        word = plain_word(raw)
        found, hidden = self.lexicon.get(word, 0.0), 0
        begins = self._begins(word)
        letters = LETTER.findall(raw)
        mixed = bool(letters) and bool(INNER.search(word))
        if not found and (mixed or not raw.isalpha()):
            bare = self._bare(raw)
            if bare != word and (found := self.lexicon.get(bare, 0.0)):
                hidden = 1
        upper = sum(c.isupper() for c in letters)
        few = lambda n: min(63, n)
        shouted, digits = len(letters) > 2 and upper == len(letters), sum(c.isdigit() for c in raw)
        marks, strong = sum(not c.isalnum() for c in raw), sum(c in STRONG for c in raw)
        out = min(255, round(16 * found)) | min(255, round(16 * begins)) << 8 | (word in SECOND_PERSON) << 16 | hidden << 17 | shouted << 18 | mixed << 19
        for at, n in zip(range(20, 56, 6), (len(letters), upper, digits, marks, strong, len(letters) == 1), strict=True):
            out |= few(n) << at
        return out

    def _plain(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """``_word`` of each, and whether it holds: for words of small letters up to ÿ, with at most one of PLAIN behind, that surely have no odds and are no second person."""
        data, starts, head = _heads(words)
        size, starts, last = np.diff(starts), starts[:-1], starts[1:] - 1
        small, lead = LOWER[data], data == LEAD
        pair = lead[:-1] & NEXT[data[1:]]
        small[:-1] |= pair
        small[1:] |= pair
        count = lambda v: np.diff(np.append(0, v.cumsum())[np.append(starts, last[-1] + 1)])
        tail = TAIL[data[last]].astype(np.int64)
        size -= tail
        n = size - count(lead)
        plain = (count(small) == size) & (n > 0)
        head &= FIRST[np.minimum(8, size)]
        plain &= ~self.may_hit[_hash(head, 0)]
        for k in range(BEGINNINGS[0], 9):
            plain &= ~self.may_hit[_hash(head & FIRST[k], k)]
        return np.minimum(63, n) << 20 | tail << 38 | (n == 1).astype(np.int64) << 50, plain

    def _packed(self, words: list[str]) -> np.ndarray:
        """``_word`` of each; each different word is looked at once."""
        told = pa.array(words, pa.large_string()).dictionary_encode()
        codes = told.indices.to_numpy()
        x, plain = self._plain(told.dictionary)
        rest = np.flatnonzero(~plain)
        # codes come in the order of their first places
        first = np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1))[rest].tolist()
        x[rest] = np.fromiter(map(self.memo.__getitem__, map(words.__getitem__, first)), dtype=np.int64, count=len(rest))
        return x[codes]

    def __call__(self, text: str | None) -> list[float]:
        return self.rows([text])[0].tolist()

    def rows(self, texts: Iterable[str | None]) -> np.ndarray:
        """A row of FEATURES for each text; texts of GROUP characters are counted together."""
        out, group, size = [], [], 0
        for text in texts:
            group.append((text or "").split())
            size += len(text or "")
            if size >= GROUP:
                out.append(self._group(group))
                group, size = [], 0
        return np.concatenate([*out, self._group(group)])

    def _group(self, group: list[list[str]]) -> np.ndarray:
        out, n = np.zeros((len(group), len(FEATURES))), np.array([len(words) for words in group], dtype=np.int64)
        full = np.flatnonzero(n)
        if not len(full):
            return out
        n = n[full]
        starts = n.cumsum() - n
        total = lambda v: np.add.reduceat(v, starts, dtype=np.int64)
        words = group[0] if len(group) == 1 else list(chain.from_iterable(group))
        x = np.concatenate([self._packed(words[k : k + PIECE]) for k in range(0, len(words), PIECE)])
        found, begins, second = x & 255, x >> 8 & 255, x >> 16 & 1
        letters, upper, digits, marks, strong, single = (total(x >> at & 63) for at in range(20, 56, 6))
        hits = np.flatnonzero(x & 65535)
        rows = np.searchsorted(starts, hits, side="right") - 1
        near, kinds = np.zeros(len(full)), np.zeros(len(full))
        if len(hits):
            # places of different texts are further apart than those that count as near
            places = np.flatnonzero(second)
            if len(places):
                places, at = places + 5 * (np.searchsorted(starts, places, side="right") - 1), hits + 5 * rows
                k = np.searchsorted(places, at)
                gap = np.minimum(np.abs(at - places[np.minimum(k, len(places) - 1)]), np.abs(at - places[np.maximum(k - 1, 0)]))
                near = np.bincount(rows[gap <= 4], minlength=len(full))
            order = np.lexsort((x[hits], rows))
            r, v = rows[order], x[hits][order]
            kinds = np.bincount(r[np.append(True, (r[1:] != r[:-1]) | (v[1:] != v[:-1]))], minlength=len(full))
        log1p = lambda v: list(map(math.log1p, v.tolist()))
        letters_1 = np.maximum(1, letters)
        out[full] = np.array([
            total(found > 0) / n, total(found) / 16 / n, np.maximum.reduceat(found, starts) / 16, total(begins > 0) / n, total(begins) / 16 / n,
            log1p(np.bincount(rows, minlength=len(full))), log1p(kinds), total(x >> 17 & 1) / n, total(second) / n, near / n, upper / letters_1,
            total(x >> 18 & 1) / n, marks / (letters_1 + marks), strong / (letters_1 + marks), digits / (letters_1 + digits), total(x >> 19 & 1) / n,
            single / n, log1p(n), letters / n,
        ]).T
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Trees:
    """Boosted trees of fixed depth on binned features, for logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> None:
        n, f = x.shape
        self.depth = depth
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(f)]
        width = BINS + 1
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)
        flat = binned + np.arange(f) * width
        self.base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        self.feature = np.zeros((trees, 2**depth - 1), dtype=np.int64)
        self.limit = np.full((trees, 2**depth - 1), np.inf)
        self.leaf = np.zeros((trees, 2**depth))
        score = np.full(n, self.base)
        for t in range(trees):
            p = sigmoid(score)
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, dtype=np.int64)
            for level in range(depth):
                for k in range(2**level):
                    rows, at = np.flatnonzero(node == k), 2**level - 1 + k
                    if len(rows) < 10:
                        continue
                    ids = flat[rows].ravel()
                    hist = lambda w, ids=ids, rows=rows: np.bincount(ids, weights=np.repeat(w[rows], f), minlength=f * width).reshape(f, width).cumsum(axis=1)
                    left_g, left_h = hist(g), hist(h)
                    all_g, all_h = g[rows].sum(), h[rows].sum()
                    gain = left_g**2 / (left_h + SHRINK) + (all_g - left_g) ** 2 / (all_h - left_h + SHRINK) - all_g**2 / (all_h + SHRINK)
                    j, b = divmod(int(gain.argmax()), width)
                    if gain[j, b] > 1e-6 and b < len(self.edges[j]):
                        self.feature[t, at], self.limit[t, at] = j, self.edges[j][b]
                node = 2 * node + (x[np.arange(n), self.feature[t, 2**level - 1 + node]] > self.limit[t, 2**level - 1 + node])
            total_g, total_h = (np.bincount(node, weights=w, minlength=2**depth) for w in (g, h))
            self.leaf[t] = -rate * total_g / (total_h + SHRINK)
            score += self.leaf[t, node]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (x[rows, feature[at]] > limit[at])
            score += leaf[node]
        return score


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the non-decreasing fit by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for a, b in sorted(zip(x.tolist(), y.tolist(), strict=True)):
        blocks.append([a, a, b, 1])
        while len(blocks) > 1 and (blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3] or blocks[-2][1] == blocks[-1][0]):
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    points = [(a, s / n) for lo, hi, s, n in blocks for a in ((lo, hi) if hi > lo else (lo,))]
    return np.array([p[0] for p in points]), np.array([p[1] for p in points])


class ToxicityModel:
    """Lexicon, trees and calibration; ``constant`` where there was nothing to learn from."""

    def __init__(self, lexicon: dict[str, float], trees: Trees | None, points: tuple[np.ndarray, np.ndarray] | None, constant: float) -> None:
        self.lexicon, self.trees, self.points, self.constant = lexicon, trees, points, constant

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(x):
            return np.full(len(x), self.constant)
        raw = self.trees(x)
        own = sigmoid(raw)
        fitted = np.interp(raw, *self.points) if self.points and len(self.points[0]) else own
        return np.clip(0.98 * fitted + 0.02 * own, 0, 1)  # the share of its own breaks ties


def _features(df: DataFrame, text: str, lexicon: dict[str, float]) -> DataFrame:
    """``df`` without its text, and ``x``, an array of FEATURES."""
    kept = [c for c in df.columns if c != text]
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features(lexicon)
        for b in batches:
            x = make.rows(v.as_py() for v in b.column(at))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(x.tolist(), pa.list_(pa.float64()))], [*kept, "x"])

    return df.mapInArrow(run, df.select(*kept).schema.add("x", T.ArrayType(T.DoubleType())))


def in_training(key) -> object:
    """The rows whose labels may be learned from: crc32 of the id as text is no multiple of 5."""
    return F.crc32(F.col(key).cast("string")) % 5 != 0


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Learn from at most ``rows`` labelled rows, those of the least hash of their id.

    Half of them give the lexicon, three tenths the trees, the rest the calibration. Rows with a null
    id or label, and rows that are not ``in_training``, are never used. Without rows of both labels the
    model gives a constant: the share of label 1, or 0 without any rows.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & in_training(key)).select(F.col(key).alias("key"), F.col(label).cast("int").alias("toxic"))
    part = F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(10))
    chosen = cut(known.orderBy(F.xxhash64("key"), "key", "toxic").limit(rows).withColumn("part", part))
    own = cut(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(chosen, "key").select("text", "toxic", "part").repartition(24))
    shares = {r[0]: r[1] for r in own.groupBy("toxic").count().collect()}
    constant = shares.get(1, 0) / max(1, sum(shares.values()))
    if not shares.get(0) or not shares.get(1):
        return ToxicityModel({}, None, None, constant)
    lexicon = learn_lexicon(own.filter("part < 5").select("text", "toxic"))
    got = _features(own.filter("part >= 5").select("text", "toxic", "part"), "text", lexicon).orderBy(F.xxhash64("x"), "part", "toxic").collect()
    x, y, p = np.array([r.x for r in got]).reshape(-1, len(FEATURES)), np.array([r.toxic for r in got], dtype=float), np.array([r.part for r in got])
    fit = p < 8
    if len(set(y[fit])) < 2:
        return ToxicityModel({}, None, None, constant)
    trees = Trees(x[fit], y[fit])
    points = isotonic(trees(x[~fit]), y[~fit]) if len(set(y[~fit])) == 2 else None
    return ToxicityModel(lexicon, trees, points, constant)


def score(df: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``: the probability of label 1, from 0 to 1, by the whole text alone.

    Null texts count as empty, and an empty text has a score like any other. Copies have equal scores.
    All input columns stay, but one named like ``out`` is replaced. An empty table gives no rows.
    """
    rows = df.drop(*[c for c in df.columns if c.lower() == out.lower()])
    at, schema = rows.columns.index(text), rows.select("*").schema.add(out, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features(model.lexicon)
        for b in slices(batches, 1024):
            x = make.rows(v.as_py() for v in b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.probabilities(x), pa.float64())], [*b.schema.names, out])

    return rows.mapInArrow(run, schema)
