"""Hierarchical multi-length packing of token sequences.

Documents are cut at the longest window; what remains of each goes to the tier of the shortest
window that holds it. Each tier is packed by itself, longest first; the gaps of long windows are
filled from shorter tiers, with whole pieces where some fit and with a cut one for the rest, so
that every window but the last of a task is full. The windows are dealt to step groups of equal
size and nearly equal attention cost.
"""

from __future__ import annotations

import codecs
import functools
import json
import os
import re
import struct
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pathsonde.llm.memo import ENTRIES, WordMemo

#: Windows of the tiers, each a power of two.
TIERS = (512, 1024, 2048)
#: Tokens that are packed together; what does not fill a window is carried on.
BLOCK_TOKENS = 2_000_000
#: Tokens of one step.
STEP_TOKENS = 65_536
#: White space to str, but not to the tokenizer's pattern.
ODD = re.compile(r"[\x1c-\x1f]")
#: Stands between words that are encoded together.
MARK = "\x01"
#: Words of Latin characters that stay as they are in NFC and whose lower case is one character; no special tokens.
PLAIN = re.compile(r"(?!.*<\|)[\x21-\x7e\xa1-\u012f\u0131-\u017f]+")


_U4 = struct.Struct("<I").pack


class WordTokenizer:
    """A tokenizer of the ``tokenizers`` library whose tokens never span white space, with a memo by word."""

    def __init__(self, path: str, remembered: int = ENTRIES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        with open(path) as f:
            how = json.load(f)
        normal = [x["type"] for x in how["normalizer"]["normalizers"]]
        before = [x["type"] for x in how["pre_tokenizer"]["pretokenizers"]]
        self.splits = normal == ["NFC", "Replace", "Lowercase"] and before == ["Split", "ByteLevel"] and how["normalizer"]["normalizers"][1]["pattern"] == {"Regex": r"\s+"}
        if self.splits:
            self.pieces = regex.compile(how["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
        named = {b: chr(256 + n) for n, b in enumerate(odd)}
        self.shown = "".join(named.get(b, chr(b)) for b in range(256))
        self.plain, self.marks = PLAIN.fullmatch, functools.lru_cache(maxsize=20_000)(self._piece)
        self.model, self.memo = self.inner.model, WordMemo(self._words, remembered)
        self.mark = self._ids([MARK])[0]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.inner.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        """Ids of a match of the pattern, which the model gets with its bytes as characters."""
        shown = piece if piece.isascii() else codecs.charmap_decode(piece.encode(), "strict", self.shown)[0]
        return b"".join([_U4(t.id) for t in self.model.tokenize(shown)])

    def _word(self, word: str) -> bytes:
        """Ids of a plain word: the normaliser does no more to it than lower case."""
        word = word.lower()
        return self._piece(word) if word.isalpha() else b"".join(map(self.marks, self.pieces.findall(word)))

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of each word. Words that are not plain are encoded as one text, with a mark between them."""
        plain = [(w.isascii() and w.isalpha()) or self.plain(w) is not None for w in words]
        rest = [w for w, s in zip(words, plain, strict=True) if not s]
        if len(self.mark) != 4 or any(MARK in w for w in rest):
            return self._ids(words)
        others = iter(())
        if rest:
            whole = self._ids([f" {MARK} ".join(rest)])[0]
            ids = np.frombuffer(whole, "<u4")
            at = np.flatnonzero(ids == np.frombuffer(self.mark, "<u4")[0]).tolist()
            others = (whole[4 * i : 4 * j] for i, j in zip([0, *(x + 1 for x in at)], [*at, len(ids)], strict=True))
        return [self._word(w) if s else next(others) for w, s in zip(words, plain, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        whole = lambda t: not self.splits or ODD.search(t)
        return [self._ids([t])[0] if whole(t) else self.memo.join(t.split()) for t in texts]


@functools.lru_cache(maxsize=4)
def tokenizer(path: str, remembered: int = ENTRIES) -> WordTokenizer:
    return WordTokenizer(path, remembered)


class Packer:
    """Packs pieces ``(length, doc, start)`` into windows; ``doc`` is any number that names the document."""

    def __init__(self, tiers: tuple[int, ...] = TIERS) -> None:
        self.tiers = sorted(tiers)
        self.pools: list[list[tuple[int, int, int]]] = [[] for _ in self.tiers]

    def _put(self, piece: tuple[int, int, int]) -> None:
        insort(self.pools[next(k for k, n in enumerate(self.tiers) if piece[0] <= n)], piece)

    def add(self, doc: int, length: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """Take a document; returns the full longest windows that it fills alone."""
        top, done = self.tiers[-1], length - length % self.tiers[-1]
        if length > done:
            self._put((length - done, doc, done))
        return [(top, [(top, doc, at)]) for at in range(0, done, top)]

    def _fill(self, window: int, last: bool) -> list[tuple[int, int, int]] | None:
        """Pieces that fill a window, longest first and then from shorter tiers; None if too few are left."""
        tier = self.tiers.index(window)
        pools = self.pools[: tier + 1]
        if sum(x[0] for x in pools[tier][-4:]) < window and sum(x[0] for p in pools for x in p) < window and not last:
            return None
        pieces, gap = [pools[tier].pop()], window
        gap -= pieces[0][0]
        while gap:
            for pool in reversed(pools):
                if k := bisect_right(pool, (gap, 1 << 62, 0)):
                    piece = pool.pop(k - 1)
                    break
            else:
                pool = next((p for p in pools if p), None)
                if pool is None:
                    break
                length, doc, start = pool.pop()
                piece = (gap, doc, start)
                self._put((length - gap, doc, start + gap))
            pieces.append(piece)
            gap -= piece[0]
        return pieces

    def windows(self, last: bool = False) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """Full windows, long ones first; with ``last``, what is left goes to windows of the longest size."""
        out = []
        for k in reversed(range(len(self.tiers))):
            while self.pools[k] and (pieces := self._fill(self.tiers[k], False)):
                out.append((self.tiers[k], pieces))
        if last:
            top = len(self.tiers) - 1
            self.pools = [[] for _ in range(top)] + [sorted(x for p in self.pools for x in p)]
            while self.pools[top]:
                out.append((self.tiers[top], self._fill(self.tiers[top], True)))
                self.pools = [[] for _ in range(top)] + [sorted(x for p in self.pools for x in p)]
        return out


def step_groups(windows: list[tuple[int, list[tuple[int, int, int]]]], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A group for each window: equal numbers from each tier, dealt back and forth by attention cost."""
    groups = max(1, round(sum(w for w, _ in windows) / step_tokens))
    order = sorted(range(len(windows)), key=lambda i: (-windows[i][0], -sum(x[0] ** 2 for x in windows[i][1])))
    out = [0] * len(windows)
    for place, i in enumerate(order):
        turn, k = divmod(place, groups)
        out[i] = groups - 1 - k if turn % 2 else k
    return out


def pack_documents(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", eos: int = 1, tiers: tuple[int, ...] = TIERS, remembered: int = ENTRIES) -> DataFrame:
    """Pack the tokens of all rows of ``df`` into windows; one row per piece.

    Returns ``key``, ``start`` (ids of the document before the piece), ``length``, ``ids``
    (little-endian unsigned 32-bit integers), ``doc_tokens`` (with the closing ``eos``),
    ``sequence_id``, ``offset`` (in the sequence), ``window`` and ``step_group``.

    Every id lies in one piece; the pieces of a sequence follow each other without gaps and only
    the last sequence of a task falls short of its window. A null or empty text is ``eos`` alone.
    Repeated rows are packed as often as they occur; null keys stay null; other columns are not
    read. Each task packs its own rows, in blocks, so nothing is shuffled; rows read again in the
    same order, as those of a file are, give the same sequences. A worker remembers the ids of twice
    ``remembered`` words at most, about 150 bytes each; that changes its time, but no result.
    """
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), *(T.StructField(n, T.BinaryType() if n == "ids" else T.LongType()) for n in ("start", "length", "ids", "doc_tokens", "sequence_id", "offset", "window", "step_group"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        tok, end = tokenizer(path, remembered), np.array([eos], dtype="<u4").tobytes()
        packer, docs = Packer(tiers), {}
        sequence = group = name = tokens = 0
        full: list = []

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal sequence, group, full, docs
            full += packer.windows(last)
            cols: list[list] = [[] for _ in schema]
            parts: list[memoryview] = []
            groups = step_groups(full)
            for (window, pieces), g in zip(full, groups, strict=True):
                at = 0
                for length, doc, start in pieces:
                    k, ids, total = docs[doc]
                    for c, v in zip(cols, (k, start, length, 4 * length, total, base + sequence, at, window, base + group + g), strict=True):
                        c.append(v)
                    parts.append(memoryview(ids)[4 * start : 4 * (start + length)])
                    at += length
                sequence += 1
            group += max(groups, default=-1) + 1
            full = []
            left = {x[1] for p in packer.pools for x in p}
            docs = {k: v for k, v in docs.items() if k in left}
            ends = pa.array(np.cumsum([0, *cols[3]], dtype=np.int64)).cast(pa.int32())  # fails beyond an int
            columns = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
            columns[3] = pa.BinaryArray.from_buffers(pa.binary(), len(parts), [None, ends.buffers()[1], pa.py_buffer(b"".join(parts))])
            return pa.RecordBatch.from_arrays(columns, names)

        types, names = None, [f.name for f in schema]
        for b in batches:
            keys, texts = b.column(0), b.column(1)
            types = types or [keys.type, *[pa.int64()] * (len(names) - 1)]
            for k in range(0, b.num_rows, 64):
                part = [x or "" for x in texts.slice(k, 64).to_pylist()]
                for own, ids in zip(keys.slice(k, 64).to_pylist(), tok.encode(part), strict=True):
                    ids += end
                    docs[name] = (own, ids, len(ids) // 4)
                    full += packer.add(name, len(ids) // 4)
                    name, tokens = name + 1, tokens + len(ids) // 4
                if tokens >= BLOCK_TOKENS:
                    yield flush(False)
                    tokens = 0
            del b, keys, texts  # while the next batch is read
        if types:
            yield flush(True)

    return df.select(key, text).mapInArrow(run, schema)
