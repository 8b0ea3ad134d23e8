"""Byte-level BPE: exact encoding in linear time by longest matches and backtracking, and decoding.

The rank file's tokens, mapped byte by byte to Latin-1, feed an Aho-Corasick automaton. A piece of
text is covered from left to right by the longest token that is compatible with the one before it;
where none is, the last token gives way to its next shorter candidate. Two tokens are compatible if
merging their bytes from scratch gives just the two. A cover whose neighbours are all compatible is
the merge result, and each piece has one such cover, so a position found dead stays dead.
"""

from __future__ import annotations

import base64
import functools
import re
import struct
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pathsonde.llm.memo import WordMemo

#: Pairs of tokens whose compatibility is remembered; a full memo is emptied.
PAIRS = 400_000
#: Rows that are put out together.
ROWS = 256


class Vocabulary:
    """The tokens of a rank file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token

    def decode(self, ids: bytes | None) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids or b"", dtype="<u4").tolist()))


class ByteBPE(Vocabulary):
    """An encoder for one rank file."""

    def __init__(self, path: str, pattern: str) -> None:
        super().__init__(path)
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.pieces = regex.compile(pattern)
        #: Text falls apart before each run of white space; these are white space to str but not to the pattern.
        self.chunks, self.odd = re.compile(r"\s*\S+|\s+"), re.compile(r"[\x1c-\x1f]")
        self.memo = WordMemo(lambda chunks: map(self._chunk, chunks))
        self.pairs: dict[int, bool] = {}
        self.reachable: dict[int, bool] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The merges done one by one, lowest rank first; for short pieces."""
        rank, none = self.ranks.get, len(self.tokens)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        costs = [rank(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while costs and (best := min(costs)) < none:
            i = costs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i < len(costs):
                costs[i] = rank(parts[i] + parts[i + 1], none)
            if i:
                costs[i - 1] = rank(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of both tokens merge into just the two."""
        if (known := self.pairs.get(a << 32 | b)) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[a << 32 | b] = self.merged(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def merges_to_itself(self, token: int) -> bool:
        if (known := self.reachable.get(token)) is None:
            known = self.reachable[token] = self.merged(self.tokens[token]) == [token]
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern; a piece that is itself a token is that token."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n, tokens, pairs = len(piece), self.tokens, self.pairs
        options: list[list[int]] = [[] for _ in range(n)]
        for end, (token, length) in self.automaton.iter(piece.decode("latin-1")):
            options[end - length + 1].append(token)
        dead, out, at, k = bytearray(n + 1), [], 0, len(options[0]) - 1
        while at < n:
            here = options[at]
            while k >= 0:
                token = here[k]
                end = at + len(tokens[token])
                if not dead[end]:
                    fits = pairs.get(out[-1][0] << 32 | token) if out else self.merges_to_itself(token)
                    if self.compatible(out[-1][0], token) if fits is None else fits:
                        out.append((token, k))
                        at, k = end, len(options[end]) - 1 if end < n else -1
                        break
                k -= 1
            else:
                dead[at] = 1
                token, k = out.pop()
                at, k = at - len(tokens[token]), k - 1
        return [token for token, _ in out]

    def _chunk(self, chunk: str) -> bytes:
        letters = (chunk[1:] if chunk[0] == " " else chunk).isalpha()
        ids = [i for piece in ((chunk,) if letters else self.pieces.findall(chunk)) for i in self.encode_piece(piece.encode())]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.odd.search(text):
            return self._chunk(text)
        return self.memo.join(self.chunks.findall(text))


@functools.lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> ByteBPE:
    """One encoder for each worker process, with its memos."""
    return ByteBPE(path, pattern)


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _mapped(df: DataFrame, column: str, out: str, method: Callable[[], Callable], drop: tuple[str, ...]) -> DataFrame:
    kept = [c for c in df.columns if c not in drop and c.lower() != out.lower()]
    schema = df.select(*kept).schema.add(out, "binary")
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = method()
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                b = whole.slice(k, ROWS)
                made = pa.array((f(x.as_py()) for x in b.column(at)), pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), made], [*kept, out])

    return df.mapInArrow(run, schema)


def bpe_encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add ``out``: the ids of the whole ``text`` as little-endian unsigned 32-bit integers.

    Null and empty texts give no ids. All other columns stay, but for those of ``drop``; one
    named like ``out`` is replaced. Rows are independent, so copies and empty tables need no care.
    """
    return _mapped(df, text, out, lambda: encoder(path, pattern).encode, drop)


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add ``out``: the bytes that ``ids`` stand for; null ids give none."""
    return _mapped(df, ids, out, lambda: vocabulary(path).decode, drop)
