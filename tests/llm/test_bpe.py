from __future__ import annotations

import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from pathsonde.llm.bpe import bpe_decode, bpe_encode, encoder

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return encoder(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def theirs(own):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


CASES = [
    "", " ", "\n\n  x", "don't  stop\t\tnow ", "a" * 5000, "ab" * 3000, "\x1c\x1d a\x1e", "日本語のテキスト 한국어", "é" * 300 + "é",
    "🙂🙃" * 50, "x y　z  ", "12345678901234567890" * 20, "<|endoftext|>", "''''s 'S 'll", "Straße ñandú   \r\n\r\n", "=" * 999 + "-" * 1000,
]


@pytest.mark.parametrize("text", CASES)
def test_same_ids_as_the_library(own, theirs, text):
    ids = np.frombuffer(own.encode(text), "<u4").tolist()
    assert ids == theirs.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()


def test_random_texts(own, theirs):
    rng = random.Random(5)
    letters = "aaabcdeeetns hi'  \n.,-0123éüñßдж中\U0001f600"
    for _ in range(400):
        text = "".join(rng.choices(letters, k=rng.randint(1, 120)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == theirs.encode_ordinary(text)


def test_merges_one_by_one_agree_with_backtracking(own):
    rng = random.Random(6)
    for _ in range(300):
        piece = bytes(rng.choices(b"abest \xc3\xa9\xff", k=rng.randint(1, 40)))
        if piece not in own.ranks:
            assert own.encode_piece(piece) == own.merged(piece)


def test_frame(spark):
    rows = [(1, "one two", "x"), (2, None, None), (None, "", "y"), (1, "one two", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS2 string")
    out = bpe_decode(bpe_encode(df, PATH, P.PATTERN), PATH).collect()
    assert [(r.doc_id, bytes(r.decoded).decode(), r.IDS2) for r in out] == [(a, b or "", c) for a, b, c in rows]
    assert bpe_encode(df.limit(0), PATH, P.PATTERN).count() == 0
