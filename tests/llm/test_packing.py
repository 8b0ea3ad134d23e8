from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from pathsonde.llm.packing import Packer, pack_documents, step_groups, tokenizer

PATH = P.path("word_bpe_49k.json")


def test_same_ids_as_the_library():
    plain = Tokenizer.from_file(PATH)
    texts = ["", "Hello, World's end 123", "İstanbul ΣΑΣ Σ", "é x̧́", "a\x1cb \x85 c d", "<|endoftext|>x <|startoftext|>", "日本 語　ok", "don't'S 'll''s", "a \x01 b", "\x01", "ǅ ﬁ ß  \n\t"]
    rng = random.Random(1)
    texts += [chr(c) + chr(d) for c in range(0x21, 0x200) for d in (0x41, 0xE9, 0x301, 0x2E) if c != 0xAD]
    texts += ["".join(rng.choices("aEÀéñßŒœŸ'sİıĳŉſ,.;!12²ªº&<|>x", k=rng.randint(1, 9))) for _ in range(3000)]
    texts += ["".join(rng.choices("abcÉé'sS \n\t.,1234ßΣı́\x1f", k=80)) for _ in range(300)]
    for text, ids in zip(texts, tokenizer(PATH).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_packer_fills_windows():
    rng = random.Random(2)
    packer, lengths, out = Packer((8, 16, 32)), {}, []
    for doc in range(500):
        lengths[doc] = rng.choice([1, 2, 5, 9, 15, 16, 17, 31, 32, 33, 200])
        out += packer.add(doc, lengths[doc])
    out += packer.windows()
    assert all(sum(x[0] for x in pieces) == window for window, pieces in out)
    out += packer.windows(last=True)
    short = [sum(x[0] for x in pieces) < window for window, pieces in out]
    assert sum(short) <= 1
    seen = defaultdict(list)
    for _, pieces in out:
        for length, doc, start in pieces:
            assert length > 0
            seen[doc] += range(start, start + length)
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in lengths.items()}


def test_step_groups_are_even():
    windows = [(32, [(32, 0, 0)])] * 9 + [(16, [(8, 0, 0), (8, 0, 0)])] * 6 + [(8, [(4, 0, 0)] * 2)] * 3
    groups = step_groups(windows, step_tokens=136)
    sizes = [sum(w for (w, _), g in zip(windows, groups, strict=True) if g == k) for k in range(max(groups) + 1)]
    assert len(sizes) == 3 and max(sizes) - min(sizes) <= 8


def test_frame(spark):
    rows = [(1, "word " * 5000, 0), (2, None, 1), (None, "", 2), (3, "some words here", 3), (3, "some words here", 3), (4, "more text " * 700, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").coalesce(1)
    out = pack_documents(df, PATH).collect()
    plain = Tokenizer.from_file(PATH)
    total = sum(len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in rows)
    assert sum(r.length for r in out) == total
    by_sequence = defaultdict(list)
    for r in out:
        assert len(r.ids) == 4 * r.length
        by_sequence[r.sequence_id].append(r)
    short = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        short += at < pieces[0].window
    assert short <= 1
    for doc, text, _ in (rows[0], rows[5]):
        ids = b"".join(bytes(r.ids) for r in sorted((r for r in out if r.doc_id == doc), key=lambda r: r.start))
        assert np.frombuffer(ids, "<u4").tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1]
    assert pack_documents(df.limit(0), PATH).count() == 0


def test_few_words_remembered():
    words, plain = [f"w{a}{b}é" for a in "abcdefghij" for b in "klmnopqrstuvwxyz"], Tokenizer.from_file(PATH)
    small = tokenizer(PATH, 20)
    for k in range(0, len(words), 5):
        text = " ".join([*words[k : k + 5], *words[:5]])
        assert np.frombuffer(small.encode([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
        assert len(small.memo.young) <= 20 and len(small.memo.old) <= 20


def test_same_pieces_with_few_words_remembered(spark):
    df = spark.createDataFrame([(k, f"one{k} two{k}, " * (k % 7 * 300)) for k in range(60)], "doc_id long, text string").coalesce(1)
    assert pack_documents(df, PATH, remembered=30).collect() == pack_documents(df, PATH).collect()
