from __future__ import annotations

import math
import random
import re
import sys
import zlib

import numpy as np
import pytest

from pathsonde.llm.toxicity import FEATURES, LEET, SECOND_PERSON, Features, Trees, entries_of, isotonic, learn_lexicon, plain_word, score, sigmoid, train

CLEAN = "river stone cloud table window garden letter paper morning evening market teacher".split()
BAD = ["fnarg", "blurgh", "zorky"]


def corpus(n=900, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        words, y = rng.choices(CLEAN, k=rng.randint(8, 60)), int(rng.random() < 0.3)
        if y:
            for _ in range(rng.randint(2, 5)):
                words[rng.randrange(len(words))] = rng.choice(BAD) if rng.random() < 0.8 else "quux" + rng.choice(["ab", "cde", "fg", "hij"])
        rows.append((i, " ".join(words), y))
    return rows


@pytest.fixture(scope="module")
def learned(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 0, r[2]) for r in rows] + [(None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    return docs, train(docs, labels), {r[0]: r[2] for r in rows}


def test_held_out_accuracy(learned):
    docs, model, labels = learned
    held = [r for r in score(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 100 and sum((r.score >= 0.5) == labels[r.doc_id] for r in held) > 0.97 * len(held)
    assert set(BAD) <= set(model.lexicon) and "quux-" in model.lexicon and not set(CLEAN) & set(model.lexicon)


def test_labels_of_held_out_rows_are_not_used(spark, learned):
    docs, model, labels = learned
    flipped = [(d, 0, 1 - y if zlib.crc32(str(d).encode()) % 5 == 0 else y) for d, y in labels.items()]
    again = train(docs, spark.createDataFrame(flipped, "doc_id long, quality int, toxic int"))
    assert again.lexicon == model.lexicon and (again.trees.leaf == model.trees.leaf).all() and (again.points[1] == model.points[1]).all()


def test_frame(spark, learned):
    rows = [(1, None, 0.5), (2, "", 0.5), (None, "fnarg blurgh zorky you", 0.5), (4, "river stone cloud " * 20_000, 0.5), (4, "F.n.a.r.g bluRGH zorky zorky " + "table " * 8, 0.5), (2, "", 0.5)]
    out = score(spark.createDataFrame(rows, "doc_id long, text string, SCORE double"), learned[1]).collect()
    s = [r.score for r in out]
    assert len(s) == 6 and all(0 <= x <= 1 for x in s) and s[0] == s[1] == s[5] and s[2] > 0.5 > s[3] and s[4] > 0.5
    assert score(spark.createDataFrame([], "doc_id long, text string"), learned[1]).count() == 0


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(i, "x") for i in range(20)], "doc_id long, text string")
    none = train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in score(docs, none).collect()] == [0.0] * 20
    ones = train(docs, spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, toxic int"))
    assert [r.score for r in score(docs, ones).collect()] == [1.0] * 20
    assert learn_lexicon(docs.selectExpr("text", "1 toxic")) == {}


def test_features():
    make = Features({"fnarg": 4.0, "blur-": 2.0})
    x = dict(zip(FEATURES, make("You FNARG! f-n4rg blurry a b 2024"), strict=True))
    assert x["word_hits"] == pytest.approx(2 / 7) and x["hidden_hits"] == pytest.approx(1 / 7) and x["beginning_hits"] == pytest.approx(1 / 7)
    assert x["second_person"] == pytest.approx(1 / 7) and x["near_second_person"] == pytest.approx(3 / 7) and x["single_letters"] == pytest.approx(2 / 7)
    assert x["shouted"] == pytest.approx(1 / 7) and make(None) == make("") == [0.0] * len(FEATURES)
    assert plain_word("«Wörter!»") == "wörter" and entries_of("abcdef") == ["abcdef", "abcd-", "abcde-", "abcdef-"]


LEXICON = {"fnarg": 4.0, "das": 2.5, "": 4.0, "faint": 0.001, "huge": 99.0, "äöü": 2.0, "abc-": 9.0, "abcd-": 1.6, "abcdef-": 3.0, "abcdefgh-": 2.0, "abcdefghi-": 9.0}


def word_by_definition(raw):
    word = re.sub(r"^\W+|\W+$", "", raw).lower()
    letters, mixed = re.findall(r"[^\W\d_]", raw), bool(re.search(r"[\W\d_]", word)) and bool(re.search(r"[^\W\d_]", raw))
    found, hidden = LEXICON.get(word, 0.0), 0
    bare = re.sub(r"[\W\d_]", "", raw.lower().translate(LEET))
    if not found and bare != word and (mixed or not raw.isalpha()):
        found = LEXICON.get(bare, 0.0)
        hidden = int(found > 0)
    upper = sum(c.isupper() for c in letters)
    fields = [(round(16 * found), 8), (round(16 * max([LEXICON.get(e, 0.0) for e in entries_of(word)[1:]], default=0.0)), 8), (word in SECOND_PERSON, 1), (hidden, 1), (len(letters) == upper > 2, 1), (mixed, 1)]
    fields += [(k, 6) for k in (len(letters), upper, sum(c.isdigit() for c in raw), sum(not c.isalnum() for c in raw), sum(c in "!?*#$%&" for c in raw), len(letters) == 1)]
    out, at = 0, 0
    for value, bits in fields:
        out, at = out | min(2**bits - 1, int(value)) << at, at + bits
    return out


def test_words_by_definition():
    rng, make = random.Random(5), Features(LEXICON)
    pool = list("abcdefgABCDs013457@$!?*#%&_-.,'\"()[]\\\\İıßΣσςäÖñ²½Ⅷ٣中ǅ’«»…𝐀ª\u0301\u200d")
    words = ["".join(rng.choices(pool, k=rng.randint(1, 9))) for _ in range(15_000)]
    known = [*(e.strip("-") for e in LEXICON if e), *SECOND_PERSON, "abcdefghij", "FNARG", "Das", "d4s", "FNARĠ", "a" * 70, "A" * 70]
    words += [a + w + b for w in known for a in ["", "(", "@", "$", "¿", "_"] for b in ["", "!", "$$$", "@,", ".", "?!", "'s", "»", "!" * 70]]
    wrong = [w for w in words if make._word(w) != word_by_definition(w)]
    assert not wrong, wrong[:20]


def test_new_words_take_few_calls():
    """Most words of a large corpus are seen once, so what a new word costs is what a text costs."""
    rng, make, calls = random.Random(6), Features({"fnarg": 4.0, "blur-": 2.0}), 0
    words = ["".join(rng.choices("abcdefghijklmno", k=rng.randint(5, 12))) + rng.choice(["", "", ",", "$$$"]) for _ in range(2000)]
    words += [w.title() for w in words]
    text = " ".join(words)

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        make(text)
    finally:
        sys.setprofile(None)
    assert calls < 40 * len(words)


def test_plain_words_take_hardly_any_calls():
    """Small letters with a full stop behind at most make up most new words; without odds these are counted without a call for each."""
    rng, make, calls = random.Random(8), Features({"fnarg": 4.0, "blur-": 2.0}), 0
    words = ["".join(rng.choices("abcdefghijklmnoäéß", k=rng.randint(5, 12))) + rng.choice(["", "", ",", "."]) for _ in range(5000)]
    text = " ".join(words)

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        make(text)
    finally:
        sys.setprofile(None)
    assert calls < 2 * len(words)


def by_definition(text):
    """FEATURES of a text of at least one word, word by word."""
    x, n = [word_by_definition(w) for w in text.split()], len(text.split())
    found, begins, second, hit = [v & 255 for v in x], [v >> 8 & 255 for v in x], [i for i, v in enumerate(x) if v >> 16 & 1], [i for i, v in enumerate(x) if v & 65535]
    letters, upper, digits, marks, strong, single = (sum(v >> at & 63 for v in x) for at in range(20, 56, 6))
    near, some = sum(any(abs(i - k) <= 4 for k in second) for i in hit), max(1, letters)
    return [
        sum(v > 0 for v in found) / n, sum(found) / 16 / n, max(found) / 16, sum(v > 0 for v in begins) / n, sum(begins) / 16 / n, math.log1p(len(hit)), math.log1p(len({x[i] for i in hit})),
        sum(v >> 17 & 1 for v in x) / n, len(second) / n, near / n, upper / some, sum(v >> 18 & 1 for v in x) / n, marks / (some + marks), strong / (some + marks),
        digits / (some + digits), sum(v >> 19 & 1 for v in x) / n, single / n, math.log1p(n), letters / n,
    ]


@pytest.mark.parametrize(("words", "group", "piece"), [(300_000, 1 << 21, 1 << 19), (3, 1, 1), (200, 500, 50)])
def test_texts_by_definition(monkeypatch, words, group, piece):
    """However texts are grouped and words remembered, and however plain, seldom or close to a word of the lexicon these are."""
    monkeypatch.setattr("pathsonde.llm.toxicity.WORDS", words)
    monkeypatch.setattr("pathsonde.llm.toxicity.GROUP", group)
    monkeypatch.setattr("pathsonde.llm.toxicity.PIECE", piece)
    rng = random.Random(7)
    pool = [*LEXICON, "abcd", "abc", "abcde", "abcdefghijk", "fnar", "fnargs", "hugeness", "äöüx", "à", "ÿ÷", "ß", "x" * 80, "ſ", "ÀÉ", "ğ", "Ÿ", "中", "\x00a", "2024", "f-n4rg", *SECOND_PERSON]
    word = lambda: rng.choice(["", "", "", "(", "$"]) + (rng.choice(pool) if rng.random() < 0.5 else "".join(rng.choices("abcdeßéÿ", k=rng.randint(1, 9)))) + rng.choice(["", "", ".", ",", "..", "!", "@", "-", "_"])
    texts = [None, "", " \n\x1c", *(rng.choice([" ", "\n", "\u00a0"]).join(word() for _ in range(rng.choice([1, 3, 9, 80]))) for _ in range(400)), "", None]
    wrong = [t for t, x in zip(texts, Features(LEXICON).rows(texts).tolist(), strict=True) if x != (by_definition(t) if (t or "").split() else [0.0] * len(FEATURES))]
    assert not wrong, wrong[:5]
    assert Features({}).rows(["a fnarg", None]).shape == (2, len(FEATURES)) and Features({}).rows([]).shape == (0, len(FEATURES))


def test_trees_and_isotonic():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = Trees(x, y, trees=60)
    assert ((sigmoid(trees(x)) > 0.5) == y).mean() > 0.95
    a, b = isotonic(np.array([1.0, 2, 3, 4, 4, 5]), np.array([0.0, 1, 0, 1, 0, 1]))
    assert (np.diff(b) >= 0).all() and list(np.interp([1, 2, 3, 4, 5], a, b)) == [0, 0.5, 0.5, 0.5, 1]
