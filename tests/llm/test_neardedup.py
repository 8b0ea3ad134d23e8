from __future__ import annotations

import itertools
import random

import numpy as np

from pathsonde.llm.neardedup import drop_near_duplicates
from tests.llm.test_simhash import plain_components


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {b" ".join(w)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    groups: dict = {}
    for i, root in plain_components(range(len(rows)), links).items():
        groups.setdefault(root, []).append(i)
    return sorted(min((rows[i][0] is None, rows[i][0] or 0) for i in g) for g in groups.values())


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(4, 9)))
    rows = []
    for _ in range(60):
        rows.append([word() for _ in range(rng.randint(60, 400))])
    for base in list(rows)[:30]:
        for _ in range(rng.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(max(1, len(copy) // rng.choice([90, 120, 300]))):
                copy[rng.randrange(len(copy))] = word()
            rows.append(copy)
    for base in list(rows)[:20]:  # too far apart
        rows.append([w if rng.random() < 0.7 else word() for w in base])
    texts = [" ".join(r) for r in rows]
    texts += texts[:5] + [texts[7].upper().replace(" ", "\n  "), "", "  ", None, "a b", "A b", "a b c"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(k, texts[i]) for k, i in enumerate(order)]


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, _a int, node string")
    out = drop_near_duplicates(df)
    assert out.columns == df.columns
    got, want = sorted((False, r.doc_id) for r in out.collect()), brute(rows)
    assert got == want


def test_odd_rows(spark):
    rows = [(3, "one two three four five six"), (3, "one two three four five six"), (None, "one two three four five six"), (None, "lonely text"), (2, None), (5, "")]
    out = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in out) == [(0, "lonely text"), (2, ""), (3, rows[0][1])]
    assert drop_near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id for r in drop_near_duplicates(df).collect()}
    want = {k for _, k in brute([(r.doc_id, r.text) for r in df.collect()])}
    assert got == want


def plain_kept(texts):
    """The kept places of ``texts`` by the counts of common shingles of all pairs."""
    sets, ids = [shingles(t) for t in texts], {}
    table = np.zeros((len(texts), len(set().union(*sets))), dtype=np.float32)
    for row, s in zip(table, sets, strict=True):
        row[[ids.setdefault(x, len(ids)) for x in s]] = 1
    common, n = table @ table.T, table.sum(axis=1)
    linked = np.argwhere(np.triu(9 * common >= 4 * (n[:, None] + n), 1))
    return set(plain_components(range(len(texts)), linked.tolist()).values())


def exact(spark, texts):
    rows = list(enumerate(texts))
    got = {r.doc_id for r in drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain_kept(texts)
    assert len(want) < len(rows) and got == want, (len(got), len(want))


def test_cut_lengthened_and_replaced_copies(spark):
    """One link each between a text and its copy, so a link that is missed leaves both."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(4, 9)))
    texts = []
    for k in range(200):
        base = [word() for _ in range(rng.randint(200, 400))]
        n = int(len(base) * rng.uniform(0.08, 0.22))
        new, at = [word() for _ in range(n)], rng.randrange(len(base) - n)
        copy = [base[:-n], base + new, base[:at] + new[: n // 2] + base[at + n // 2 :], base[:at] + new + base[at:]][k % 4]
        texts += [" ".join(base), " ".join(copy)]
    exact(spark, texts)


def test_pairs_in_a_hot_template(spark):
    """Members of the template are no links of each other, but each has one copy."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(4, 9)))
    template, texts = [word() for _ in range(200)], []
    for _ in range(500):
        member = [word() if rng.random() < 0.03 else w for w in template]
        copy = list(member)
        copy[rng.randrange(200)] = word()
        texts += [" ".join(member), " ".join(copy)]
    exact(spark, texts)
