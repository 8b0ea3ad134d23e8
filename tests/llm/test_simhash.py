from __future__ import annotations

import itertools
import random

import pytest
import xxhash

from pathsonde.llm.components import connected_components
from pathsonde.llm.simhash import covering_links, covering_masks, fingerprint, shingle_hashes, simhash_components


def plain_components(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in nodes}


def plain_fingerprint(text, words):
    parts = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)] or ([b" ".join(parts)] if parts else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def test_fingerprint():
    for text in (None, "", " \n", "One", "one TWO", "a b c", "A b c d e a b c", "É é x y", "w " * 70_000):
        assert fingerprint(shingle_hashes(text, 3)) == plain_fingerprint(text, 3)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_every_pair_within_the_radius_shares_a_table(radius):
    masks = covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for bits in itertools.combinations(range(64), radius):
        flipped = sum(1 << i for i in bits)
        assert any(not m & flipped for m in masks)


def test_links_have_the_components_of_all_pairs(spark):
    rng = random.Random(3)
    centre = [rng.getrandbits(64) for _ in range(6)]
    fps = {0}
    for c in centre:
        for _ in range(60):
            x = c
            for i in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << i
            fps.add(x)
    fps |= {centre[0] ^ 1 << i for i in range(64)}  # large buckets
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    links = [(signed(a), signed(b)) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 2]
    want = plain_components([signed(x) for x in fps], links)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {r.node: r.root for r in connected_components(covering_links(df)).collect()}
    assert {x: got.get(x, x) for x in want} == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 101), (300, 300)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 200: 100}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_frame(spark):
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(9, base, 1), (4, base, 2), (7, base.upper(), 3), (2, None, 4), (1, "", 5), (None, "  ", 6), (5, "other words entirely", 7), (5, "other words entirely", 7), (None, "lonely", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash_components(df).collect())
    assert got == sorted([(9, 4), (4, 4), (7, 4), (2, 1), (1, 1), (-1, 1), (5, 5), (5, 5), (-1, -1)])
    assert simhash_components(df.limit(0)).count() == 0
