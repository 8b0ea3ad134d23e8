from __future__ import annotations

import math
import random
from collections import Counter

from pathsonde.llm.sharding import communication_matrix, hypergeometric, shuffle_into_shards


def test_hypergeometric_law():
    rng, good, bad, draws, n = random.Random(1), 7, 9, 6, 20_000
    got = Counter(hypergeometric(rng, good, bad, draws) for _ in range(n))
    for k in range(max(0, draws - bad), min(draws, good) + 1):
        p = math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws)
        assert abs(got[k] / n - p) < 0.015
    big = [hypergeometric(rng, 10**9, 23 * 10**9, 24_000) for _ in range(2000)]
    assert abs(sum(big) / len(big) - 1000) < 4


def test_matrix_margins():
    counts = [0, 1, 500, 77, 3, 1000]
    m = communication_matrix(counts, 24, 5)
    assert [sum(r) for r in m] == counts
    sizes = [sum(c) for c in zip(*m, strict=True)]
    assert sum(sizes) == sum(counts) and max(sizes) - min(sizes) <= 1
    assert communication_matrix([], 3, 1) == []


def check(rows, shards, n):
    assert len(rows) == n
    sizes = Counter(r.shard for r in rows)
    full = [sizes.get(s, 0) for s in range(shards)]
    assert max(full) - min(full) <= 1 and sum(full) == n
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(full[s]))


def test_frame(spark):
    df = spark.range(0, 20_000, 1, 7).selectExpr("id % 19000 doc_id", "if(id % 3 = 0, 'hot', cast(id as string)) text", "id _pos", "'x' SLOT")
    rows = shuffle_into_shards(df, shards=2).collect()
    check(rows, 2, 20_000)
    assert [c.lower() for c in rows[0].asDict()] == ["doc_id", "text", "_pos", "shard", "slot"]
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in df.select("doc_id").collect())
    first = [r._pos for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert abs(sum(first[:5000]) / 5000 - 10_000) < 500
    assert sum(a < b for a, b in zip(first, first[1:], strict=False)) / 20_000 < 0.53


def test_small_and_empty(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, ""), (3, "x" * 100_000)], "doc_id long, text string")
    check(shuffle_into_shards(df).collect(), 24, 4)
    assert shuffle_into_shards(df.limit(0)).count() == 0


def test_the_same_each_time(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    once, twice = (sorted((r.doc_id, r.shard, r.slot) for r in shuffle_into_shards(df, stable=True).collect()) for _ in range(2))
    assert once == twice


def test_files_split_anew_between_jobs(spark):
    """As when an executor joins or is lost: later jobs read the files in other partitions."""
    df, how = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "spark.sql.files.maxPartitionBytes"
    n, before = df.count(), spark.conf.get(how)
    out = shuffle_into_shards(df, stable=True)
    spark.conf.set(how, "100000")
    try:
        check(out.collect(), 24, n)
    finally:
        spark.conf.set(how, before)
