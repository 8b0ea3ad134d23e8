"""Uniform shuffles into shards of exact sizes, through a hypergeometric communication matrix.

How many rows of each partition go to each shard is drawn first, from the law that a uniform
permutation of all rows would give (Sanders, 1998). Each partition is permuted where it lies, its
rows are dealt out by the drawn counts, exchanged, and permuted again in their shard.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pathsonde.llm.common import cut, free_name

#: Rows of a bin; a shard is permuted bin by bin, so no task sorts a whole shard.
ROWS_PER_BIN = 4096


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` without return, by inversion outward from the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    u = rng.random() - p
    up, down, p_up, p_down = mode, mode, p, p
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) / (up + 1) * ((draws - up) / (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down / (good - down + 1) * ((bad - draws + down) / (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows that each partition sends to each shard; columns sum to sizes at most one apart."""
    rng, total = random.Random(seed), sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for n in counts:
        left, row, others = n, [], sum(room)
        for s in range(shards):
            others -= room[s]
            x = hypergeometric(rng, room[s], others, left)
            row.append(x)
            left -= x
        room = [a - b for a, b in zip(room, row, strict=True)]
        matrix.append(row)
    return matrix


def shuffle_into_shards(df: DataFrame, shards: int = 24, seed: int = 20240, stable: bool = False, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard) to all rows of ``df``.

    Every assignment of the rows to the places is equally likely, and shard sizes differ by one
    at most. Rows are told apart by where they lie, so nulls, ties and copies are shuffled like any
    other rows. Input columns named like the added ones are replaced. An empty table gives no rows;
    with fewer rows than shards some shards stay empty.

    The rows are written once to the shared folder, with their place and their rank in it, so that no
    later job depends on how Spark splits files; ``stable`` makes no difference any more. The driver
    gets one count for each partition, and draws one number for each partition and shard in a loop. Full rows are exchanged once.
    """
    rows = df.drop(*[c for c in df.columns if c.lower() in (shard.lower(), slot.lower())])
    spark, width = df.sparkSession, 33
    pos, pid, key, rank, cell, base = (free_name(rows, f"_{x}") for x in ("pos", "pid", "key", "rank", "bin", "base"))
    place = F.monotonically_increasing_id()
    local = rows.withColumn(pos, place).withColumn(key, F.xxhash64(F.lit(seed), pos)).sortWithinPartitions(key, pos)
    local = local.withColumn(rank, place).withColumn(pid, F.shiftright(rank, width)).withColumn(rank, F.col(rank).bitwiseAND(F.lit((1 << width) - 1)))
    local = cut(local.drop(key))
    counts = {r[0]: r[1] for r in local.groupBy(pid).count().collect()}
    order, total = sorted(counts), sum(counts.values())
    ends = [[sum(row[: k + 1]) for k in range(shards)] for row in communication_matrix([counts[p] for p in order], shards, seed)]
    schema = T.StructType([T.StructField(pid, T.LongType()), T.StructField("ends", T.ArrayType(T.LongType()))])
    matrix = spark.createDataFrame(list(zip(order, ends, strict=True)), schema)
    if len(order) * shards <= 2_000_000:  # 16 MB of counts
        matrix = F.broadcast(matrix)
    bits = max(0, math.ceil(math.log2(max(1, total / shards / ROWS_PER_BIN))))

    dealt = local.join(matrix, pid).withColumn(shard, F.size(F.filter("ends", lambda e: e <= F.col(rank))))
    again = dealt.withColumn(key, F.xxhash64(F.lit(seed + 1), pos))
    again = again.withColumn(cell, F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")).drop(pid, rank, "ends")
    sizes = again.groupBy(shard, cell).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(shard).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(shard, cell, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(base))
    own = Window.partitionBy(shard, cell).orderBy(key, pos)
    ranked = again.withColumn(rank, F.row_number().over(own) - 1)
    out = ranked.join(bases, [shard, cell]).withColumn(slot, F.col(base) + F.col(rank))
    return out.select(*rows.columns, shard, slot)
