"""Connected components of a graph in two columns, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathsonde.llm.common import cut, release


def _state(edges: DataFrame) -> tuple:
    """A count and an order-free checksum of the edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(pairs: DataFrame, keep_self: bool) -> DataFrame:
    """Point every ``v`` beside ``u`` at the smallest of u's neighbourhood."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = pairs.join(least, "u")
    if keep_self:
        moved = out.select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = least.select("u", F.col("m").alias("v"))
        out = moved.unionByName(own)
    else:
        out = out.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of the undirected graph ``edges(u, v)``.

    Returns ``(node, root)``: each node that has an edge to another, and the least node of its
    component. Null ends, self loops and repeated edges are ignored; an empty graph gives no rows.
    Each round is written to the shared folder, so that no lineage grows and lost executors cost
    one round at most. Nothing but a count and a checksum comes to the driver.
    """
    e = cut(
        edges.filter("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    before = _state(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, keep_self=False)
        e, old = cut(_star(large.filter("v < u"), keep_self=True)), e
        release(old)
        now = _state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
