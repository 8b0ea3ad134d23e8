"""Near-duplicates by SimHash fingerprints, found through covering locality-sensitive hashing.

For a radius r every bit position gets a non-zero vector of r + 1 bits; table v (each non-zero
vector of r + 1 bits) keeps the positions whose vector has an odd product with v. Any r positions
leave some v orthogonal to all of them, so two fingerprints that differ in at most r bits agree on
the whole mask of some table: no pair within the radius is missed (Pagh, "CoveringLSH", 2018).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathsonde.llm.common import cut, slices
from pathsonde.llm.components import connected_components

#: Buckets with more members are linked through midpoints instead of pairs.
PAIRS_UP_TO = 16


def shingle_hashes(text: str | None, words: int) -> list[int]:
    """XXH64 (seed 42) of each run of ``words`` words, repeats included.

    Words are runs of anything but space and 09-0D, with A-Z in lower case. A text of fewer words
    is one shingle, a text of none has none.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return []
    joined, digest = memoryview(b" ".join(parts)), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return [digest(joined, 42)]
    ends, at = [], -1
    for p in parts:
        at += len(p) + 1
        ends.append(at)
    starts = [0, *(x + 1 for x in ends[:-words])]
    return [digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :], strict=True)]


def fingerprint(hashes: list[int]) -> int:
    """The 64 bits that are set in over half of the hashes; 0 for none."""
    if not hashes:
        return 0
    rows = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(rows), 1 << 16):
        counts += np.unpackbits(rows[k : k + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def with_fingerprint(df: DataFrame, text: str = "text", words: int = 3, out: str = "fp", drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without the columns of ``drop``, and with the fingerprint of ``text`` as a signed long."""
    kept = [c for c in df.columns if c not in drop]
    schema = df.select(*kept).schema.add(out, "long")
    t = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([fingerprint(shingle_hashes(x.as_py(), words)) for x in b.column(t)], dtype=np.uint64)
            columns = [b.column(b.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(fps.view(np.int64))], [*kept, out])

    return df.mapInArrow(run, schema)


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """The masks of the 2^(radius+1) - 1 tables; positions get the non-zero vectors in turn."""
    n = 1 << (radius + 1)
    vectors = [1 + i % (n - 1) for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _lit(x: int) -> Column:
    return F.lit(_signed(x)).cast("long")


def covering_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links ``(u, v)`` between distinct fingerprints ``fp`` that differ in at most ``radius`` bits.

    Their components are exactly those of all such pairs. In buckets of up to PAIRS_UP_TO members all pairs
    are compared. The members of larger buckets are linked through midpoints, which takes rows in
    proportion to the members: two fingerprints are within 2 bits just when both are within one
    bit of some third word, and at most 65 fingerprints are within one bit of a word. Other radii
    compare all pairs of a bucket in one join, which is quadratic in hot buckets.
    """
    tables = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(_lit(m)).alias("key")) for k, m in enumerate(covering_masks(radius))])
    rows = fps.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.key")
    full = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = cut(rows.join(full, ["t", "key"]))
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius
    small = members if radius != 2 else members.filter(F.col("n") <= PAIRS_UP_TO)
    pairs = (
        small.select("t", "key", F.col("fp").alias("u"))
        .join(small.select("t", "key", F.col("fp").alias("v")), ["t", "key"])
        .filter(F.col("u") > F.col("v"))
        .filter(near("u", "v"))
        .select("u", "v")
    )
    if radius != 2:
        return pairs
    words = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(_lit(1 << i)) for i in range(64)])
    midpoints = (
        members.filter(F.col("n") > PAIRS_UP_TO).select("fp").distinct()
        .select("fp", F.explode(words).alias("mid"))
        .groupBy("mid").agg(F.collect_set("fp").alias("fps"))
        .filter(F.size("fps") > 1)
        .select(F.array_min("fps").alias("v"), F.explode("fps").alias("u"))
        .filter("u <> v")
        .select("u", "v")
    )
    return pairs.unionByName(midpoints)


def simhash_components(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """Per row of ``df``: ``key``, ``fp`` (signed long) and ``component_id``.

    component_id is the least ``key`` that links reach, the row's own included; links join
    fingerprints that differ in at most ``radius`` bits. Null and empty texts have the fingerprint
    0, which links like any other. Null keys never name a component unless all its keys are null.
    Repeated rows stay. Other columns are not read. An empty table gives no rows.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    own = cut(with_fingerprint(rows, "text", words, "fp", drop=("text",)))
    nodes = cut(own.groupBy("fp").agg(F.min("key").alias("rep")))
    roots = connected_components(covering_links(nodes.select("fp"), radius))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "rep", "root")
    #: A root is a node without a row of its own in roots.
    tops = nodes.join(roots.select(F.col("root").alias("fp")).distinct(), "fp").select("fp", "rep", F.col("fp").alias("root"))
    grouped = rooted.unionByName(tops)
    least = grouped.groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = grouped.join(least, "root").select("fp", F.col("component_id").alias("c"))
    named = cut(nodes.join(linked, "fp", "left").select("fp", F.coalesce("c", "rep").alias("component_id")))  # so that Spark may split a hot fingerprint
    out = own.join(named, "fp").select(F.col("key"), "fp", "component_id")
    return out.withColumnRenamed("key", key)


def hex64(c: Column) -> Column:
    """A long as 16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(c)), 16, "0")

