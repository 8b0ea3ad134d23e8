"""Near-duplicate documents: covering SimHash merges most of them, an exact join of shingle sets finds the rest.

A text falls into buckets of two kinds. The masks of ``simhash.covering_masks`` over its fingerprint put every
pair within RADIUS bits into one bucket of some table. And all shingles have one order, seldom ones first: two sets
that are similar enough share a shingle among the first few of both (Chaudhuri et al., "A primitive
operator for similarity joins", 2006), and what lies behind the first shared one bounds what they can have in
common (Xiao et al., "PPJoin", 2008). Pairs that pass are compared by bitmaps, which never refuse a
link (Sandes et al., "Bitmap filter", 2017), and at last by their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathsonde.llm.common import cut, free_name, parted, release, slices
from pathsonde.llm.components import connected_components
from pathsonde.llm.simhash import covering_masks, fingerprint, shingle_hashes

WORDS, SIMILARITY, RADIUS = 5, 0.8, 2
#: Longs in a bitmap.
LONGS = 8
#: A text in so many is read for how common shingles are; those seen HOT_FROM times there are ordered by it, at most HOT_UP_TO of them.
SAMPLE, HOT_FROM, HOT_UP_TO = 16, 4, 100_000
#: Keeps rounding from refusing a pair.
SLACK = 1e-6
MASKS = covering_masks(RADIUS)
BLANK = r"^[\x20\x09-\x0D]*$"


def text_hash(text: Column) -> tuple[Column, Column]:
    """Two hashes of a text, of 64 bits each; texts without words have those of the empty text."""
    plain = F.when(text.isNull() | text.rlike(BLANK), "").otherwise(text)
    return F.xxhash64(plain), F.xxhash64(F.lit(7), plain)


def bitmap(s: np.ndarray) -> np.ndarray:
    """LONGS longs; each bit is the parity of the hashes that fall on it, so two sets differ in as many hashes as bits at least."""
    odd = np.bincount((s & (64 * LONGS - 1)).astype(np.int64), minlength=64 * LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _lists(arrays: list[np.ndarray], kind: type) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.empty(0, dtype=kind)])))


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of the texts often has, sorted, and how often. They order the shingles; no result rests on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for text in b.column(0):
                s = np.unique(np.array(shingle_hashes(text.as_py(), WORDS), dtype=np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["s"])

    some = texts.filter(F.pmod("node", F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "s long")
    counted = cut(some.groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HOT_FROM))
    least, total = None, 0
    for n, k in sorted(((r[0], r[1]) for r in counted.groupBy("n").count().collect()), reverse=True):
        total += k
        if total > HOT_UP_TO:
            break
        least = n
    rows = counted.filter(F.col("n") >= least).collect() if least else []
    release(counted)
    got = np.array([(r[0], r[1]) for r in rows], dtype=np.int64).reshape(-1, 2)
    got = got[np.argsort(got[:, 0])]
    return got[:, 0], got[:, 1]


def _tables(fp: int) -> list[int]:
    """The bucket of a fingerprint in each table, as a signed long."""
    digest = lambda t, m: xxhash.xxh64_intdigest(t.to_bytes(2, "big") + (fp & m).to_bytes(8, "big"), 4)
    return [x - (1 << 64) if x >> 63 else x for x in (digest(t, m) for t, m in enumerate(MASKS))]


def _sets(texts: DataFrame, similarity: float) -> DataFrame:
    """``(node, part, n, bits, s, buckets, rest)`` of ``(node, text)``.

    ``n`` distinct five-word shingles, their bitmap, and the lower halves of their hashes, sorted. ``rest``
    says of each bucket how many shingles the text has from there on in the order of all; there are as many
    as leave less behind them than a similar text would need in common. The tables' buckets have none.
    A task takes each text once; ``part`` is the task's number, so (node, part) is unique.
    """
    hot, often = _common(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), set()
        for b in slices(batches):
            nodes, sizes, bits, sets, buckets, rest = [], [], [], [], [], []
            for node, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if node in seen:
                    continue
                seen.add(node)
                hashes = shingle_hashes(text.as_py(), WORDS)
                if not hashes:
                    continue
                s = np.unique(np.array(hashes, dtype=np.uint64)).view(np.int64)
                n = len(s)
                nodes.append(node), sizes.append(n), bits.append(bitmap(s)), sets.append(np.unique(s.astype(np.int32)))
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    s = s[np.lexsort((s, np.where(hot[at] == s, often[at], 0)))]
                k = n - int(np.ceil(similarity * n - SLACK)) + 1
                tables = _tables(fingerprint(hashes))
                buckets.append(np.concatenate([s[:k], np.array(tables, dtype=np.int64)]))
                rest.append(np.concatenate([n - np.arange(k), np.zeros(len(tables))]).astype(np.int32))
            columns = [pa.array(nodes, pa.int64()), pa.array([part] * len(nodes), pa.int32()), pa.array(sizes, pa.int32()), _lists(bits, np.int64), _lists(sets, np.int32), _lists(buckets, np.int64), _lists(rest, np.int32)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "part", "n", "bits", "s", "buckets", "rest"])

    return texts.select("node", "text").mapInArrow(run, "node long, part int, n int, bits array<long>, s array<int>, buckets array<long>, rest array<int>")


class Join:
    """Nodes with their buckets; finds links whose components are those of all links."""

    def __init__(self, texts: DataFrame, similarity: float) -> None:
        self.similarity = similarity
        self.sets = cut(_sets(texts, similarity))
        self.nodes = cut(self.sets.groupBy("node").agg(F.min_by(F.struct("part", "n", "bits"), "part").alias("x")).select("node", "x.*"))
        placed = self.sets.select("node", "n", F.explode(F.arrays_zip("buckets", "rest")).alias("b")).select("node", "n", F.col("b.buckets").alias("bucket"), F.col("b.rest").alias("rest"))
        full = placed.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("last")).filter("leader <> last").drop("last")
        self.members = cut(placed.join(full, "bucket").groupBy("bucket", "node").agg(*[F.first(c).alias(c) for c in ("n", "rest", "leader")]))

    def close(self) -> None:
        release(self.sets, self.nodes, self.members)

    def needed(self, n: Column, m: Column) -> Column:
        """What sets of ``n`` and ``m`` shingles have in common at least, if they are similar enough."""
        return F.lit(self.similarity / (1 + self.similarity)) * (n + m) - SLACK

    def near(self, pairs: DataFrame) -> DataFrame:
        """``(u, partu, v, partv, differ)``: the distinct pairs that bitmaps don't refuse."""
        ordered = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        of = lambda c: self.nodes.select(F.col("node").alias(c), *[F.col(m).alias(m + c) for m in ("part", "n", "bits")])
        both = ordered.join(of("u"), "u").join(of("v"), "v")
        differ = sum((F.bit_count(F.get("bitsu", F.lit(k)).bitwiseXOR(F.get("bitsv", F.lit(k)))) for k in range(LONGS)), F.lit(0))
        share = (differ / (F.col("nu") + F.col("nv"))).alias("differ")
        most = (1 - self.similarity) / (1 + self.similarity) + SLACK
        alike = F.least("nu", "nv") >= F.lit(self.similarity - SLACK) * F.greatest("nu", "nv")
        return both.filter(alike).select("u", "partu", "v", "partv", share).filter(F.col("differ") <= most)

    def verified(self, near: DataFrame) -> DataFrame:
        """Those of ``near`` whose shingles are similar enough."""
        near = cut(near.select("u", "partu", "v", "partv"))
        involved = near.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        sets, _ = parted(self.sets.select("node", "part", "s"), F.col("node"), involved)
        of = lambda c: sets.select(F.col("node").alias(c), F.col("part").alias(f"part{c}"), F.col("s").alias(f"s{c}"))
        both = near.join(of("u"), ["u", "partu"]).join(of("v"), ["v", "partv"])
        common = F.size(F.array_intersect("su", "sv"))
        out = cut(both.filter(common >= F.lit(self.similarity) * (F.size("su") + F.size("sv") - common)).select("u", "v"))
        release(near)
        return out

    def mixed(self, links: DataFrame) -> DataFrame:
        """The members of buckets that hold several groups, with their group as ``root``."""
        rows = self.members.join(connected_components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
        rows = cut(rows)
        several = rows.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("bucket")
        out = cut(rows.join(several, "bucket", "left_semi"))
        release(rows)
        return out

    def links(self) -> DataFrame:
        """Each text is compared with the likest of its buckets' least members; those of a bucket that are still apart, with
        its least member and one drawn anew. What these leave is compared whole: all pairs of a bucket that are not
        in one group yet and that the bounds do not refuse.
        """
        pairs = self.members.filter("node <> leader").select(F.col("node").alias("u"), F.col("leader").alias("v"))
        led = cut(self.near(pairs))
        likest = led.groupBy("u").agg(F.min_by(F.struct("partu", "v", "partv"), F.struct("differ", "v")).alias("x")).select("u", "x.*")
        links = self.verified(likest)
        release(led)

        rows = self.mixed(links)
        own = ("node", "root", "n", "rest")
        drawn = rows.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("bucket", "node").alias("h"), *own)).alias("drawn"), F.min(F.struct(*own)).alias("least"))
        others = F.explode(F.array("least", F.struct(*[f"drawn.{c}" for c in own])))
        apart = rows.join(drawn.select("bucket", others.alias("other")), "bucket").filter(F.col("root") != F.col("other.root"))
        apart = apart.filter((F.col("rest") == 0) | (F.least("rest", "other.rest") >= self.needed(F.col("n"), F.col("other.n"))))
        more = self.verified(self.near(apart.select(F.col("node").alias("u"), F.col("other.node").alias("v"))))
        release(rows)
        links, old = cut(links.unionByName(more)), (links, more)
        release(*old)

        rows = self.mixed(links)
        u, v = (rows.filter("rest > 0").select("bucket", *[F.col(c).alias(c + x) for c in ("node", "n", "rest", "root")]) for x in ("u", "v"))
        pairs = u.join(v, "bucket").filter((F.col("nodeu") < F.col("nodev")) & (F.col("rootu") != F.col("rootv")))
        pairs = pairs.filter(F.least("restu", "restv") >= self.needed(F.col("nu"), F.col("nv")))
        more = self.verified(self.near(pairs.select(F.col("nodeu").alias("u"), F.col("nodev").alias("v"))))
        release(rows)
        return links.unionByName(more)


def near_duplicate_groups(texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(node, root)`` for rows ``(node, text)``, whose node is ``text_hash`` of the text: the nodes that are linked to others, and the least of their group."""
    join = Join(texts, similarity)
    roots = connected_components(join.links())
    join.close()
    return roots


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Of each group of near-duplicates the row of the least ``key`` stays (nulls last; of equal keys, one row).

    Two texts are linked if their sets of five-word shingles (A-Z in lower case; a shorter text is
    one shingle) have a Jaccard similarity of at least ``similarity``; groups are what links connect.
    Texts without words, null included, are one group. Groups are exact, but for clashes of hashes: of 64
    bits for texts and shingles, of 32 bits where the shingles of two texts are compared. Rows of equal key
    and text are one row, whichever stays. All columns stay. An empty table gives no rows.
    """
    h1, h2 = text_hash(F.col(text))
    a, b = free_name(df, "_a"), free_name(df, "_b")
    roots = near_duplicate_groups(df.select(h1.alias("node"), F.col(text).alias("text")), similarity)
    own = df.groupBy(F.col(key).alias("key"), h1.alias("h1"), h2.alias("h2")).agg(F.count(F.lit(1)).alias("rows"))
    own = cut(own.join(roots.withColumnRenamed("node", "h1"), "h1", "left").withColumn("root", F.coalesce("root", "h1")))
    row = F.struct(F.col("key").isNull().alias("none"), "key", "h1", "h2")
    least = cut(own.groupBy("root").agg(F.min(row).alias("least")))
    gone = cut(own.join(least, "root").filter(row != F.col("least")).select(F.col("key"), F.col("h1"), F.col("h2")))
    repeated = own.filter("rows > 1").limit(1).count() > 0
    release(own, least)
    perhaps, stay = parted(df.withColumns({a: h1, b: h2}), F.col(a), gone.select("h1"))
    # an outer join, as Spark would push an anti join below the choice of rows
    met = perhaps.join(gone, perhaps[key].eqNullSafe(gone["key"]) & (perhaps[a] == gone["h1"]) & (perhaps[b] == gone["h2"]), "left")
    out = met.filter(gone["h1"].isNull()).select(*[perhaps[c] for c in stay.columns]).unionByName(stay)
    return (out.dropDuplicates([key, a, b]) if repeated else out).select(*df.columns)
