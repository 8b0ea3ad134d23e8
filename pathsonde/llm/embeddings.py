"""Near-duplicate vectors by cosine: a small-world graph per shard, and every vector queried in every shard."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathsonde.llm.common import cut, release
from pathsonde.llm.components import connected_components
from pathsonde.llm.hnsw import M0, Graph, batch_size

#: Shards at least, and slices of a shard's queries at least; bytes of a shard's graph and vectors at most, and of a slice's queries.
SHARDS, SLICES, SHARD_BYTES = 8, 3, 128_000_000
#: Beam to begin with; recall that audits ask for; queries audited of each batch.
EF, RECALL, AUDITED = 48, 0.999, 24
#: Nodes in a batch that a task returns.
ROWS = 4096
#: Nodes that a scan takes in the time in which a widened beam takes one place.
SCANNED = 64
#: Room for rounding in single precision; what lies in it is decided in double.
SLACK = 1e-4


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


class Shard:
    """A shard's graph, vectors, ids and multiplicities; queries find all links at a threshold."""

    def __init__(self, graph: Graph, x: np.ndarray, ids: np.ndarray, copies: np.ndarray, ef: int = EF) -> None:
        self.graph, self.x, self.ids, self.copies, self.ef = graph, x, ids, copies, ef
        self.parent = np.arange(len(ids))
        self.batch = batch_size(len(ids), x.shape[1])

    def _scan(self, q: np.ndarray, low: float) -> Iterator[np.ndarray]:
        for k in range(0, len(q), 64):
            for row in q[k : k + 64].astype(np.float32) @ self.graph.x.T:
                yield np.flatnonzero(row >= low)

    def _beams(self, q: np.ndarray, low: float, ef: int) -> list[np.ndarray | None]:
        """Candidates of each query; a beam that is half full of them is widened, or gives way to a scan (None) where that is cheaper."""
        out: list[np.ndarray | None] = [np.empty(0, dtype=np.int64)] * len(q)
        todo, cost = np.arange(len(q)), 2
        while len(todo):
            if cost * ef >= len(self.ids):
                for i in todo:
                    out[i] = None
                break
            ids, sims = self.graph.search(q[todo], ef)
            good = (sims >= low) & (ids >= 0)
            full = good.sum(axis=1) * 2 >= ef
            for k in np.flatnonzero(~full & good.any(axis=1)):
                out[todo[k]] = ids[k, good[k]]
            todo, ef, cost = todo[full], 2 * ef, SCANNED
        return out

    def candidates(self, q: np.ndarray, threshold: float) -> Iterator[np.ndarray]:
        """Nodes that may be linked to each query. Some queries are audited by a scan; if they fail, the beam is widened once for the batch.

        A batch that fails again has links which the graph does not lead to, and is scanned: beams for these would grow to the size of the
        shard. Scans are made as they are asked for, as the hits of a dense group are many.
        """
        low = threshold - SLACK
        for ef in (self.ef, 2 * self.ef):
            got = self._beams(q, low, ef)
            linked = [i for i, g in enumerate(got) if g is not None and len(g)][:AUDITED]
            some = [i for i in sorted({*linked, *range(0, len(q), max(1, len(q) // AUDITED))}) if got[i] is not None]
            sought = found = 0
            for i, want in zip(some, self._scan(q[some], low), strict=True):
                sought, found = sought + len(want), found + len(np.intersect1d(got[i], want))
                got[i] = None if 2 * len(want) > ef else want
            if found >= RECALL * sought:
                break
        else:
            got = [None] * len(q)
        scans = self._scan(q[[i for i, g in enumerate(got) if g is None]], low)
        for g in got:
            yield next(scans) if g is None else g

    def _root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def links(self, q: np.ndarray, ids: np.ndarray, threshold: float) -> tuple[list[int], list[int], list[int | None]]:
        """Rows (id, number of links, id of a linked vector or none); beside one row for each query with links, rows of 0 links join nodes that a query links.

        Together, the pairs of all rows have the components of all links.
        """
        a, n, b = [], [], []
        for i, hit in enumerate(self.candidates(q, threshold)):
            hit = hit[self.ids[hit] != ids[i]]
            if len(hit):
                hit = hit[self.x[hit] @ q[i] >= threshold]
            if not len(hit):
                continue
            roots = sorted({self._root(h) for h in hit.tolist()})
            a.append(int(ids[i])), n.append(int(self.copies[hit].sum())), b.append(int(self.ids[roots[0]]))
            for r in roots[1:]:
                self.parent[r] = roots[0]
                a.append(int(self.ids[r])), n.append(0), b.append(int(self.ids[roots[0]]))
        return a, n, b


def _runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
    """Stretches of the batches with equal numbers in these columns, and the numbers."""
    for batch in batches:
        keys = np.stack([batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names], axis=1).astype(np.int64)
        ends = [*(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip([0, *ends], ends, strict=False):
            if a < b:
                yield tuple(keys[a].tolist()), batch.slice(a, b - a)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch, all of one length, as they were given."""
    return batch.column(batch.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From vectors sorted by length, shard and uid, a row for each with its links in the shard's graph."""
    at, parts, x = None, [], []

    def flush() -> Iterator[pa.RecordBatch]:
        if at is None:
            return
        flat, counts = Graph(np.concatenate(x)).rows()
        x.clear()
        start, place = 0, 0
        for part in parts:
            ends = start + np.concatenate([[0], np.cumsum(counts[place : place + part.num_rows])])
            links = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((4 * (ends - start)).astype(np.int32)), pa.py_buffer(flat[start : ends[-1]])])
            start, place = int(ends[-1]), place + part.num_rows
            yield pa.RecordBatch.from_arrays([*part.columns, links], [*part.schema.names, "links"])
        parts.clear()

    for key, run in _runs(batches, ("dim", "shard")):
        if key != at:
            yield from flush()
            at = key
        for k in range(0, run.num_rows, ROWS):
            parts.append(run.slice(k, ROWS))
            x.append(unit(_matrix(parts[-1]).astype(np.float64)).astype(np.float32))
    yield from flush()


def _search(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by length, shard and slice, the nodes of the shard's graph first, in their order."""
    at, shard, x, nodes = None, None, [], []
    for (*key, asked), run in _runs(batches, ("dim", "shard", "slice", "asked")):
        if key != at:
            at, shard = key, None
            x.clear(), nodes.clear()
        if not asked:
            x += [unit(_matrix(run.slice(k, ROWS)).astype(np.float64)) for k in range(0, run.num_rows, ROWS)]
            links = run.column(run.schema.get_field_index("links")).to_pylist()
            nodes.append((_numbers(run, "uid").copy(), _numbers(run, "copies").copy(), np.array([len(b) // 4 for b in links]), np.frombuffer(b"".join(links), np.int32)))
            continue
        if shard is None:
            ids, copies, counts, flat = (np.concatenate(c) for c in zip(*nodes, strict=True))
            nodes.clear()
            every = np.concatenate(x)
            x.clear()
            shard = Shard(Graph.from_rows(every, flat, counts), every, ids, copies)
            del every, flat
        for k in range(0, run.num_rows, shard.batch):
            part = run.slice(k, shard.batch)
            got = shard.links(unit(_matrix(part).astype(np.float64)), _numbers(part, "uid"), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in got], ["a", "n", "b"])


def embedding_components(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, shards: int = SHARDS) -> DataFrame:
    """Per row of ``df``: ``key``, ``n_links``, ``component_id`` and ``kept``.

    Two vectors are linked if their cosine in double precision is at least ``threshold``. n_links
    counts the other rows linked to a row; component_id is the least key that links reach, the
    row's own included; kept says that the row's key is that one.

    Vectors that are null, empty or zero, or hold null or non-finite numbers, link with nothing, as do
    vectors of different lengths. Equal vectors are searched once and counted as often as they occur.
    Null keys never name a component unless all its keys are null. Other columns are not read. An empty table gives no rows.

    Each shard of at most about SHARD_BYTES has a graph, which is kept and sent as a row for each node, so that
    no row grows with the shard; every distinct vector queries the graphs of all shards. A beam half full of links is widened; queries of every batch are audited against a scan
    of the shard; a batch that fails gets wider beams, and is scanned if it fails again. Pairs are never listed: a search returns
    counts and, for each slice of queries, edges in proportion to its vectors.
    """
    c = F.col("v")
    fine = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(c, lambda x: x != 0)
    kind = T.ArrayType(T.FloatType()) if isinstance(t := df.select(vector).schema[0].dataType, T.ArrayType) and t.elementType == T.FloatType() else T.ArrayType(T.DoubleType())
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast(kind).alias("v"))
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    hashed = lambda d: d.withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(5), "v")})
    distinct = hashed(rows.filter("fine")).groupBy("k1", "k2").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("key").alias("least"))
    distinct = cut(distinct.withColumn("uid", F.monotonically_increasing_id()))
    (held,) = distinct.agg(F.sum(12 * F.size("v").cast("long") + 8 * M0)).first()
    most = math.ceil((held or 0) / SHARD_BYTES)
    shards, parts = max(1, shards, most), max(SLICES, most)
    vectors = distinct.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int").alias("shard"), "uid", "copies", "v")
    schema = T.StructType([*vectors.schema.fields, T.StructField("links", T.BinaryType())])
    graphs = cut(vectors.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "uid").mapInArrow(_graphs, schema))

    slices = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    indexes = graphs.select("dim", "shard", slices.alias("slice"), F.lit(0).alias("asked"), "uid", "v", "copies", "links")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    slice_ = F.pmod(F.xxhash64(F.lit(9), "uid"), F.lit(parts)).cast("int")
    asked = vectors.select("dim", every.alias("shard"), slice_.alias("slice"), F.lit(1).alias("asked"), "uid", "v", F.lit(None).cast("long").alias("copies"), F.lit(None).cast("binary").alias("links"))
    known = graphs.select("dim", "shard").distinct()  # a row for each graph
    asked = asked.join(F.broadcast(known), ["dim", "shard"], "left_semi").select(*indexes.columns)
    dealt = indexes.unionByName(asked).repartition("dim", "shard", "slice").sortWithinPartitions("dim", "shard", "slice", "asked", "uid")
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("a", "n", "b")])
    found = cut(dealt.mapInArrow(lambda it: _search(it, threshold), schema))

    counts = found.groupBy("a").agg(F.sum("n").alias("n")).select(F.col("a").alias("uid"), "n")
    roots = connected_components(found.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "uid")
    named = distinct.select("uid", "k1", "k2", "copies", "least").join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    own = named.join(least, "root").join(counts, "uid", "left")
    own = cut(own.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component"))
    release(graphs, found)
    usable = hashed(rows.filter("fine")).select("key", "k1", "k2").join(own, ["k1", "k2"]).select("key", "n_links", "component")
    out = usable.unionByName(rows.filter("not fine").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component")))
    return out.select(
        F.col("key").alias(key),
        F.col("n_links").cast("long").alias("n_links"),
        F.col("component").alias("component_id"),
        F.col("key").eqNullSafe(F.col("component")).alias("kept"),
    )
