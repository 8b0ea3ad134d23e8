from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pathsonde.llm import embeddings
from pathsonde.llm.embeddings import embedding_components, unit
from pathsonde.llm.hnsw import Graph


def brute(rows, threshold=0.95):
    fine = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: [] for i in range(len(rows))}
    for dim in {len(rows[i][1]) for i in fine}:
        own = [i for i in fine if len(rows[i][1]) == dim]
        x = unit(np.array([rows[i][1] for i in own], dtype=np.float32).astype(np.float64))
        for a, b in zip(*np.nonzero(x @ x.T >= threshold), strict=True):
            if a != b:
                links[own[a]].append(own[b])
    label = {}
    for i in range(len(rows)):
        if i in label:
            continue
        group, todo = {i}, [i]
        while todo:
            todo += (new := set(links[todo.pop()]) - group)
            group |= new
        keys = [rows[j][0] for j in group if rows[j][0] is not None]
        label |= {j: min(keys, default=None) for j in group}
    return [(k, len(links[i]), label[i], k == label[i]) for i, (k, _) in enumerate(rows)]


def same(got, want):
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def data(seed, n, clusters, size, dim=32):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for _ in range(clusters):
        c = rng.normal(size=dim)
        x = np.concatenate([x, c + rng.normal(size=(size, dim)) * rng.choice([0.05, 0.15, 0.22])])
    return rng.permutation(x.astype(np.float32)).astype(float)


def test_recall_against_brute_force():
    x = unit(data(1, 3000, 40, 20))
    graph = Graph(x)
    for g in (graph, Graph.load(graph.dump())):
        ids, sims = g.search(x, 96)
        truth = (x @ x.T >= 0.95).sum()
        assert ((sims >= 0.95) & (ids >= 0)).sum() >= 0.98 * truth
        assert all(len(set(r[r >= 0])) == (r >= 0).sum() for r in ids[:200])


def test_against_brute_force(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(data(2, 700, 12, 30))]
    rows += [(2000 + i, rows[5][1]) for i in range(40)] + [(3000 + i, (np.array(rows[7][1]) * 3).tolist()) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    same(embedding_components(df).collect(), brute(rows))
    same(embedding_components(df, shards=3).collect(), brute(rows))


def test_one_dense_cluster(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=16) + rng.normal(size=(900, 16)) * 0.2
    rows = [(i, v.astype(np.float32).astype(float).tolist()) for i, v in enumerate(x)]
    same(embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), shards=2).collect(), brute(rows))


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [inf, 1.0]), (6, [nan, 1.0]), (7, [1.0, 2.0]), (3, [2.0, 4.0]), (None, [1.0, 2.0]), (9, [1.0, 2.0, 0.0]), (7, [1.0, 2.0]), (None, [9.0, -1.0]), (10, [1e38, 2e38])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    same(embedding_components(df).collect(), [r if r[0] is not None else (None, r[1], r[2], r[2] is None) for r in brute(rows)])
    assert embedding_components(df.limit(0)).count() == 0
    assert embedding_components(df.filter("vec_id = 1")).count() == 1


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(rows)
    same(embedding_components(df).collect(), want)


def test_no_row_holds_a_graph(spark, monkeypatch):
    largest, cut = [], embeddings.cut

    def spy(df):
        out = cut(df)
        largest.extend(out.agg(F.max(F.octet_length(n))).first()[0] for n, t in out.dtypes if t == "binary")
        return out

    monkeypatch.setattr(embeddings, "cut", spy)
    rows = [(i, v.tolist()) for i, v in enumerate(data(6, 1200, 5, 20))]
    got = embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), shards=1).collect()
    same(got, brute(rows))
    assert largest and max(largest) < 1000


def test_beams_stay_narrow_where_the_graph_is_torn(monkeypatch):
    x, widths = unit(data(7, 3000, 20, 10)), []
    ids, graph, search = np.arange(len(x)), Graph(x), Graph.search
    graph.layers[0].links[:] = -1  # no beam leads anywhere
    monkeypatch.setattr(Graph, "search", lambda self, q, ef: widths.append(ef) or search(self, q, ef))
    a, n, _ = embeddings.Shard(graph, x, ids, np.ones(len(x), dtype=np.int64)).links(x[:500], ids[:500], 0.95)
    want = (x[:500] @ x.T >= 0.95).sum(axis=1) - 1
    assert {i: k for i, k in zip(a, n, strict=True) if k} == {i: k for i, k in enumerate(want.tolist()) if k}
    assert max(widths) <= 2 * embeddings.EF
