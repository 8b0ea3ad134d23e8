from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from pathsonde.functions import paths
from pathsonde.lang.fields import Context
from pathsonde.operators import charts, content, export, reconcile, rules, usage
from pathsonde.operators.search import Engine
from pathsonde.sources.entries import SCHEMA, derive, with_directories
from pathsonde.sources.table import VersionedTable
from pathsonde.sources.walk import FileTree
from pathsonde.streaming import changes as feed
from pathsonde.tools import Tools

NOW = 1_785_000_000


def row(path, size=10, mtime=NOW, is_dir=False, links=1, source=0, **more):
    base = {"source": source, "path": path, "is_dir": is_dir, "size": size, "mtime": mtime, "ctime": mtime, "atime": mtime, "mode": 0o100644, "uid": 1, "gid": 1, "disk": 4096, "items": -1, "links": links} | more
    return tuple(base[f.name] for f in SCHEMA)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_usage_divides_hard_links_and_keeps_folders_apart(spark):
    own = derive(with_directories(table(spark, row("/a/f", 10, links=3), row("/a-b/g", 5), row("/a/x/h", 7, NOW - 8 * 86400), row("/z", 1))))
    sizes = {r.path: (r.bytes, r.files, r.age) for r in usage.subtree_sizes(own, NOW).collect()}
    assert sizes == {"/a": (10, 2, [3, 0, 7, 0, 0, 0]), "/a-b": (5, 1, [5, 0, 0, 0, 0, 0]), "/a/x": (7, 1, [0, 0, 7, 0, 0, 0])}
    assert usage.usage_root(own, "/", NOW).first().bytes == 16
    assert [r.path for r in usage.usage_children(own, "", NOW, top=1).collect()] == ["/a"]
    assert usage.usage_root(own, "/nowhere", NOW).first().files == 0


def test_tree_leaves_out_what_was_cut(spark):
    own = derive(with_directories(table(spark, row("/r/a/1"), row("/r/b/2"), row("/r/c/3"), row("/r/z"))))
    got = usage.tree(own, "/r", depth=2, limit=2).collect()
    assert [(r.path, r.level, r.children, r.truncated) for r in got] == [("/r/a", 1, 1, False), ("/r/b", 1, 1, False), ("/r/a/1", 2, None, False), ("/r/b/2", 2, None, False)]


def test_rules(spark):
    own = derive(with_directories(table(spark, *[row(p) for p in ("/proc/1", "/s/target/a", "/s/target/release/bin", "/s/target/release/deps/x", "/s/.git/objects/ab", "/s/.git/config", "/s/Thumbs.db", "/s/NODE_MODULES/y", "/keep/target/z", "/no/w")])))
    r = rules.Rules(allow=("target/release", "/keep"), deny=("/no",))
    stay, gone = rules.apply_rules(own, r)
    assert {x.path for x in stay.filter("not is_dir").collect()} == {"/s/target/release/bin", "/s/.git/config", "/keep/target/z"}
    assert {x.path for x in gone.collect()} >= {"/proc", "/s/target", "/s/.git/objects", "/no", "/s/NODE_MODULES"}
    assert r.may_contain_allowed("/s/target") and not r.may_contain_allowed("/s/x") and rules.Rules(allow=("/a/b/c",)).may_contain_allowed("/a")
    watched = own.filter(~r.excludes_path(F.col("path"))).select("path").collect()
    assert {x.path for x in watched} >= {"/s/target/release", "/s/target/release/bin"} and "/s/target/a" not in {x.path for x in watched}


def test_prefixes(spark):
    all_ = ["/a", "/a/b", "/a-b", "/c/d", "/c/d/e", "/c"]
    got = {r.path for r in rules.reduce_prefixes(spark.createDataFrame([(p,) for p in all_ * 2], "path string")).collect()}
    assert got == {"/a", "/a-b", "/c"} == set(paths.reduce_prefixes(all_))
    own = table(spark, row("/a/x"), row("/ab"), row("/c"))
    pre = spark.createDataFrame([("/a",), ("/c",)], "path string")
    assert {r.path for r in rules.covered(own, pre).collect()} == {"/a/x", "/c"} and {r.path for r in rules.covered(own, pre, "left_anti").collect()} == {"/ab"}


def change(seq, op, path, size=None):
    return (seq, op, 0, path, row(path, size)[2:] if size is not None else None)


CHANGES = f"seq long, op string, source int, path string, entry struct<{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in SCHEMA.fields[2:])}>"


def test_changes_in_order(spark):
    own = table(spark, row("/d/a"), row("/d/b"), row("/d-e/c"), row("/k"))
    batch = spark.createDataFrame([change(1, "upsert", "/d/new", 5), change(2, "remove_subtree", "/d"), change(3, "upsert", "/d/a", 7), change(4, "upsert", "/k", 8), change(5, "upsert", "/k", 9), change(6, "rescan", "/d-e"), change(7, "upsert", "/q/r", 1), change(8, "remove_subtree", "/q/r")], CHANGES)
    got = {r.path: r.size for r in reconcile.apply_changes(own, batch).collect()}
    assert got == {"/d/a": 7, "/d-e/c": 10, "/k": 9}
    report = reconcile.apply_report(own, batch).first()
    assert (report.upserted, report.unchanged, report.subtrees_removed, report.rows_removed) == (2, 0, 2, 2)
    assert reconcile.forget(own, 0).count() == 0
    twice = own.unionByName(table(spark, row("/d/a", source=1)))
    assert reconcile.apply_report(twice, batch).first().rows_removed == 2


def test_sweep_spares_what_was_not_seen(spark):
    own = table(spark, row("/r/a"), row("/r/b"), row("/blind/x"), row("/other/y"), row("/r/z", source=1))
    snap = table(spark, row("/r/a", atime=5, disk=1), row("/r/n"))
    states = {(r.source, r.path): r.state for r in reconcile.classify(own, snap, ["/r", "/blind"], ["/blind"]).collect()}
    assert states == {(0, "/r/a"): "unchanged", (0, "/r/b"): "gone", (0, "/r/n"): "new", (0, "/blind/x"): "spared", (0, "/other/y"): "spared", (1, "/r/z"): "spared"}
    assert {r.path for r in reconcile.reconcile(own, snap, ["/r"], []).collect()} == {"/r/a", "/r/n", "/blind/x", "/other/y", "/r/z"}
    assert reconcile.reconcile(own, snap.limit(0)).count() == own.count()


def test_stream_applies_each_batch_once(spark, tmp_path):
    where = f"file://{tmp_path}"
    t = VersionedTable(spark, f"{where}/t")
    assert t.revision() == -1 and t.read().count() == 0 and not t.wait(0, 0.2)
    t.publish(table(spark, row("/d/a"), row("/k")))
    for batch in ([change(1, "remove_subtree", "/d")], [change(2, "upsert", "/d/a", 3), change(3, "upsert", "/n", 4)]):
        spark.createDataFrame(batch, CHANGES).coalesce(1).write.mode("append").parquet(f"{where}/feed")
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(f"{where}/feed")
    feed.apply_stream(stream, t, f"{where}/c").awaitTermination()
    assert t.revisions() == [0, 1, 2] and t.wait(2, 0)
    before = sorted(t.read().collect())
    t.maintain(segments=1)
    assert t.layers() == (2, []) and sorted(t.read().collect()) == before and not t.maintain()
    assert {r.path: r.size for r in t.read().collect()} == {"/d/a": 3, "/k": 10, "/n": 4}
    spark.createDataFrame([change(4, "upsert", "/late", 6)], CHANGES).coalesce(1).write.mode("append").parquet(f"{where}/feed")
    feed.apply_stream(stream, VersionedTable(spark, f"{where}/t"), f"{where}/c").awaitTermination()
    assert t.revision() == 3 and t.read().count() == 4  # a restart goes on where the batches' numbers do
    t.compact()
    assert t.revisions() == [3] and t.read().count() == 4


def test_compaction_keeps_rows(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    t.publish(table(spark, row("/d/a"), row("/k")))
    t.append(spark.createDataFrame([change(2, "upsert", "/n", 4)], CHANGES))
    stats = t.stats()
    assert stats.pop("bytes") > 500 and stats == {"entries": 3, "directories": 0, "unsorted": 1, "removals": 0}
    t.maintain(segments=0)
    t.compact()
    assert t.revisions() == [1] and t.read().count() == 3
    assert t.read().count() == 3 and t.read(t.forget(5)).count() == 3 and t.read(t.forget(0)).count() == 0 and t.read(t.clear()).count() == 0


def test_debounce(spark):
    rows_ = [(0, 0, "/a/b"), (0, 300, "/a"), (0, 700, "/c"), (0, 2000, "/d"), (0, 2400, ""), (0, 2450, "/x"), *[(1, k * 400, f"/p{k}") for k in range(10)]]
    got = {(r.source, r.burst, r.run_at): r.paths for r in feed.debounce(spark.createDataFrame(rows_, "source int, at_ms long, path string")).collect()}
    assert got == {(0, 0, 1200): ["/a", "/c"], (0, 1, 2450): [""], (1, 0, 3000): [f"/p{k}" for k in range(8)], (1, 0, 4100): ["/p8", "/p9"]}


def test_debounce_stream(spark, tmp_path):
    spark.createDataFrame([(1, "/a/b"), (1, "/a"), (2, "")], "source int, path string").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("source int, path string").parquet(f"file://{tmp_path}/in")
    q = feed.debounce_stream(stream).writeStream.format("memory").queryName("gathered").outputMode("append").trigger(processingTime="200 milliseconds").option("checkpointLocation", f"file://{tmp_path}/c").start()
    try:
        deadline = time.time() + 60
        while time.time() < deadline and spark.table("gathered").count() < 2:
            time.sleep(0.3)
        assert {r.source: r.paths for r in spark.table("gathered").collect()} == {1: ["/a"], 2: [""]}
    finally:
        q.stop()


def test_walk(spark, tmp_path):
    for p in ("a/x.txt", "a/deep/y.rs", "b/.hid", "top", "skip/z"):
        os.makedirs(tmp_path / os.path.dirname(p), exist_ok=True)
        (tmp_path / p).write_text("12345")
    spark.dataSource.register(FileTree)
    load = lambda **o: spark.read.format("filetree").options(path=str(tmp_path), exclude="skip", **o).load()
    got = {r.path.removeprefix(str(tmp_path)): (r.is_dir, r.size) for r in load().collect()}
    assert got == {"": (True, 0), "/a": (True, 0), "/a/x.txt": (False, 5), "/a/deep": (True, 0), "/a/deep/y.rs": (False, 5), "/b": (True, 0), "/b/.hid": (False, 5), "/top": (False, 5)}
    (tmp_path / "b" / os.fsdecode(b"x\xff.txt")).write_text("")
    assert f"{tmp_path}/b/x\uf7ff.txt" in {r.path for r in load().collect()}
    (tmp_path / "b" / os.fsdecode(b"x\xff.txt")).unlink()
    os.symlink(tmp_path / "a", tmp_path / "a" / "deep" / "up")
    linked = {r.path.removeprefix(str(tmp_path)) for r in load(follow="true").collect()}
    assert linked == set(got)
    ruled = load(rules=json.dumps({"dirs": ["deep", "b"], "files": ["TOP"], "paths": [], "allow": [f"{tmp_path}/a/deep/up"]}))
    assert {r.path.removeprefix(str(tmp_path)) for r in ruled.collect()} == {"", "/a", "/a/x.txt", "/a/deep/up"}
    assert {r.size for r in load(metadata="false", hidden="false").collect()} == {0} and load(hidden="false").filter("path like '%hid'").count() == 0


def test_csv(spark, tmp_path):
    own = derive(table(spark, row('/a/x,"y"\r\n.txt', mtime=0), row("/a/z", items=3)))
    export.write_csv(own.coalesce(1), ["name", "size", "mtime", "nonsense", "items"], f"file://{tmp_path}/out")
    raw = next((tmp_path / "out").glob("part*")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfname,size,mtime,nonsense,items\r\n") and b'"x,""y""\r\n.txt",10,,,\r\n' in raw and b"z,10,2026-07-25 17:20:00,,3\r\n" in raw


def test_grep(spark):
    text = "no\nLICENSE and lıcense\n" + "x" * 300 + " license " + "y" * 300 + "\nlicense\nlicense"
    contents = spark.createDataFrame([(0, "/a", text), (0, "/b", "nothing"), (0, "/c", "a\0license"), (0, "/d", "")], "source int, path string, content string")
    got = content.grep_hits(contents, content.pattern_of("license")).collect()
    assert [r.path for r in got] == ["/a"] and got[0].more and [(h.line, h.at, h.length) for h in got[0].hits] == [(2, 0, 7), (3, 80, 7), (4, 0, 7)]
    assert got[0].hits[1].offset == text.encode().index(b" license y") + 1 and len(got[0].hits[1].excerpt) == 160
    assert content.grep_hits(contents, content.pattern_of("license"), include_binary=True).count() == 2
    assert content.grep_hits(contents, content.pattern_of("6c 69", "hex"), kind="hex").count() == 1 and content.grep_hits(contents, content.pattern_of("^lic", "regex", exact=True)).count() == 1
    raw = spark.createDataFrame([(bytearray("\ufefflicense".encode("utf-16-le")),), (bytearray("\ufefflicense".encode("utf-16-be")),), (bytearray(b"license"),)], "b binary")
    assert {r.t for r in raw.select(content.decoded(F.col("b")).alias("t")).collect()} == {"license"}


def test_grep_in_bytes(spark):
    files = [("/jpg", b"\xff\xd8\xff\xe0\n\0ab\xff\xd8\xff"), ("/16", "\ufeffno\nlicense".encode("utf-16-le")), ("/8", "é license".encode()), ("/odd", b"\xff\xfea"), ("/bad", b"\xc3( license")]
    contents = spark.createDataFrame([(0, p, bytearray(b)) for p, b in files], "source int, path string, content binary")
    got = content.grep_hits(contents, content.pattern_of("FF d8 0xff", "hex"), include_binary=True, kind="hex").collect()
    assert [(r.path, [(h.line, h.offset, h.length) for h in r.hits]) for r in got] == [("/jpg", [(1, 0, 3), (2, 8, 3)])]
    text = {r.path: r.hits[0].offset for r in content.grep_hits(contents, content.pattern_of("license")).collect()}
    assert text == {"/16": 3, "/8": 3, "/bad": 5}


def test_duplicates(spark):
    own = derive(table(spark, *[row(f"/{n}", s) for n, s in (("a", 9), ("b", 9), ("c", 9), ("d", 4), ("e", 9))]))
    contents = spark.createDataFrame([(0, "/a", "x" * 9), (0, "/b", "x" * 9), (0, "/c", "x" * 4 + "y" + "x" * 4), (0, "/d", "zzzz"), (0, "/e", "x" * 9)], "source int, path string, content string")
    groups, members = content.content_groups(content.duplicate_candidates(own, 1), contents)
    assert [(g.size, g.files, g.waste, g.first_path) for g in groups.collect()] == [(9, 3, 18, "/a")] and {m.path for m in members.collect()} == {"/a", "/b", "/e"}
    report = content.duplicate_report(own, content.size_groups(own), groups).first()
    assert (report.candidates, report.waste, report.proven) == (5, 27, 18)


def test_all_candidates_of_duplicates(spark):
    many = spark.range(200_010).selectExpr("concat('/f', id) path", "if(id < 10, 5, 1000 + id) size")
    own = many.selectExpr("0 source", "path", "false is_dir", "size", *(f"0L {n}" for n in ("mtime", "ctime", "atime", "mode", "uid", "gid", "disk", "items")), "1L links")
    assert content.duplicate_candidates(own, 1).count() == 200_010 and content.duplicate_candidates(own, 1001).count() == 200_000
    small = [("/f0", "x" * 5), ("/f1", "x" * 5), ("/f2", "y" * 5)]
    contents = spark.createDataFrame([(0, *x) for x in small], "source int, path string, content string")
    engine = Engine(derive(own), Context(NOW))
    assert [(g["size"], g["files"], g["waste"], g["first_path"]) for g in Tools(engine).duplicates(1)] == [(5, 10, 45, "/f0")]
    assert [(g["size"], g["files"], g["first_path"]) for g in Tools(engine, contents).duplicates(1)] == [(5, 2, "/f0")]


def test_charts(spark):
    v = spark.createDataFrame([(0, 1), (1, 1), (2, 1)], "idx int, value long")
    assert [r.share for r in charts.shares(v).orderBy("idx").collect()] == [33.4, 33.3, 33.3]
    assert [r.cells for r in charts.cells(v, 8).orderBy("idx").collect()] == [3, 3, 2]
    assert [r.share for r in charts.shares(v.withColumn("value", F.lit(0))).collect()] == [0.0] * 3
    assert charts.ribbon_edges()[-5:] == [471, 527, 588, 656, 730] and len(charts.ribbon_edges()) == 24
    assert [r.b for r in spark.createDataFrame([(0.5,), (6.0,), (29.0,), (364.0,), (700.0,), (900.0,)], "d double").select(charts.row_band(F.col("d")).alias("b")).collect()] == [0, 1, 2, 3, 4, 5]


def test_empty_table(spark):
    own = derive(spark.createDataFrame([], SCHEMA))
    e = Engine(own, Context(NOW))
    assert e.rows("x").count() == 0 and e.count("").first().total == 0 and usage.subtree_sizes(own, NOW).count() == 0


def test_owner(spark):
    roots = spark.createDataFrame([(1, "/parts"), (2, "/parts/x")], "source int, root string")
    e = Engine(derive(table(spark, row("/parts/x/y"))), Context(NOW))
    got = {r.path: r.source for r in e.owner_of(roots, spark.createDataFrame([("/parts/x/y",), ("/parts/xy",), ("/q",)], "path string")).collect()}
    assert got == {"/parts/x/y": 2, "/parts/xy": 1, "/q": None}
