from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pathsonde import __main__ as cli
from pathsonde.lang.fields import Context
from pathsonde.operators.preview import preview
from pathsonde.operators.search import Engine
from pathsonde.sources.mock import mock_entries
from pathsonde.sources.mounts import mounts, volumes
from pathsonde.tools import PageCache, Tools

NOW = 1_785_000_000


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(mock_entries(spark, 3000).cache(), Context(NOW))


def test_mock(spark, engine):
    files = engine.entries.filter("not is_dir")
    assert files.count() == 3000 == files.select("path").distinct().count()
    assert sorted(mock_entries(spark, 500).select("path", "mtime").collect()) == sorted(mock_entries(spark, 500).select("path", "mtime").collect())
    sizes = [r[1] for r in files.groupBy(F.element_at(F.split("path", "/"), 4)).count().collect()]
    assert len(sizes) > 3 and max(sizes) > 2 * min(sizes) and files.filter("mtime > 1785000060 or size < 0 or disk % 4096 <> 0").count() == 0


def test_requests(spark, engine):
    contents = engine.entries.filter("not is_dir").selectExpr("source", "path", "if(ext = 'py', 'import x\\nreport', 'nothing') content")
    t = Tools(engine, contents)
    assert len(t.search("final", limit=7)) == 7 and t.count("final", 5) == {"total": 5, "capped": True}
    assert {r["question"] for r in t.facets("final", ["kind", "ext"])} == {"kind", "ext"}
    assert t.tree("/srv", limit=3) and t.disk_usage("/srv")["files"] == 3000 and t.duplicates(1)[0]["files"] > 1
    assert {r["path"] for r in t.grep("ext:py", "REPORT", top=5)} and t.stat("/srv")[0]["is_dir"] and t.sources() == []
    assert t.explain("ext:py")["sentence"] == "the extension is py" and "ext:" in t.syntax()


def test_page_cache(engine):
    c, want = PageCache(), [r["path"] for r in Tools(engine).search("final", "size", True, 10, 5)]
    got = [r["path"] for r in c.page(engine, 1, "final", "size", True, 10, 5)]
    kept = c.rows
    assert got == want and [r["path"] for r in c.page(engine, 1, "final", "size", True, 10, 5)] == want and c.rows is kept
    c.page(engine, 2, "final", "size", True, 0, 5)
    assert c.rows is not kept
    c.drop()


def test_mounts(spark, tmp_path):
    lines = "22 1 8:1 / / rw,noatime shared:1 - ext4 /dev/sda1 rw\n23 22 8:1 /x /srv/b\\040c rw - ext4 /dev/sda1 rw\n24 22 0:5 / /proc rw - proc proc rw\n25 22 0:9 / /net rw - nfs4 host:/x rw\n26 22 8:9 / /media/u/stick rw - vfat /dev/sdb1 rw\n"
    (tmp_path / "m").write_text(lines)
    m = mounts(spark, f"file://{tmp_path}/m")
    assert {r.mount: r.noatime for r in m.collect()} == {"/": True, "/srv/b c": False, "/proc": False, "/net": False, "/media/u/stick": False}
    assert {r.mount: (r.kind, r.roots) for r in volumes(m).collect()} == {"/": ("system", ["/"]), "/net": ("network", ["/net"]), "/media/u/stick": ("removable", ["/media/u/stick"])}
    more = "27 22 8:2 / /data rw - ext4 /dev/b rw\n28 22 8:2 / /data/again rw - ext4 /dev/b rw\n29 22 8:2 / /copy rw - ext4 /dev/b rw\n30 22 8:3 / /boot rw - ext4 /dev/c rw\n31 22 8:4 / /run/media/u/x rw - udf /dev/d rw\n"
    (tmp_path / "m2").write_text(more)
    got = {r.mount: (r.kind, r.roots) for r in volumes(mounts(spark, f"file://{tmp_path}/m2")).collect()}
    assert got == {"/copy": ("internal", ["/copy", "/data"]), "/run/media/u/x": ("removable", ["/run/media/u/x"])}


def test_preview(spark, engine):
    some = engine.entries.filter("not is_dir").limit(60)
    contents = some.selectExpr("source", "path", "if(length(path) % 2 = 0, 'a\\nb\\nc', 'x\\0y') content")
    got = {r.shape: r.head for r in preview(some.filter("ext in ('pdf', 'rs', 'py', 'md', 'txt', 'h')"), contents, lines=2).collect()}
    assert got.get("text", "a\nb") == "a\nb" and set(got) <= {"text", "binary", "pdf"}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "one.py").write_text("x")
    table = f"file://{tmp_path}/table"
    cli.main([table, "walk", str(tmp_path / "d")])
    cli.main([table, "search", "ext:py"])
    out = capsys.readouterr().out
    assert json.loads(out[: out.index("\n")]) == {"revision": 0} and "one.py" in out
    (tmp_path / "d" / "two.py").write_text("y")
    (tmp_path / "d" / "one.py").unlink()
    cli.main([table, "rescan", str(tmp_path / "d")])
    cli.main([table, "status"])
    cli.main([table, "search", "ext:py"])
    out = capsys.readouterr().out
    assert '"entries": 2' in out and "two.py" in out and "one.py" not in out
    cli.main([table, "export", f"file://{tmp_path}/csv", "two"])
    assert "two.py" in "".join(p.read_text() for p in Path(tmp_path / "csv").glob("part*"))
