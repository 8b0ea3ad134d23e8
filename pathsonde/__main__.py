"""Command line over a stored table: ``python -m pathsonde TABLE VERB [ARGUMENTS]``."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession

from pathsonde.lang.fields import Context
from pathsonde.operators.reconcile import reconcile
from pathsonde.operators.search import Engine
from pathsonde.sources.entries import derive
from pathsonde.sources.table import VersionedTable
from pathsonde.sources.walk import FileTree
from pathsonde.tools import Tools


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="pathsonde", description=__doc__)
    p.add_argument("table", help="folder of the table")
    p.add_argument("verb", choices=["walk", "search", "count", "facets", "tree", "du", "dupes", "stat", "export", "explain", "syntax", "rescan", "status", "maintain", "forget"])
    p.add_argument("words", nargs="*", help="query, folder or path; for walk and rescan the roots; for forget a source; for export the target, then the query")
    p.add_argument("--sort", default="relevance")
    p.add_argument("--limit", type=int, default=40)
    p.add_argument("--columns", default="name,path,size,mtime,kind")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("pathsonde").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    table, text = VersionedTable(spark, a.table), " ".join(a.words)
    if a.verb == "walk":
        spark.dataSource.register(FileTree)
        print(json.dumps({"revision": table.publish(spark.read.format("filetree").option("path", "|".join(a.words)).load())}))
        return
    if a.verb == "rescan":
        spark.dataSource.register(FileTree)
        seen = spark.read.format("filetree").option("path", "|".join(a.words)).load()
        print(json.dumps({"revision": table.publish(reconcile(table.read(), seen, a.words))}))
        return
    if a.verb in ("status", "maintain", "forget"):
        done = {"status": table.stats, "maintain": lambda: {"folded": table.maintain(segments=0)}, "forget": lambda: {"revision": table.forget(int(text))}}[a.verb]()
        print(json.dumps(done))
        return
    tools = Tools(Engine(derive(table.read()), Context(int(time.time()))))
    answers = {
        "search": lambda: tools.search(text, a.sort, limit=a.limit), "count": lambda: tools.count(text), "facets": lambda: tools.facets(text, ["kind", "ext"]),
        "tree": lambda: tools.tree(text or "/", limit=a.limit), "du": lambda: tools.disk_usage(text or "/"), "dupes": lambda: tools.duplicates(under=text), "stat": lambda: tools.stat(text),
        "export": lambda: tools.export(" ".join(a.words[1:]), a.columns.split(","), a.words[0]), "explain": lambda: tools.explain(text), "syntax": tools.syntax,
    }
    out = answers[a.verb]()
    print(out if isinstance(out, str) else json.dumps(out, default=lambda x: vars(x) if hasattr(x, "__dict__") else str(x), ensure_ascii=False, indent=1))


if __name__ == "__main__":
    main()
