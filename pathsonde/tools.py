"""Bounded, read-only requests, each answered with plain values: what a command line or another program asks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pathsonde.lang import introspect
from pathsonde.operators import content, export, facets, usage
from pathsonde.operators.search import COUNT_CAP, PAGE, Engine, keyed, order

#: The most that one request may ask for.
ROWS_MOST, COUNT_MOST, GROUPS_MOST = 1_000, 10_000_000, 500
ROW = ("source", "path", "is_dir", "size", "mtime")


def _plain(df: DataFrame, most: int) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.limit(most).collect()]


class Tools:
    """Requests over one engine; ``contents`` and ``sources`` are optional tables."""

    def __init__(self, engine: Engine, contents: DataFrame | None = None, sources: DataFrame | None = None) -> None:
        self.engine, self.contents, self.sources_table = engine, contents, sources

    def search(self, query: str, sort: str = "relevance", descending: bool | None = None, offset: int = 0, limit: int = PAGE) -> list[dict]:
        return _plain(self.engine.rows(query, sort, descending, offset, min(limit, ROWS_MOST)).select(*ROW), ROWS_MOST)

    def count(self, query: str, cap: int = COUNT_CAP) -> dict:
        return self.engine.count(query, min(cap, COUNT_MOST)).first().asDict()

    def facets(self, query: str, questions: list[str], top: int = 20) -> list[dict]:
        return _plain(facets.facets(self.engine.where(query), questions, self.engine.context.now, min(top, GROUPS_MOST)), len(questions) * GROUPS_MOST)

    def tree(self, folder: str, depth: int = 1, limit: int = usage.TREE_ROWS) -> list[dict]:
        return _plain(usage.tree(self.engine.entries, folder, min(depth, 8), min(limit, ROWS_MOST)), ROWS_MOST * 8)

    def disk_usage(self, folder: str = "/", query: str = "", top: int = usage.TOP) -> dict:
        rows, now = self.engine.where(query), self.engine.context.now
        root = usage.usage_root(rows, folder, now).first().asDict()
        return root | {"children": _plain(usage.usage_children(rows, folder, now, min(top, GROUPS_MOST)), GROUPS_MOST)}

    def duplicates(self, floor: int = content.FLOOR, under: str = "", top: int = content.TOP_GROUPS) -> list[dict]:
        some = content.duplicate_candidates(self.engine.entries, floor, under)
        groups = content.size_groups(some) if self.contents is None else content.content_groups(some, self.contents)[0]
        return _plain(content.top_groups(groups, min(top, GROUPS_MOST)), GROUPS_MOST)

    def grep(self, query: str, needle: str, kind: str = "text", exact: bool = False, top: int = content.TOP_FILES) -> list[dict]:
        return [] if self.contents is None else _plain(content.grep(self.engine, self.contents, query, needle, kind, exact, min(top, ROWS_MOST)), ROWS_MOST)

    def stat(self, path: str) -> list[dict]:
        return _plain(self.engine.stat(path), ROWS_MOST)

    def export(self, query: str, columns: list[str], path: str) -> None:
        export.write_csv(self.engine.where(query), columns, path)

    def explain(self, query: str) -> dict:
        return self.engine.explain(query)

    def syntax(self) -> str:
        return introspect.syntax()

    def sources(self) -> list[dict]:
        return [] if self.sources_table is None else _plain(self.sources_table, ROWS_MOST)


class PageCache:
    """The first ordered rows of the last question, kept while neither question nor revision changes; relative times are part of the question."""

    ROWS = 20_000

    def __init__(self) -> None:
        self.key, self.rows = None, None

    def page(self, engine: Engine, revision: int, query: str, sort: str, descending: bool, offset: int, limit: int) -> list[dict]:
        key = (revision, engine.parse(query), sort, descending)
        if key != self.key:
            self.drop()
            ordered = keyed(engine.where(key[1]), sort, key[1]).orderBy(*order(descending))
            self.key, self.rows = key, ordered.limit(self.ROWS).cache()
        if offset + limit > self.ROWS:
            return _plain(engine.rows(query, sort, descending, offset, limit).select(*ROW), ROWS_MOST)
        return _plain(self.rows.orderBy(*order(descending)).offset(offset).limit(limit).select(*ROW), ROWS_MOST)

    def drop(self) -> None:
        if self.rows is not None:
            self.rows.unpersist()
        self.key = self.rows = None
