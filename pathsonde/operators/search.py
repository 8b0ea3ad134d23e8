"""Search: filter, order, page; counts with a cap; approximate spellings where nothing was found."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathsonde.functions import paths
from pathsonde.functions.text import unaccent_folded
from pathsonde.lang import ast, fields, introspect, parser
from pathsonde.plans.compile import filter_column

#: Rows of a page, the most a page may have, and where counting stops.
PAGE, PAGE_MOST, COUNT_CAP, SIMILAR_CAP = 200, 1_000, 10_000, 1_000
#: Folders whose contents are generated, the steps one of them or a hidden one counts for, and the most that count.
GENERATED_DIRS = "target build out dist node_modules vendor __pycache__ site-packages obj .gradle cmakefiles".split()
AWAY, STEPS_MOST, STEP_COST = 3, 60, 8
#: Orders that start with the largest value.
DESCENDING_FIRST = frozenset({"relevance", "size", "modified", "created", "accessed", "disk"})
COLUMNS = {"name": "bare", "path": "path", "size": "size", "modified": "mtime", "created": "ctime", "accessed": "atime", "ext": "ext", "kind": "kind", "mode": "mode", "uid": "uid", "gid": "gid", "disk": "disk"}
SORTS = ("relevance", *COLUMNS)


def steps_of(parent: Column) -> Column:
    """How far a folder is from home: a step for each part, more for hidden and generated ones."""
    parts = F.filter(F.split(parent, "/"), lambda p: p != "")
    far = lambda p: p.startswith(".") | F.lower(p).isin(*GENERATED_DIRS)
    steps = F.aggregate(parts, F.lit(0), lambda n, p: n + F.when(far(p), AWAY).otherwise(1))
    return F.least(steps, F.lit(STEPS_MOST))


def relevance(query: ast.Query) -> Column:
    """The best rung of any scored term, less what a long name and a remote folder cost."""
    terms = [unaccent_folded(t) for t in query.scored_terms()]
    terms = [t for t in terms if t]
    if not terms:
        return F.lit(0).cast("long")
    name = F.col("bare")
    last = F.substring_index(name, ".", -1)
    dot = F.char_length(name) - F.char_length(last)
    stem = F.when(name.contains(".") & (dot > 1), F.substr(name, F.lit(1), dot - 1))
    rungs = []
    for t in terms:
        at = F.instr(name, t)
        before = F.substr(name, at - 1, F.lit(1))
        word = ~before.rlike("^[A-Za-z0-9]$")
        rungs.append(F.when(at == 0, 0).when(F.coalesce(stem == t, F.lit(False)), 4000).when(name == t, 3000).when(at == 1, 2000).when(word, 1000).otherwise(100))
    best = F.greatest(*rungs) if len(rungs) > 1 else rungs[0]
    return (best - F.least(F.octet_length(name), F.lit(255)) - STEP_COST * steps_of(F.col("parent"))).cast("long")


#: Holds the primary key while rows are ordered, so that it is computed once for each row.
KEY = "_key"


def keyed(rows: DataFrame, sort: str, query: ast.Query, weights: DataFrame | None = None) -> DataFrame:
    """Rows with their primary key; with ``weights(path, disk)`` the size of a folder is the disk space under it."""
    if sort == "size" and weights is not None:
        own = F.when(F.col("is_dir"), F.coalesce(F.col("_under"), F.lit(0))).otherwise(F.col("size"))
        return rows.join(weights.select("path", F.col("disk").alias("_under")), "path", "left").withColumn(KEY, own).select(*rows.columns, KEY)
    return rows.withColumn(KEY, relevance(query) if sort == "relevance" else F.col(COLUMNS[sort]))


def order(descending: bool) -> list[Column]:
    """Primary key in the asked direction; ties always newest first, then by path."""
    return [F.desc(KEY) if descending else F.asc(KEY), F.desc("mtime"), F.asc("path")]


@dataclass(frozen=True)
class Page:
    """What a search returns: ordered rows, how many there are (to the cap), and how the query was read."""

    rows: DataFrame
    total: DataFrame
    misread: list
    sentence: str


class Engine:
    """Queries over one version of the derived entries; ``weights``, as of ``usage.subtree_sizes``, order folders by what they hold."""

    def __init__(self, entries: DataFrame, context: fields.Context, exact_accents: bool = False, typos: str = "suggest", weights: DataFrame | None = None) -> None:
        self.entries, self.context, self.exact_accents, self.typos, self.weights = entries, context, exact_accents, typos, weights

    def parse(self, text: str) -> ast.Query:
        query = parser.parse(text, self.context, self.exact_accents)
        return query.forgiving() if self.typos == "always" else query

    def where(self, text: str | ast.Query) -> DataFrame:
        """All matching rows, in no order and without a limit."""
        query = self.parse(text) if isinstance(text, str) else text
        return self.entries.filter(filter_column(query))

    def rows(self, text: str, sort: str = "relevance", descending: bool | None = None, offset: int = 0, limit: int = PAGE) -> DataFrame:
        """A page of matching rows; Spark keeps only its rows while it sorts."""
        query = self.parse(text)
        down = sort in DESCENDING_FIRST if descending is None else descending
        return keyed(self.where(query), sort, query, self.weights).orderBy(*order(down)).offset(offset).limit(min(limit, PAGE_MOST)).drop(KEY)

    def after(self, text: str, last: dict, sort: str, descending: bool, limit: int = PAGE) -> DataFrame:
        """The page behind the row ``last``: a filter on the keys, which does not get slower as pages go on."""
        query = self.parse(text)
        value, key = last["relevance" if sort == "relevance" else COLUMNS[sort]], F.col(KEY)
        beyond = key < F.lit(value) if descending else key > F.lit(value)
        tied = (key == F.lit(value)) & ((F.col("mtime") < last["mtime"]) | ((F.col("mtime") == last["mtime"]) & (F.col("path") > last["path"])))
        return keyed(self.where(query), sort, query, self.weights).filter(beyond | tied).orderBy(*order(descending)).limit(min(limit, PAGE_MOST)).drop(KEY)

    def count(self, text: str, cap: int = COUNT_CAP) -> DataFrame:
        """One row ``(total, capped)``; counting stops at the cap."""
        some = self.where(text).select(F.lit(1).alias("x")).limit(cap)
        return some.agg(F.count("x").alias("total")).withColumn("capped", F.col("total") >= cap)

    def similar(self, text: str, cap: int = SIMILAR_CAP) -> DataFrame | None:
        """The count that a forgiving reading would have; None if it reads the same."""
        query = parser.parse(text, self.context, self.exact_accents)
        soft = query.forgiving()
        if soft == query:
            return None
        return self.where(soft).select(F.lit(1).alias("x")).limit(cap).agg(F.count("x").alias("total"))

    def search(self, text: str, sort: str = "relevance", descending: bool | None = None, offset: int = 0, limit: int = PAGE) -> Page:
        query = self.parse(text)
        return Page(self.rows(text, sort, descending, offset, limit), self.count(text), introspect.misread(text, self.context), introspect.describe(query))

    def stat(self, path: str, roots: tuple[str, ...] | None = None) -> DataFrame:
        """The entry at ``path``; with ``roots``, those of the sources, any other path is refused."""
        if roots is not None and not any(f"{path}/".startswith(f"{r.rstrip('/')}/") for r in roots):
            raise ValueError(f"{path} lies in no source")
        return self.entries.filter(F.col("path") == path)

    def explain(self, text: str) -> dict:
        """The query in words, whether it needs contents, and the roles of its runs."""
        query = self.parse(text)
        return {"sentence": introspect.describe(query), "needs_content": query.needs_content(), "spans": introspect.spans(text, self.context), "completions": introspect.complete(text, len(text))}

    def owner_of(self, roots: DataFrame, asked: DataFrame) -> DataFrame:
        """``(path, source)``: for each asked path the source of the longest of ``roots(source, root)`` that holds it.

        Each path is looked up by its ancestors, so the join is on equal strings.
        """
        whole = asked.select("path", F.explode(F.concat(paths.ancestors_of(F.col("path")), F.array("path"))).alias("root"))
        found = whole.join(roots, "root").groupBy("path").agg(F.max_by("source", F.char_length("root")).alias("source"))
        return asked.join(found, "path", "left")
