"""Query to a filter column over the derived entries."""

from __future__ import annotations

import operator
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pathsonde.functions import paths, text
from pathsonde.functions.kinds import NUMBER
from pathsonde.lang import ast

COMPARE = {">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt, "=": operator.eq}
DAY = 86_400


class ContentNotIndexed(ValueError):
    """The entries have no contents; ``operators.grep`` answers such queries."""


def _name(term: str, exact: bool) -> Column:
    """The name with its marks if marks count or the term carries one, else without."""
    return F.col("cased" if exact or text.is_marked(term) else "bare")


def _path(term: str, exact: bool) -> Column:
    folded = text.fold_column(F.col("path"))
    return folded if exact or text.is_marked(term) else text.unaccent_folded_column(folded)


def escape_like(s: str) -> str:
    return s.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def _glob(c: Column, pattern: str) -> Column:
    """LIKE, with the longest literal run beside it, which Parquet readers can be given."""
    whole = c.like(text.glob_to_like(pattern))
    run = max(re.split(r"[*?]", pattern), key=len)
    return whole & c.contains(run) if len(run) >= 3 else whole


def near_candidates(c: Column, term: str, edits: int) -> Column:
    """Names that share a piece of the term, as every match does: ``edits`` mistakes spoil at most two pieces each."""
    pieces = 2 * edits + 1
    size = len(term) // pieces
    if not size:
        return F.lit(True)
    return reduce(operator.or_, [c.contains(term[k * size : (k + 1) * size if k < pieces - 1 else None]) for k in range(pieces)])


def near(c: Column, term: str, edits: int) -> Column:
    """Whether some part of the name is within ``edits`` edits of the term.

    One edit is native: Levenshtein on all parts about as long, or a spelling with two neighbours swapped.
    Two need the alignment table, which runs in Arrow batches on names that pass ``near_candidates``.
    """
    if edits == 1:
        places = F.sequence(F.lit(1), F.greatest(F.char_length(c), F.lit(1)))
        close = [_close(c, places, term, m) for m in (len(term) - 1, len(term), len(term) + 1)]
        swapped = {term[:i] + term[i + 1] + term[i] + term[i + 2 :] for i in range(len(term) - 1)}
        return near_candidates(c, term, 1) & reduce(operator.or_, close + [c.contains(s) for s in sorted(swapped)])

    @F.pandas_udf("boolean")
    def aligned(names: pd.Series) -> pd.Series:
        distinct = sorted(names.dropna().unique(), key=len)
        known: dict = {}
        for k in range(0, len(distinct), 1024):
            some = distinct[k : k + 1024]
            known.update(zip(some, text.substring_distances(term, some) <= edits, strict=True))
        return names.map(known).fillna(False).astype(bool)

    possible = near_candidates(c, term, edits)
    return possible & aligned(F.when(possible, c).otherwise(""))


def _close(c: Column, places: Column, term: str, length: int) -> Column:
    return F.exists(places, lambda i: F.levenshtein(F.substr(c, i, F.lit(length)), F.lit(term)) <= 1)


def match_column(m: ast.Match, exact: bool = False) -> Column:
    c = F.col
    match m:
        case ast.NameContains(t):
            return _name(t, exact).contains(t)
        case ast.NameGlob(p):
            return _glob(_name(p, exact), p)
        case ast.PathContains(t):
            return _path(t, exact).contains(t)
        case ast.Under(d):
            return paths.under(c("path"), d)
        case ast.ParentIs(d):
            return c("parent") == (d.rstrip("/") or "/")
        case ast.Ext(list_):
            return c("ext").isin(*[text.unaccent_folded(e) for e in list_]) & ~c("is_dir") if list_ else F.lit(False)
        case ast.IsDir(wanted):
            return c("is_dir") if wanted else ~c("is_dir")
        case ast.Size(op, v):
            return COMPARE[op](c("size"), F.lit(v).cast("long"))
        case ast.Kind(kinds):
            return c("kind").isin(*[NUMBER[k] for k in kinds])
        case ast.Time(col, "=", v):
            return (c(col) >= F.lit(v)) & (c(col) < F.lit(v + DAY))
        case ast.Time(col, op, v) | ast.Num(col, op, v):
            return COMPARE[op](c(col), F.lit(v).cast("long"))
        case ast.Depth(op, v):
            return COMPARE[op](c("depth"), F.lit(v).cast("long"))
        case ast.NameLen(op, v):
            return COMPARE[op](F.char_length("name"), F.lit(v).cast("long"))
        case ast.NameContainsCased(t):
            return c("name").contains(t)
        case ast.Regex(p):
            return F.regexp_like(_name(p, exact), F.lit("(?U)" + p))
        case ast.NameNear(t, edits):
            plain = text.unaccent_folded(t)
            return near(c("bare"), plain, edits)
        case ast.NameLetters(t):
            return c("bare").like("%" + "".join(escape_like(x) + "%" for x in text.unaccent_folded(t)))
        case ast.Bits(col, mask, want, any_):
            got = c(col).bitwiseAND(F.lit(mask).cast("long"))
            return got != 0 if any_ else got == F.lit(want).cast("long")
        case ast.ContentContains():
            raise ContentNotIndexed("the entries hold no contents")
    raise TypeError(m)


def filter_column(query: ast.Query) -> Column:
    """AND over groups of OR over alternatives; an empty query is true of every row."""
    out = F.lit(True)
    for group in query.groups:
        alts = [~match_column(a.match, query.exact_accents) if a.negated else match_column(a.match, query.exact_accents) for a in group]
        out = out & reduce(operator.or_, alts)
    return out
