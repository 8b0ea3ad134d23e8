"""Every predicate written the slow, direct way, for rows as dictionaries; what the compiled filters are tested against."""

from __future__ import annotations

import operator
import re

from pathsonde.functions import paths, text
from pathsonde.functions.kinds import NUMBER
from pathsonde.lang import ast

COMPARE = {">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt, "=": operator.eq}


def matches_one(e: dict, m: ast.Match, exact: bool) -> bool:
    cased, bare = text.fold(e["name"]), text.unaccent(e["name"])
    name = lambda t: cased if exact or text.is_marked(t) else bare
    match m:
        case ast.NameContains(t):
            return t in name(t)
        case ast.NameGlob(p):
            return text.glob_matches(p, name(p))
        case ast.PathContains(t):
            return t in (text.fold(e["path"]) if exact or text.is_marked(t) else text.unaccent(e["path"]))
        case ast.Under(d):
            return paths.is_under(e["path"], d)
        case ast.ParentIs(d):
            return paths.parent(e["path"]) == (d.rstrip("/") or "/")
        case ast.Ext(list_):
            return not e["is_dir"] and e["ext"] in [text.unaccent_folded(x) for x in list_]
        case ast.IsDir(wanted):
            return e["is_dir"] == wanted
        case ast.Kind(kinds):
            return e["kind"] in [NUMBER[k] for k in kinds]
        case ast.Time(col, "=", v):
            return v <= e[col] < v + 86_400
        case ast.Size(op, v):
            return COMPARE[op](e["size"], v)
        case ast.Time(col, op, v) | ast.Num(col, op, v):
            return COMPARE[op](e[col], v)
        case ast.Depth(op, v):
            return COMPARE[op](e["path"].count("/"), v)
        case ast.NameLen(op, v):
            return COMPARE[op](len(e["name"]), v)
        case ast.NameContainsCased(t):
            return t in e["name"]
        case ast.Regex(p):
            return re.search(p, name(p)) is not None
        case ast.NameNear(t, edits):
            return text.substring_distance(text.unaccent_folded(t), bare) <= edits
        case ast.NameLetters(t):
            return text.is_subsequence(text.unaccent_folded(t), bare)
        case ast.Bits(col, mask, want, any_):
            return bool(e[col] & mask) if any_ else e[col] & mask == want
    raise TypeError(m)


def matches(e: dict, query: ast.Query) -> bool:
    return all(any(matches_one(e, a.match, query.exact_accents) != a.negated for a in g) for g in query.groups)
