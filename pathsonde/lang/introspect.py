"""What a query says: in words, run by run, and how it could go on."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pathsonde.functions.kinds import KIND_WORDS
from pathsonde.functions.text import fold
from pathsonde.lang import ast, fields, parser

#: What columns are called in a sentence.
SUBJECTS = {"mode": "the mode", "uid": "the owner's number", "gid": "the group's number", "items": "the number of items in it", "disk": "the space on disk", "mtime": "the last change", "ctime": "the creation", "atime": "the last access"}
NODES = {0o100000: "regular file", 0o040000: "directory", 0o120000: "symbolic link", 0o140000: "socket", 0o010000: "named pipe", 0o060000: "block device", 0o020000: "character device"}
SINGLE_BITS = {0o4000: "set-user-id", 0o2000: "set-group-id", 0o1000: "sticky"}
RELATIONS = {">": "over", "<": "under", ">=": "at least", "<=": "at most", "=": "exactly"}
DAY_RELATIONS = {">": "after", "<": "before", ">=": "from", "<=": "up to", "=": "within"}


def human_size(n: int) -> str:
    """In binary units, with a decimal only where it says something."""
    value, unit = float(n), 0
    while abs(value) >= 1024 and unit < 4:
        value, unit = value / 1024, unit + 1
    shown = f"{value:.0f}" if value == int(value) else f"{value:.1f}"
    return f"{shown} {('B', 'KB', 'MB', 'GB', 'TB')[unit]}"


def _mode(m: ast.Bits) -> tuple[str, str, str]:
    if m.any:
        return "the mode", "shares a bit with", f"{m.mask:03o}"
    if m.mask == 0o170000:
        return "the entry", "is a", NODES.get(m.want, "node of another type")
    if m.mask == 0o7777:
        return "the mode", "equals", f"{m.want:03o}"
    return "the mode", "includes", SINGLE_BITS.get(m.mask, f"{m.mask:03o}")


def _quoted(text: str) -> str:
    return f"\u201c{text}\u201d"


def _day(seconds: int) -> str:
    return datetime.fromtimestamp(seconds, UTC).date().isoformat()


def _amount(subject: str, cmp: str, value: object) -> tuple[str, str, str]:
    return subject, f"is {RELATIONS[cmp]}", str(value)


#: Subject, verb and object of each predicate.
CLAUSES: dict[type, Callable[..., tuple[str, str, str]]] = {
    ast.NameContains: lambda m: ("the name", "holds", _quoted(m.text)),
    ast.NameContainsCased: lambda m: ("the name", "holds, letter case included,", _quoted(m.text)),
    ast.NameGlob: lambda m: ("the whole name", "fits", _quoted(m.pattern)),
    ast.NameNear: lambda m: ("the name", f"holds, with up to {m.edits} typing error{'s' * (m.edits > 1)},", _quoted(m.text)),
    ast.NameLetters: lambda m: ("the name", "spells, with gaps allowed,", _quoted(m.text)),
    ast.NameLen: lambda m: _amount("the name's length", m.cmp, m.value),
    ast.Regex: lambda m: ("the name", "fits the expression", m.pattern),
    ast.PathContains: lambda m: ("the path", "holds", _quoted(m.text)),
    ast.Under: lambda m: ("the path", "lies below", m.folder),
    ast.ParentIs: lambda m: ("the parent", "is", m.folder),
    ast.Depth: lambda m: _amount("the path's depth", m.cmp, m.value),
    ast.Ext: lambda m: ("the extension", "is", "/".join(m.extensions) or "none of any"),
    ast.IsDir: lambda m: ("the entry", "is a", "folder" if m.wanted else "file"),
    ast.Kind: lambda m: ("the kind", "is", "/".join(m.kinds)),
    ast.Size: lambda m: _amount("the size", m.cmp, human_size(m.value)),
    ast.Num: lambda m: _amount(SUBJECTS[m.column], m.cmp, m.value),
    ast.Bits: _mode,
    ast.Time: lambda m: (SUBJECTS[m.column], f"falls {DAY_RELATIONS[m.cmp]}", _day(m.value)),
    ast.ContentContains: lambda m: ("the content", "holds", _quoted(m.text)),
}


def describe_match(alt: ast.Alt) -> str:
    """A clause such as "the name holds ...", with "it is untrue that" before a negated one."""
    clause = " ".join(CLAUSES[type(alt.match)](alt.match))
    return f"it is untrue that {clause}" if alt.negated else clause


def describe(query: ast.Query) -> str:
    """The query in English: a clause for each predicate, alternatives joined by a comma and "or", groups by semicolons."""
    return "; ".join(", or ".join(map(describe_match, g)) for g in query.groups) or "any entry"


@dataclass(frozen=True)
class Span:
    """Bytes ``start`` to ``end`` of the text, their role, and whether the term is negated."""

    start: int
    end: int
    role: str
    negated: bool = False


def _usable(name: str, value: str, context: fields.Context) -> bool:
    """Whether a known field can read the value."""
    canonical, raw = fields.NAMES[name], value.replace('"', "")
    if canonical in fields.MACROS or canonical == "empty":
        return True
    if canonical in ("startwith", "endwith"):
        return bool(raw)
    low, dots, high = raw.partition("..")
    values = [v for v in (low, high) if v] if dots and fields.FIELDS[canonical][1] in ("size", "time") else [raw]
    reader = fields.READERS[canonical]
    return bool(values) and all(reader(v, fold(v), context) is not None for v in values)


def _term(term: str, negated: bool, context: fields.Context) -> list[tuple[str, str, bool]]:
    """Runs (text, role, negated) of one alternative."""
    out = []
    if term.startswith("!") and len(term) > 1:
        negated = True
        out.append(("!", "not", negated))
        term = term[1:]
    f = None if term.startswith('"') else parser.field_of(term)
    if f is None:
        for part in re.split('(")', term):
            if part:
                role = "quote" if part == '"' else "phrase" if term.startswith('"') else "glob" if "/" not in term and re.search(r"[*?]", term) else "text"
                out.append((part, role, negated))
        return out
    name, _, value = term.partition(":")
    if f[0] not in fields.NAMES:
        return [*out, (name, "unknown_field", negated), (":", "colon", negated), *([(value, "text", negated)] if value else [])]
    out += [(name, "field", negated), (":", "colon", negated)]
    good = _usable(f[0], value, context)
    takes = fields.FIELDS[fields.NAMES[f[0]]][1]
    if takes in ("size", "time"):
        cmp = next((c for c in ast.COMPARISONS if value.startswith(c)), "")
        if cmp:
            out.append((cmp, "cmp", negated))
            value = value[len(cmp) :]
    for part in re.split('("|;)' if takes == "ext" else '(")', value):
        if part:
            role = "quote" if part == '"' else "sep" if part == ";" and takes == "ext" else "value" if good else "bad_value"
            out.append((part, role, negated))
    return out


def spans(text: str, context: fields.Context) -> list[Span]:
    """Roles of byte ranges that cover the whole text."""
    runs: list[tuple[str, str, bool]] = []
    pieces, current, quoted = [], "", False
    for c in text:
        quoted ^= c == '"'
        if current and c.isspace() != current[-1].isspace() and not (quoted and c != '"') and not ('"' in current and current.count('"') % 2):
            pieces.append(current)
            current = ""
        current += c
    for piece in [*pieces, current]:
        if not piece:
            continue
        if piece.isspace():
            runs.append((piece, "space", False))
            continue
        literal = parser.is_literal(piece)
        for i, part in enumerate([piece] if literal else parser.cut_outside_quotes(piece, ";")):
            if i:
                runs.append((";", "space", False))
            for j, alt in enumerate(parser.cut_outside_quotes(part, "|")):
                if j:
                    runs.append(("|", "or", False))
                if alt == "!":
                    runs.append(("!", "not", True))
                elif alt:
                    for bang in [alt] if literal else parser.split_bangs(alt):
                        runs += _term(bang, False, context)
    out, at = [], 0
    for run, role, negated in runs:
        n = len(run.encode())
        out.append(Span(at, at + n, role, negated))
        at += n
    return out


def misread(text: str, context: fields.Context) -> list[Span]:
    """Runs that are searched for as text although they look like a filter."""
    return [s for s in spans(text, context) if s.role in ("unknown_field", "bad_value")]


#: Times that a completion offers.
TIMES = ("today", "yesterday", "7d", "30d", "week", "month", "year")


def complete(text: str, caret: int) -> list[str]:
    """How the word that ends at ``caret`` (in characters) can go on: fields, kinds or times."""
    word = re.split(r'[\s|;!]', text[:caret])[-1]
    if f := parser.field_of(word):
        canonical = fields.NAMES.get(f[0])
        takes = fields.FIELDS[canonical][1] if canonical else ""
        offered = [w.split()[0] for w in KIND_WORDS] if takes == "kind" else TIMES if takes == "time" else ()
        return [f"{word.partition(':')[0]}:{v}" for v in offered if v.startswith(fold(f[1]))]
    return [f"{n}:" for n in sorted(fields.FIELDS) if word and n.startswith(fold(word))]


def without(text: str, names: set[str], context: fields.Context) -> str | None:
    """The query without its usable terms on the fields ``names``; None if it has none."""
    kept, dropped = [], False
    for w in parser.words(text):
        f = None if w.startswith('"') else parser.field_of(parser._bare(w))
        if f and fields.NAMES.get(f[0]) in names and _usable(f[0], f[1], context):
            dropped = True
        else:
            kept.append(w)
    return " ".join(kept) if dropped else None


def with_term(text: str, term: str) -> str:
    """The query with ``term`` added, or without it if it is there already."""
    own = parser.words(text)
    return " ".join(w for w in own if w != term) if term in own else " ".join([*own, term])


def syntax() -> str:
    """A short reference of the language."""
    lines = [
        "word          the name contains it; a/b: the path does; a* b?: the whole name matches",
        '"two words"   a phrase, wildcards taken literally',
        "a b   a;b     both;   a|b  (a | b)  either;   !a  not",
    ]
    for name, (aliases, takes) in FIELDS_SHOWN.items():
        lines.append(f"{name + ':' + takes:<20}{'also ' + ', '.join(aliases) if aliases else ''}".rstrip())
    return "\n".join(lines)


FIELDS_SHOWN = {name: (aliases, {"": "", "ext": "a;b", "size": "[<>=]1mb", "time": "[<>=]7d | 2026-01-31", "kind": "word", "path": "/folder", "text": "text", "node": "f|d|l|s|p|b|c", "perm": "644 | -200 | /222", "owner": "name or id"}[takes]) for name, (aliases, takes) in fields.FIELDS.items()}
