"""The parsed query: an AND of groups, each an OR of predicates that may be negated."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pathsonde.functions.text import mistakes_allowed

#: Comparisons and how they are written.
COMPARISONS = (">=", "<=", ">", "<", "=")


@dataclass(frozen=True)
class NameContains:
    text: str


@dataclass(frozen=True)
class NameGlob:
    pattern: str


@dataclass(frozen=True)
class PathContains:
    text: str


@dataclass(frozen=True)
class Under:
    folder: str


@dataclass(frozen=True)
class ParentIs:
    folder: str


@dataclass(frozen=True)
class Ext:
    extensions: tuple[str, ...]


@dataclass(frozen=True)
class IsDir:
    wanted: bool


@dataclass(frozen=True)
class Size:
    cmp: str
    value: int


@dataclass(frozen=True)
class Kind:
    kinds: tuple[str, ...]


@dataclass(frozen=True)
class Time:
    column: str  # mtime, ctime or atime
    cmp: str
    value: int


@dataclass(frozen=True)
class ContentContains:
    text: str


@dataclass(frozen=True)
class Depth:
    cmp: str
    value: int


@dataclass(frozen=True)
class Regex:
    pattern: str


@dataclass(frozen=True)
class NameLen:
    cmp: str
    value: int


@dataclass(frozen=True)
class NameContainsCased:
    text: str


@dataclass(frozen=True)
class NameNear:
    text: str
    edits: int


@dataclass(frozen=True)
class NameLetters:
    text: str


@dataclass(frozen=True)
class Num:
    column: str  # mode, uid, gid, items or disk
    cmp: str
    value: int


@dataclass(frozen=True)
class Bits:
    column: str
    mask: int
    want: int
    any: bool = False


Match = NameContains | NameGlob | PathContains | Under | ParentIs | Ext | IsDir | Size | Kind | Time | ContentContains | Depth | Regex | NameLen | NameContainsCased | NameNear | NameLetters | Num | Bits


@dataclass(frozen=True)
class Alt:
    match: Match
    negated: bool = False


@dataclass(frozen=True)
class Query:
    """``groups`` are joined by AND, the alternatives of each by OR; with ``exact_accents`` marks always count."""

    groups: tuple[tuple[Alt, ...], ...] = field(default=())
    exact_accents: bool = False

    def forgiving(self) -> Query:
        """Every plain word that is long enough becomes an approximate one."""

        def soften(a: Alt) -> Alt:
            if a.negated or not isinstance(a.match, NameContains) or not (n := mistakes_allowed(a.match.text)):
                return a
            return Alt(NameNear(a.match.text, n))

        return replace(self, groups=tuple(tuple(map(soften, g)) for g in self.groups))

    def needs_content(self) -> bool:
        return any(isinstance(a.match, ContentContains) for g in self.groups for a in g)

    def scored_terms(self) -> list[str]:
        """Name terms that stand alone in their group: what relevance and highlighting go by."""
        return [g[0].match.text for g in self.groups if len(g) == 1 and not g[0].negated and isinstance(g[0].match, NameContains)]

    def narrowing_terms(self, least: int) -> list[str]:
        """Those of at least ``least`` characters: what an index of letter groups could be asked for."""
        return [t for t in self.scored_terms() if len(t) >= least]

    def content_plan(self) -> tuple[Query, list[str]]:
        """The query without its content terms, and those terms; they must stand alone and not be negated."""
        needles, rest = [], []
        for g in self.groups:
            if not any(isinstance(a.match, ContentContains) for a in g):
                rest.append(g)
            elif len(g) == 1 and not g[0].negated:
                needles.append(g[0].match.text)
            else:
                raise ValueError("content: can be neither an alternative nor negated")
        return replace(self, groups=tuple(rest)), needles
