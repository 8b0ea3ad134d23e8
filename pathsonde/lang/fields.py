"""The fields of the query language: names, what they take, and how values are read."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from dataclasses import dataclass

from pathsonde.functions.kinds import kind_words
from pathsonde.functions.text import mistakes_allowed
from pathsonde.lang import ast

DAY, HOUR = 86_400, 3_600
#: Named windows and the units of counted ones, in seconds.
WINDOWS = {w: n for words, n in (("today bugun bugün", DAY), ("yesterday dun dün", 2 * DAY), ("week thisweek hafta", 7 * DAY), ("month thismonth ay", 30 * DAY), ("year thisyear yil yıl", 365 * DAY)) for w in words.split()}
UNITS = {w: n for words, n in (("h s saat", HOUR), ("d g gun gün", DAY), ("w hafta", 7 * DAY), ("m ay", 30 * DAY), ("y yil yıl", 365 * DAY)) for w in words.split()}
SIZES = {"tb": 1 << 40, "gb": 1 << 30, "mb": 1 << 20, "kb": 1 << 10, "b": 1, "": 1}
#: Words of ``node:`` and the type bits they name.
NODES = {w: n for words, n in (("f file dosya", 0o100000), ("d dir folder klasor", 0o040000), ("l link symlink bag", 0o120000), ("s socket soket", 0o140000), ("p fifo pipe boru", 0o010000), ("b block blok", 0o060000), ("c char karakter", 0o020000)) for w in words.split()}

#: Each field with its other names and what its value is.
FIELDS = {
    "ext": ((), "ext"), "path": ((), "text"), "under": (("in", "altinda"), "path"), "parent": (("child", "children"), "path"), "file": (("files",), ""),
    "folder": (("folders", "dir"), ""), "size": ((), "size"), "kind": (("type", "tur", "tür"), "kind"), "dm": (("modified",), "time"), "dc": (("created",), "time"),
    "da": (("accessed",), "time"), "content": (("text", "icerik", "içerik"), "text"), "node": (("dugum",), "node"), "perm": (("mode", "izin"), "perm"),
    "suid": ((), ""), "sgid": ((), ""), "sticky": ((), ""), "ww": (("writable",), ""), "user": (("owner",), "owner"), "group": ((), "owner"),
    "depth": (("derinlik",), "size"), "regex": (("re",), "text"), "fuzzy": (("typo", "benzer"), "text"), "letters": (("harfler",), "text"), "empty": (("bos",), ""),
    "startwith": (("startswith", "prefix"), "text"), "endwith": (("endswith", "suffix"), "text"), "len": (("namelen",), "size"), "case": (("cased",), "text"),
    "audio": (("ses",), ""), "video": ((), ""), "pic": (("image", "gorsel"), ""), "doc": (("belge",), ""), "exe": ((), ""), "zip": (("archive", "arsiv"), ""),
}
NAMES = {alias: name for name, (aliases, _) in FIELDS.items() for alias in (name, *aliases)}
#: Fields that stand for ``kind:`` with a word.
MACROS = {"audio": "audio", "video": "video", "pic": "image", "doc": "doc", "exe": "exec", "zip": "archive"}


@dataclass(frozen=True)
class Context:
    """The clock of relative times, the folder that ``~`` stands for, and owners' ids by name."""

    now: int
    home: str | None = None
    users: tuple[tuple[str, int], ...] = ()
    groups: tuple[tuple[str, int], ...] = ()


def split_cmp(value: str) -> tuple[str, str]:
    """The comparison in front, ``>=`` where there is none, and the rest."""
    for c in ast.COMPARISONS:
        if value.startswith(c):
            return c, value[len(c) :]
    return ">=", value


def integer(s: str) -> int | None:
    s = s.strip()
    return int(s) if re.fullmatch(r"[+-]?[0-9]+", s) and -(1 << 63) <= int(s) < 1 << 63 else None


def size(value: str) -> tuple[str, int] | None:
    cmp, rest = split_cmp(value)
    rest = rest.strip()
    unit = next(u for u in SIZES if rest.endswith(u))
    number = rest[: len(rest) - len(unit)].strip()
    if not re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?", number):
        return None
    return cmp, max(-(1 << 63), min((1 << 63) - 1, int(float(number) * SIZES[unit])))


def window(value: str) -> int | None:
    if value in WINDOWS:
        return WINDOWS[value]
    m = re.fullmatch(r"([0-9]+)(\D.*)", value)
    return int(m[1]) * UNITS[m[2]] if m and m[2] in UNITS else None


def iso_day(value: str) -> int | None:
    """Epoch seconds of a day; days past a month's end run on into the next."""
    parts = [integer(x) for x in value.split("-")]
    if len(parts) != 3 or None in parts or not 1 <= parts[1] <= 12 or not 1 <= parts[2] <= 31 or not 1 <= parts[0] <= 9999:
        return None
    first = datetime.date(parts[0], parts[1], 1).toordinal() - datetime.date(1970, 1, 1).toordinal()
    return (first + parts[2] - 1) * DAY


def time(value: str, now: int) -> tuple[str, int] | None:
    """A bare window reaches back from now, a bare date is that day."""
    cmp, rest = split_cmp(value)
    rest, bare = rest.strip(), value[:1] not in ("<", ">", "=")
    if not rest:
        return None
    if (w := window(rest)) is not None:
        return (">=" if bare else cmp), now - w
    day = iso_day(rest)
    return None if day is None else (("=" if bare else cmp), day)


def permissions(value: str) -> ast.Bits | None:
    sign = value[:1] if value[:1] in ("-", "/", "+") else ""
    digits = value[len(sign) :]
    if not re.fullmatch(r"\+?[0-7]+", digits):
        return None
    n = int(digits, 8)
    return ast.Bits("mode", n, 0, True) if sign in ("/", "+") else ast.Bits("mode", n, n) if sign else ast.Bits("mode", 0o7777, n)


def folder(value: str, home: str | None) -> str:
    out = value.replace("\\", "/").rstrip("/")
    if not out:
        return "/"
    if home and out == "~":
        return home
    return home + out[1:] if home and out.startswith("~/") else out


def _owner(column: str, ids: tuple[tuple[str, int], ...], raw: str) -> ast.Num | None:
    name = raw.strip()
    n = integer(name) if name else None
    n = dict(ids).get(name) if n is None else n
    return None if n is None else ast.Num(column, "=", n)


def _compared(make: Callable, pair: tuple[str, int] | None):
    return make(*pair) if pair else None


def _depth(v: str) -> tuple[str, int] | None:
    cmp, rest = split_cmp(v)
    n = integer(rest)
    return None if n is None else (("=" if rest == v else cmp), n)


def _length(v: str) -> tuple[str, int] | None:
    cmp, rest = split_cmp(v)
    n = integer(rest)
    return None if n is None else (cmp, n)


def _fuzzy(v: str) -> ast.Match:
    return ast.NameNear(v, n) if (n := mistakes_allowed(v)) else ast.NameContains(v)


#: How each field reads its value, as typed (raw) and folded; None: it cannot.
READERS: dict[str, Callable[[str, str, Context], ast.Match | None]] = {
    "ext": lambda raw, v, c: ast.Ext(tuple(e for x in v.split(";") if (e := x.lstrip(".")))),
    "path": lambda raw, v, c: ast.PathContains(v),
    "under": lambda raw, v, c: ast.Under(folder(raw, c.home)) if raw else None,
    "parent": lambda raw, v, c: ast.ParentIs(folder(raw, c.home)) if raw else None,
    "file": lambda raw, v, c: ast.IsDir(False),
    "folder": lambda raw, v, c: ast.IsDir(True),
    "size": lambda raw, v, c: _compared(ast.Size, size(v)),
    "kind": lambda raw, v, c: ast.Kind(k) if (k := kind_words(v)) else None,
    "dm": lambda raw, v, c: _compared(lambda *p: ast.Time("mtime", *p), time(v, c.now)),
    "dc": lambda raw, v, c: _compared(lambda *p: ast.Time("ctime", *p), time(v, c.now)),
    "da": lambda raw, v, c: _compared(lambda *p: ast.Time("atime", *p), time(v, c.now)),
    "content": lambda raw, v, c: ast.ContentContains(v) if v else None,
    "node": lambda raw, v, c: ast.Bits("mode", 0o170000, NODES[v]) if v in NODES else None,
    "perm": lambda raw, v, c: permissions(v),
    "suid": lambda raw, v, c: ast.Bits("mode", 0o4000, 0o4000),
    "sgid": lambda raw, v, c: ast.Bits("mode", 0o2000, 0o2000),
    "sticky": lambda raw, v, c: ast.Bits("mode", 0o1000, 0o1000),
    "ww": lambda raw, v, c: ast.Bits("mode", 0o0002, 0, True),
    "user": lambda raw, v, c: _owner("uid", c.users, raw),
    "group": lambda raw, v, c: _owner("gid", c.groups, raw),
    "len": lambda raw, v, c: _compared(ast.NameLen, _length(v)),
    "depth": lambda raw, v, c: _compared(ast.Depth, _depth(v)),
    "fuzzy": lambda raw, v, c: _fuzzy(v) if v else None,
    "letters": lambda raw, v, c: ast.NameLetters(v) if v else None,
    "case": lambda raw, v, c: ast.NameContainsCased(raw) if raw else None,
    "regex": lambda raw, v, c: ast.Regex(v) if v else None,
}
