"""Folding of names: letter case, and letters without their marks; as Python, as Spark columns and as SQL."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of combining marks (and the tatweel) that an unmarked name is without.
MARKS = (
    (0x300, 0x36F), (0x483, 0x489), (0x591, 0x5BD), (0x5BF, 0x5BF), (0x5C1, 0x5C2), (0x5C4, 0x5C5), (0x5C7, 0x5C7), (0x610, 0x61A),
    (0x640, 0x640), (0x64B, 0x65F), (0x670, 0x670), (0x6D6, 0x6DC), (0x6DF, 0x6E4), (0x6E7, 0x6E8), (0x6EA, 0x6ED), (0x1AB0, 0x1ACE),
    (0x1DC0, 0x1DFF), (0x20D0, 0x20F0), (0xFE20, 0xFE2F),
)
#: Letters whose stroke or shape is no combining mark to Unicode.
STROKED = {"ø": "o", "đ": "d", "ł": "l", "ħ": "h", "ŧ": "t", "ð": "d", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe"}
#: Blocks of letters that may carry marks: Latin, Greek, Cyrillic.
LETTERS = (range(0xC0, 0x250), range(0x370, 0x530), range(0x1E00, 0x2000))
#: What lower case leaves apart although a fold does not.
FOLDED = str.maketrans({"ı": "i", "ς": "σ", "\u0307": None})
FULL_WIDTH = range(0xFF01, 0xFF5F)


@functools.lru_cache(maxsize=1)
def bases() -> dict[str, str]:
    """Lower-case letters and what they are without their marks, by canonical decomposition."""
    out = {}
    for block in LETTERS:
        for c in map(chr, block):
            base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
            if c == c.lower() and len(base) == 1 and base != c and base == base.lower():
                out[c] = base
    out |= STROKED
    return out | {chr(c): unicodedata.normalize("NFKC", chr(c)).lower() for c in FULL_WIDTH}


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[str, str, list[tuple[str, str]]]:
    one = {k: v for k, v in bases().items() if len(v) == 1}
    return "".join(one), "".join(one.values()), [(k, v) for k, v in bases().items() if len(v) > 1]


def is_mark(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in MARKS)


def fold(s: str) -> str:
    """Lower case by character, without the dot of a capital dotted I, with a dotless i dotted and one form of sigma."""
    return "".join(c.lower() for c in s).translate(FOLDED)


def unaccent_folded(s: str) -> str:
    known = bases()
    return "".join(known.get(c, c) for c in s if not is_mark(c))


def matches_at(s: str, term: str) -> list[tuple[int, int]]:
    """Where a folded term stands in ``s`` (start and end in characters of ``s``), marks counting only if the term has any.

    Each character is folded by itself, so a find reaches from the character of its first part to the one of its last.
    """
    plain = fold if is_marked(term) else unaccent
    parts = [(i, part) for i, c in enumerate(s) for part in plain(c)]
    whole, out, at = "".join(p for _, p in parts), [], 0
    while term and (at := whole.find(term, at)) >= 0:
        out.append((parts[at][0], parts[at + len(term) - 1][0] + 1))
        at += len(term)
    return out


def unaccent(s: str) -> str:
    return unaccent_folded(fold(s))


def is_marked(s: str) -> bool:
    """Whether a folded term carries a mark, and so asks for one."""
    return unaccent_folded(s) != s


def fold_column(c: Column) -> Column:
    return F.translate(F.lower(c), "ıς̇", "iσ")


def _mark_class(form: str) -> str:
    return "[" + "".join(form.format(a=a, b=b) for a, b in MARKS) + "]"


def unaccent_folded_column(c: Column) -> Column:
    source, target, pairs = _tables()
    out = F.translate(c, source, target)
    for k, v in pairs:
        out = F.replace(out, F.lit(k), F.lit(v))
    return F.regexp_replace(out, _mark_class(r"\x{{{a:x}}}-\x{{{b:x}}}"), "")


def unaccent_column(c: Column) -> Column:
    return unaccent_folded_column(fold_column(c))


def fold_sql(e: str) -> str:
    """The fold as DuckDB SQL."""
    return f"translate(lower({e}), 'ıς̇', 'iσ')"


def unaccent_folded_sql(e: str) -> str:
    source, target, pairs = _tables()
    quoted = lambda s: s.replace("'", "''")
    out = f"translate({e}, '{quoted(source)}', '{quoted(target)}')"
    for k, v in pairs:
        out = f"replace({out}, '{k}', '{v}')"
    return f"regexp_replace({out}, '{_mark_class('\\x{{{a:x}}}-\\x{{{b:x}}}')}', '', 'g')"


def mistakes_allowed(term: str) -> int:
    """Typing mistakes that a fuzzy term forgives, by its characters."""
    n = len(term)
    return 1 if 5 <= n <= 10 else 2 if 11 <= n <= 64 else 0


def substring_distance(term: str, name: str) -> int:
    """Least edits between ``term`` and any part of ``name``; a swap of neighbours is one (optimal string alignment)."""
    above, row = None, [0] * (len(name) + 1)
    for i, t in enumerate(term, 1):
        new = [i]
        for j, c in enumerate(name, 1):
            best = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (t != c))
            if above is not None and j > 1 and t == name[j - 2] and term[i - 2] == c:
                best = min(best, above[j - 2] + 1)
            new.append(best)
        above, row = row, new
    return min(row)


def substring_distances(term: str, names: list[str]) -> np.ndarray:
    """``substring_distance`` of many names at once; each step of the table is done for all of them."""
    sizes = np.array([len(n) for n in names], dtype=np.int64)
    width = int(sizes.max(initial=0))
    letters = np.zeros((len(names), width), dtype=np.uint32)
    letters[np.arange(width) < sizes[:, None]] = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    places = np.arange(width + 1)
    above, row = None, np.zeros((len(names), width + 1), dtype=np.int64)
    for i, t in enumerate(map(ord, term), 1):
        new = np.minimum(row + 1, i)
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (letters != t))
        new[:, 0] = i
        if above is not None:
            swapped = (letters[:, :-1] == t) & (letters[:, 1:] == ord(term[i - 2]))
            new[:, 2:] = np.where(swapped, np.minimum(new[:, 2:], above[:, :-2] + 1), new[:, 2:])
        above, row = row, np.minimum.accumulate(new - places, axis=1) + places  # letters of the name left over
    return np.where(places <= sizes[:, None], row, len(term)).min(axis=1)


def is_subsequence(letters: str, name: str) -> bool:
    rest = iter(name)
    return all(c in rest for c in letters)


def turkish_upper(c: Column) -> Column:
    """Upper case as Turkish writes it: i becomes a dotted capital."""
    return F.upper(F.replace(c, F.lit("i"), F.lit("İ")))


def glob_to_like(pattern: str) -> str:
    """A LIKE pattern, escaped by a backslash, for a glob of * and ?."""
    out = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return out.replace("*", "%").replace("?", "_")


def glob_matches(pattern: str, text: str) -> bool:
    """Whether the whole text matches; the plain check of what LIKE does."""
    import re

    return re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern), text, re.DOTALL) is not None
