"""Parts of ``/``-separated paths as columns and as Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_of(path: Column) -> Column:
    """The text before the last slash: ``/`` at the root, empty where there is none."""
    cut = F.char_length(path) - F.char_length(name_of(path)) - 1
    return F.when(cut < 0, "").when(cut == 0, "/").otherwise(F.substr(path, F.lit(1), cut))


def depth_of(path: Column) -> Column:
    return (F.char_length(path) - F.char_length(F.replace(path, F.lit("/"), F.lit("")))).cast("long")


def ancestors_of(path: Column) -> Column:
    """Directories above a path, the topmost first; the path itself and the root are not among them."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n > 2, F.transform(F.sequence(F.lit(2), n - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.expr("cast(array() as array<string>)"))


def parent(path: str) -> str:
    head, slash, _ = path.rpartition("/")
    return head or ("/" if slash else "")


def is_under(path: str, folder: str) -> bool:
    """Strictly below ``folder``, at a component's edge."""
    folder = folder.rstrip("/")
    return path.startswith(folder + "/") and len(path) > len(folder) + 1


def under(path: Column, folder: str) -> Column:
    folder = folder.rstrip("/")
    return path.startswith(folder + "/") & (F.char_length(path) > len(folder) + 1) if folder else (F.char_length(path) > 0)


def under_or_self(path: Column, folder: str) -> Column:
    folder = folder.rstrip("/")
    return (path == folder) | path.startswith(folder + "/") if folder else F.lit(True)


def reduce_prefixes(paths: list[str]) -> list[str]:
    """Drop every path that lies under another one."""
    out: list[str] = []
    for p in sorted(set(paths), key=lambda x: (x.count("/"), x)):
        if not any(p == o or is_under(p, o) or o == "" for o in out):
            out.append(p)
    return sorted(out)
