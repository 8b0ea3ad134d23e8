"""Which paths an index leaves out, and sets of folders."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathsonde.functions import paths

#: Folders, folder names and file names that are left out by default on Linux.
DEFAULT_PATHS = ("/proc", "/sys", "/dev", "/run", "/tmp", "/var/lib/docker", "/var/cache")
DEFAULT_DIRS = (".git/objects", "target", "node_modules", ".cache", ".local/share/Trash", "__pycache__", ".venv", ".mypy_cache", ".pytest_cache", ".gradle", ".ccache", ".cargo/registry")
DEFAULT_FILES = (".DS_Store", "Thumbs.db", "desktop.ini")


def _any(columns: list[Column]) -> Column:
    return reduce(or_, columns, F.lit(False))


@dataclass(frozen=True)
class Rules:
    """Denied paths come first, then what is allowed, then excluded paths and names.

    A folder rule with a slash is a sequence of names. An absolute allow rule takes a subtree back in; a
    sequence takes back the folder and the files directly in it. Names are compared in lower case.
    """

    paths: tuple[str, ...] = DEFAULT_PATHS
    dirs: tuple[str, ...] = DEFAULT_DIRS
    files: tuple[str, ...] = DEFAULT_FILES
    allow: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()

    def _inside(self, path: Column, roots: tuple[str, ...]) -> Column:
        return _any([paths.under_or_self(path, r) for r in roots])

    def _holds(self, lower: Column, rules: tuple[str, ...]) -> Column:
        """Whether the path, with a slash behind, has a rule as whole parts."""
        return _any([lower.contains("/" + r.lower().strip("/") + "/") for r in rules])

    def allows(self, path: Column, is_dir: Column) -> Column:
        whole = tuple(a for a in self.allow if a.startswith("/"))
        parts = tuple(a for a in self.allow if not a.startswith("/"))
        home = F.when(is_dir, path).otherwise(paths.parent_of(path))
        return self._inside(path, whole) | _any([F.lower(home).endswith("/" + a.lower().strip("/")) for a in parts])

    def excludes(self, path: Column, is_dir: Column) -> Column:
        """Whether a walk leaves the entry out, be it by itself or with a folder above it."""
        name = F.lower(paths.name_of(path))
        folder = F.concat(F.lower(F.when(is_dir, path).otherwise(paths.parent_of(path))), F.lit("/"))
        by_file = ~is_dir & name.isin(*[f.lower() for f in self.files])
        out = self._inside(path, self.paths) | self._holds(folder, self.dirs) | by_file
        return self._inside(path, self.deny) | (~self.allows(path, is_dir) & out)

    def excludes_path(self, path: Column) -> Column:
        """The generous form that needs no ``is_dir``: what would stay as a file or as a folder of that name stays, unless it is denied."""
        as_any = [self.excludes(path, F.lit(d)) for d in (True, False)]
        allowed = [self.allows(path, F.lit(d)) for d in (True, False)]
        return self._inside(path, self.deny) | (_any(as_any) & ~_any(allowed))

    def may_contain_allowed(self, folder: str) -> bool:
        """Whether something below an excluded folder is allowed, so that a walk has to go on.

        That is so for the folders above an absolute rule, and for one whose last names begin a sequence.
        """
        here = f"{folder.rstrip('/')}/"
        sequences = [a.lower().strip("/").split("/") for a in self.allow if not a.startswith("/")]
        begun = tuple(f"/{'/'.join(names[:n])}/" for names in sequences for n in range(1, len(names) + 1))
        return f"/{here.lower()}".endswith(begun) or any(f"{a.rstrip('/')}/".startswith(here) for a in self.allow if a.startswith("/"))

    def leaves_out(self, path: str, is_dir: bool) -> bool:
        """``excludes`` of one path, for walks."""
        name, low = path.rsplit("/", 1)[-1].lower(), path.lower()
        home = low if is_dir else low.rsplit("/", 1)[0]
        inside = lambda roots: any(f"{path}/".startswith(f"{r.rstrip('/')}/") for r in roots)
        if inside(self.deny):
            return True
        if inside(a for a in self.allow if a.startswith("/")) or any(home.endswith("/" + a.lower().strip("/")) for a in self.allow if not a.startswith("/")):
            return False
        return inside(self.paths) or any(f"/{d.lower().strip('/')}/" in f"{home}/" for d in self.dirs) or (not is_dir and name in {f.lower() for f in self.files})


def apply_rules(entries: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """What stays, and the topmost of what goes."""
    gone = rules.excludes(F.col("path"), F.col("is_dir"))
    return entries.filter(~gone), reduce_prefixes(entries.filter(gone).select("path"))


def reduce_prefixes(prefixes: DataFrame) -> DataFrame:
    """Drop every ``path`` that lies under another one; by equal strings of ancestors, so that nothing is compared pairwise."""
    own = prefixes.select("path").distinct()
    above = own.select("path", F.explode(paths.ancestors_of(F.col("path"))).alias("prefix"))
    covered = above.join(own.select(F.col("path").alias("prefix")), "prefix", "left_semi").select("path")
    return own.join(covered, "path", "left_anti")


def covered(rows: DataFrame, prefixes: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows at or below one of the prefixes (left_semi), or the others (left_anti); prefixes with a source count for it alone."""
    ids = rows.select("source", "path").distinct()
    chain = F.explode(F.concat(paths.ancestors_of(F.col("path")), F.array("path")))
    hit = ids.select("source", "path", chain.alias("prefix")).join(prefixes.withColumnRenamed("path", "prefix"), [c for c in ("source", "prefix") if c == "prefix" or c in prefixes.columns], "left_semi")
    return rows.join(hit.select("source", "path").distinct(), ["source", "path"], how)
