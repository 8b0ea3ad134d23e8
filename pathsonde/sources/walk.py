"""A batch source that walks folders: ``spark.read.format("filetree")``."""

from __future__ import annotations

import json
import os
import stat
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from pathsonde.operators.rules import Rules
from pathsonde.sources.entries import META, SCHEMA


def visible(path: str) -> str:
    """The path as text; a byte that is no UTF-8 becomes the private character U+F700 plus the byte."""
    return "".join(chr(0xF700 + ord(c) - 0xDC00) if "\udc80" <= c <= "\udcff" else c for c in path)


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool) -> None:
        self.path, self.deep = path, deep


class FileTree(DataSource):
    """Options: ``path`` (a root, or several separated by ``|``), ``source`` (its number), ``hidden``, ``follow``, ``metadata`` (true or false), ``exclude`` (names separated by ``|``), ``rules`` (a JSON object with fields of ``Rules``).

    A folder that the rules leave out is not read, unless something below it may be allowed. With ``follow``, a
    folder is not entered from below itself.
    """

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options)


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.roots = [r.rstrip("/") or "/" for r in options["path"].split("|")]
        flag = lambda n, default: options.get(n, default).lower() == "true"
        self.hidden, self.follow, self.metadata = flag("hidden", "true"), flag("follow", "false"), flag("metadata", "true")
        self.number, self.excluded = int(options.get("source", "0")), set(filter(None, options.get("exclude", "").split("|")))
        self.rules = Rules(**{k: tuple(v) for k, v in json.loads(options["rules"]).items()}) if "rules" in options else None

    def partitions(self) -> list[InputPartition]:
        """A task for each folder directly in a root, and one for the root itself."""
        out: list[InputPartition] = []
        for root in self.roots:
            out.append(Folder(root, False))
            out += [Folder(e.path, True) for e in self._list(root) if e.is_dir(follow_symlinks=self.follow) and self._enters(e.path)]
        return out

    def _list(self, folder: str) -> list[os.DirEntry]:
        try:
            with os.scandir(folder) as it:
                return sorted((e for e in it if e.name not in self.excluded and (self.hidden or not e.name.startswith("."))), key=lambda e: e.name)
        except OSError:  # gone or closed to us: nothing to list
            return []

    def _left_out(self, path: str, is_dir: bool) -> bool:
        return self.rules is not None and self.rules.leaves_out(path, is_dir)

    def _enters(self, folder: str) -> bool:
        return not self._left_out(folder, True) or self.rules.may_contain_allowed(folder)

    @staticmethod
    def _identity(folder: str) -> tuple[int, int] | None:
        try:
            s = os.stat(folder)
        except OSError:
            return None
        return s.st_dev, s.st_ino

    def _row(self, path: str, is_dir: bool) -> tuple | None:
        if self._left_out(path, is_dir):
            return None
        shown = visible(path)
        if not self.metadata:
            return (self.number, shown, is_dir, *(-1 if c == "items" else 1 if c == "links" else 0 for c in META))
        try:
            s = os.stat(path, follow_symlinks=self.follow)
        except OSError:
            return None
        is_dir = stat.S_ISDIR(s.st_mode)
        size = 0 if is_dir else s.st_size
        return (self.number, shown, is_dir, size, int(s.st_mtime), int(s.st_ctime), int(s.st_atime), s.st_mode, s.st_uid, s.st_gid, getattr(s, "st_blocks", 0) * 512, -1, max(1, s.st_nlink))

    def read(self, partition: Folder) -> Iterator[tuple]:
        if not partition.deep:
            if row := self._row(partition.path, True):
                yield row
            yield from (r for e in self._list(partition.path) if not e.is_dir(follow_symlinks=self.follow) and (r := self._row(e.path, False)))
            return
        above = {self._identity(os.path.dirname(partition.path))} if self.follow else set()
        todo = [(partition.path, above)]
        while todo:
            folder, above = todo.pop()
            if self.follow:
                own = self._identity(folder)
                if own in above:
                    continue
                above = above | {own}
            if row := self._row(folder, True):
                yield row
            for e in self._list(folder):
                if e.is_dir(follow_symlinks=self.follow):
                    if self._enters(e.path):
                        todo.append((e.path, above))
                elif row := self._row(e.path, False):
                    yield row
