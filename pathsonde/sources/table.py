"""A table of entries kept as a base and batches of changes on top of it.

Applying a batch writes only the batch. Readers see the base with all complete batches applied, the
newest word on each path winning. When the batches have grown to a share of the base, or to a number
of segments, they are folded into a new base.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathsonde.operators.reconcile import apply_changes
from pathsonde.sources.entries import SCHEMA

#: Batches that may lie on a base, and how many times as many rows the base has to have as they.
SEGMENTS, RATIO = 8, 4
ENTRY = T.StructType(SCHEMA.fields[2:])
CHANGES = T.StructType([T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("source", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("entry", ENTRY)])


class VersionedTable:
    """Bases are folders ``v<revision>``, batches ``d<revision>``; success marks are the commits. All access goes through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _complete(self, letter: str) -> list[int]:
        fs = self._fs()
        if not fs.exists(self._path()):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self._path())]
        return sorted(int(n[1:]) for n in names if n[:1] == letter and n[1:].isdigit() and fs.exists(self._path(f"{n}/_SUCCESS")))

    def revisions(self) -> list[int]:
        return sorted({*self._complete("v"), *self._complete("d")})

    def revision(self) -> int:
        """Counts publishes and batches; readers compare it to see whether anything is new."""
        return max(self.revisions(), default=-1)

    def first_revision(self, checkpoint: str) -> int:
        """The revision of a stream's batch 0; settled when the stream first starts, as the name of a folder beside its checkpoint."""
        parent = self.spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}-first")
        fs = parent.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.exists(parent):
            (kept,) = (int(s.getPath().getName()) for s in fs.listStatus(parent))
            return kept
        fs.mkdirs(self.spark._jvm.org.apache.hadoop.fs.Path(parent, str(self.revision() + 1)))
        return self.revision() + 1

    def wait(self, revision: int, seconds: float, step: float = 0.05) -> bool:
        """Whether the table has reached ``revision``, waiting for it at most ``seconds``."""
        end = time.monotonic() + seconds
        while (reached := self.revision() >= revision) is False and time.monotonic() < end:
            time.sleep(step)
        return reached

    def _settle(self, df: DataFrame) -> DataFrame:
        """Write a small frame and read it again, so that the planner knows its size and joins it without moving the base."""
        at = f"{self.path}/_work/{uuid.uuid4().hex}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def layers(self, revision: int | None = None) -> tuple[int, list[int]]:
        """The base that a revision builds on (-1: none) and the batches over it."""
        at = self.revision() if revision is None else revision
        base = max((r for r in self._complete("v") if r <= at), default=-1)
        return base, [r for r in self._complete("d") if base < r <= at]

    def read(self, revision: int | None = None) -> DataFrame:
        base, batches = self.layers(revision)
        rows = self.spark.createDataFrame([], SCHEMA) if base < 0 else self.spark.read.schema(SCHEMA).parquet(f"{self.path}/v{base}")
        if not batches:
            return rows
        changes = self.spark.read.schema(CHANGES).parquet(*[f"{self.path}/d{r}" for r in batches])
        return apply_changes(rows, changes, self._settle)

    def publish(self, entries: DataFrame, revision: int | None = None) -> int:
        """Write a whole new base, in the order in which most queries return rows."""
        at = self.revision() + 1 if revision is None else revision
        rows = entries.select(*SCHEMA.fieldNames()).repartitionByRange(F.desc("mtime"), "path").sortWithinPartitions(F.desc("mtime"), "path")
        rows.write.mode("overwrite").parquet(f"{self.path}/v{at}")
        return at

    def append(self, changes: DataFrame, revision: int | None = None) -> int:
        """Write a batch of changes; the same revision again replaces it, so that a retried batch counts once."""
        at = self.revision() + 1 if revision is None else revision
        changes.select(*CHANGES.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/d{at}")
        return at

    def maintain(self, segments: int = SEGMENTS, ratio: int = RATIO) -> bool:
        """Fold the batches into a new base of the same revision if they have grown too many; says whether it did."""
        base, batches = self.layers()
        if not batches:
            return False
        count = lambda names: self.spark.read.parquet(*[f"{self.path}/{n}" for n in names]).count()
        if len(batches) <= segments and base >= 0 and count([f"d{r}" for r in batches]) * ratio <= count([f"v{base}"]):
            return False
        self.publish(self.read(), batches[-1])
        return True

    def stats(self) -> dict[str, int]:
        """Live entries and directories, rows of batches not yet folded, removals among them, and bytes of files."""
        base, batches = self.layers()
        live = self.read().agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("is_dir").cast("long")), F.lit(0))).first()
        ops = {}
        if batches:
            changes = self.spark.read.schema(CHANGES).parquet(*[f"{self.path}/d{r}" for r in batches])
            ops = {r[0]: r[1] for r in changes.groupBy("op").count().collect()}
        names = [f"v{base}"] * (base >= 0) + [f"d{r}" for r in batches]
        size = sum(self._fs().getContentSummary(self._path(n)).getLength() for n in names)
        return {"entries": live[0], "directories": live[1], "unsorted": ops.get("upsert", 0), "removals": ops.get("remove_subtree", 0), "bytes": size}

    def forget(self, source: int) -> int:
        """Drop the rows of a source."""
        return self.publish(self.read().filter(F.col("source") != source))

    def clear(self) -> int:
        """Drop all rows."""
        return self.publish(self.read().limit(0))

    def compact(self) -> None:
        """Fold all batches, then drop what no reader of the last revision needs."""
        self.maintain(segments=0)
        base, batches = self.layers()
        fs, keep = self._fs(), {f"v{base}", *(f"d{r}" for r in batches if r > base)}
        for s in fs.listStatus(self._path()):
            if s.getPath().getName() not in keep:
                fs.delete(s.getPath(), True)
