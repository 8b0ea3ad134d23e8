"""Bringing the table in line with a snapshot or a batch of changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathsonde.functions import paths
from pathsonde.operators.rules import covered
from pathsonde.sources.entries import SCHEMA

KEY = ["source", "path"]
#: Columns that tell a changed row; access time, disk, links and entries inside do not.
TELLING = ("is_dir", "size", "mtime", "ctime", "mode", "uid", "gid")


def classify(table: DataFrame, snapshot: DataFrame, roots: list[str] | None = None, blind: list[str] | None = None) -> DataFrame:
    """``(source, path, state)``: new, changed, unchanged or gone, or spared where a missing row may still exist.

    Only rows under vouched ``roots`` (all if None) can be gone, and none under a ``blind`` folder. A source
    without any row in the snapshot loses nothing.
    """
    own = table.select(*KEY, F.struct(*TELLING).alias("old"))
    new = snapshot.select(*KEY, F.struct(*TELLING).alias("new"))
    both = own.join(new, KEY, "full_outer")
    in_roots = F.lit(roots is None)
    for r in roots or []:
        in_roots = in_roots | paths.under_or_self(F.col("path"), r)
    unseen = F.lit(False)
    for b in blind or []:
        unseen = unseen | paths.under_or_self(F.col("path"), b)
    walked = snapshot.select("source").distinct().withColumn("walked", F.lit(True))
    state = F.when(F.col("old").isNull(), "new").when(F.col("new").isNotNull() & (F.col("old") == F.col("new")), "unchanged").when(F.col("new").isNotNull(), "changed")
    gone = F.when(in_roots & ~unseen & F.coalesce("walked", F.lit(False)), "gone").otherwise("spared")
    return both.join(walked, "source", "left").select(*KEY, state.otherwise(gone).alias("state"))


def reconcile(table: DataFrame, snapshot: DataFrame, roots: list[str] | None = None, blind: list[str] | None = None) -> DataFrame:
    """The table after a walk: rows of the snapshot, and what the walk could not vouch for."""
    kept = classify(table, snapshot, roots, blind)
    stay = table.join(kept.filter("state in ('unchanged', 'spared')"), KEY, "left_semi")
    come = snapshot.join(kept.filter("state in ('new', 'changed')"), KEY, "left_semi")
    return stay.unionByName(come.select(*stay.columns))


def latest(changes: DataFrame) -> DataFrame:
    """The last upsert of each path that no later removal of it or of a folder above undoes.

    ``changes(seq, op, source, path, entry)``; op is upsert, remove_subtree or rescan.
    """
    ups = changes.filter("op = 'upsert'").groupBy(*KEY).agg(F.max(F.struct("seq", "entry")).alias("last")).select(*KEY, "last.seq", "last.entry")
    gone = changes.filter("op = 'remove_subtree'").groupBy("source", F.col("path").alias("prefix")).agg(F.max("seq").alias("removed"))
    chain = ups.select(*KEY, "seq", F.explode(F.concat(paths.ancestors_of(F.col("path")), F.array("path"))).alias("prefix"))
    undone = chain.join(gone, ["source", "prefix"]).filter("removed > seq").select(*KEY).distinct()
    return ups.join(undone, KEY, "left_anti")


def apply_changes(table: DataFrame, changes: DataFrame, settle: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """The table after a batch of changes: removed subtrees go, upserts replace or add rows; one is revived only by its own upsert.

    ``settle`` may write a frame and read it again: then prefixes and keys have a known size, and small ones are
    joined to the table where it lies. Only folders above its rows are compared with removed prefixes.
    """
    columns = SCHEMA.fieldNames()
    ups = settle(latest(changes))
    fresh = ups.select(*[F.col(c) if c in KEY else F.col(f"entry.{c}").alias(c) for c in columns])
    removed = settle(changes.filter("op = 'remove_subtree'").select("source", F.col("path").alias("prefix")).distinct())
    chain = table.select(*KEY, F.explode(F.concat(paths.ancestors_of(F.col("path")), F.array("path"))).alias("prefix"))
    hit = chain.join(removed, ["source", "prefix"], "left_semi").select(*KEY)
    gone = settle(hit.unionByName(ups.select(*KEY)).distinct())
    return table.select(*columns).join(gone, KEY, "left_anti").select(*columns).unionByName(fresh)


def apply_report(table: DataFrame, changes: DataFrame) -> DataFrame:
    """One row of counters: upserted, unchanged, subtrees_removed, rows_removed."""
    ups = latest(changes).select(*KEY, F.struct(*[F.col(f"entry.{c}").alias(c) for c in TELLING]).alias("new"))
    same = ups.join(table.select(*KEY, F.struct(*TELLING).alias("old")), KEY).filter("old = new")
    subtrees = changes.filter("op = 'remove_subtree'").select("source", "path").distinct()
    removed = covered(table.select(*KEY), subtrees)
    count = lambda d, n: d.agg(F.count(F.lit(1)).alias(n))
    return count(ups, "upserted").crossJoin(count(same, "unchanged")).crossJoin(count(subtrees, "subtrees_removed")).crossJoin(count(removed, "rows_removed"))  # one row each


def forget(table: DataFrame, source: int) -> DataFrame:
    return table.filter(F.col("source") != source)


def index_stats(table: DataFrame) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(F.col("is_dir").cast("long")), F.lit(0)).alias("directories"))
