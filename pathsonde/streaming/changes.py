"""A feed of changes applied batch by batch, and rescans gathered before they run."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from pathsonde.functions.paths import reduce_prefixes
from pathsonde.sources.table import VersionedTable

#: Milliseconds without news after which gathered rescans run, and the longest that they wait.
QUIET_MS, CAP_MS = 500, 3_000


def translate_events(events: DataFrame) -> DataFrame:
    """Changes ``(seq, op, source, path, entry)`` for what a watcher reports: ``(seq, source, path, found, fresh, entry)``.

    ``found`` is what a look at the path gave: ``there`` is an upsert, and for a directory just made (``fresh``) a rescan of it
    too; ``missing`` removes the subtree; ``unclear`` asks for a rescan. ``overflow`` says that events were lost
    under ``path``, or anywhere where that is null, and asks for a rescan of it, or of everything.
    """
    op = F.when(F.col("found") == "missing", F.array(F.lit("remove_subtree"))).when(F.col("found") != "there", F.array(F.lit("rescan")))
    ops = op.when(F.col("fresh"), F.array(F.lit("upsert"), F.lit("rescan"))).otherwise(F.array(F.lit("upsert")))
    each = events.select("seq", F.explode(ops).alias("op"), "source", F.coalesce("path", F.lit("")).alias("path"), "entry")
    return each.withColumn("entry", F.when(F.col("op") == "upsert", F.col("entry")))


def apply_stream(changes: DataFrame, table: VersionedTable, checkpoint: str, **trigger):
    """Start a query that appends each micro-batch of ``changes(seq, op, source, path, entry)`` to the table, and folds batches as they grow.

    A batch that is run again, by a query started again too, writes the same revision, so each change counts once:
    the first revision is kept beside the checkpoint.
    """
    first = table.first_revision(checkpoint)

    def apply(batch: DataFrame, batch_id: int) -> None:
        table.append(batch, first + batch_id)
        table.maintain()

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def debounce(rescans: DataFrame, quiet_ms: int = QUIET_MS, cap_ms: int = CAP_MS) -> DataFrame:
    """``(source, burst, run_at, paths)`` for ``(source, at_ms, path)``: requests gathered until a quiet spell or the cap.

    A burst's cap splits it into slices of ``cap_ms`` from its start. Paths under another one of the slice are
    dropped, and the empty path, which asks for everything, stands for all; it runs without waiting.
    """
    w = Window.partitionBy("source").orderBy("at_ms", "path")
    gap = F.col("at_ms") - F.lag("at_ms").over(w) > quiet_ms
    bursts = rescans.withColumn("burst", F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(w))
    begin = F.min("at_ms").over(Window.partitionBy("source", "burst"))
    sliced = bursts.withColumn("slice", F.floor((F.col("at_ms") - begin) / cap_ms)).withColumn("begin", begin)
    grouped = sliced.groupBy("source", "burst", "slice").agg(F.collect_set("path").alias("all"), F.max("at_ms").alias("last"), F.min("begin").alias("begin"))
    inside = lambda p: F.exists("all", lambda o: p.startswith(F.concat(o, F.lit("/"))))
    kept = F.when(F.array_contains("all", ""), F.array(F.lit(""))).otherwise(F.array_sort(F.filter("all", lambda p: ~inside(p))))
    due = F.least(F.col("last") + quiet_ms, F.col("begin") + (F.col("slice") + 1) * cap_ms)
    run_at = F.when(F.array_contains("all", ""), F.col("last")).otherwise(due).cast("long")
    return grouped.select("source", "burst", run_at.alias("run_at"), kept.alias("paths"))


def _gather(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: when the first waiting request came, and the paths so far."""
    now = state.getCurrentProcessingTimeMs()
    since, waiting = state.get if state.exists else (now, [])
    new = [p for b in batches for p in b["path"]]
    waiting = reduce_prefixes([*waiting, *new])
    if waiting and (state.hasTimedOut or "" in waiting or now - since >= CAP_MS):
        if state.exists:
            state.remove()
        yield pd.DataFrame({"source": [key[0]], "run_at": [now], "paths": [waiting]})
    elif waiting:
        state.update((since, waiting))
        state.setTimeoutDuration(max(1, min(QUIET_MS, since + CAP_MS - now)))


def debounce_stream(rescans: DataFrame) -> DataFrame:
    """The same on a stream ``(source, path)``, by the clock: quiet spells and the cap are timers of the state."""
    return rescans.groupBy("source").applyInPandasWithState(
        _gather, "source int, run_at long, paths array<string>", "since long, waiting array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )
