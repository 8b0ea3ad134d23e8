"""What folders hold: bytes, disk and files rolled up the tree, by age too; listings and sizes of folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathsonde.functions import paths

TOP, TREE_ROWS, DAY = 20, 200, 86_400
#: Upper ends, in days, of the bands by which bytes are split; a sixth band is open.
BANDS = (1, 7, 30, 180, 365)


def charged(rows: DataFrame, now: int) -> DataFrame:
    """Files with their share of bytes and disk: a hard link counts for its part, rounded down."""
    share = lambda c: F.expr(f"{c} div greatest(links, 1)")
    days = (F.lit(now) - F.col("mtime")) / DAY
    band = F.lit(len(BANDS))
    for k in reversed(range(len(BANDS))):
        band = F.when(days < BANDS[k], k).otherwise(band)
    return rows.filter(~F.col("is_dir")).select("path", "parent", share("size").alias("bytes"), share("disk").alias("disk"), band.alias("band"))


def _totals() -> list[Column]:
    ages = [F.sum(F.when(F.col("band") == k, F.col("bytes")).otherwise(0)) for k in range(len(BANDS) + 1)]
    return [F.sum("bytes").alias("bytes"), F.sum("disk").alias("disk"), F.count(F.lit(1)).alias("files"), F.array(*ages).alias("age")]


def own_totals(rows: DataFrame, now: int) -> DataFrame:
    """Per folder: the files directly in it. Summed first, so that what is rolled up is folders, not files."""
    return charged(rows, now).groupBy("parent").agg(*_totals())


def subtree_sizes(rows: DataFrame, now: int) -> DataFrame:
    """``(path, bytes, disk, files, age)`` of every folder above a file, all that lies below it counted."""
    own = own_totals(rows, now)
    above = F.explode(F.concat(paths.ancestors_of(F.col("parent")), F.array("parent")))
    sums = [F.sum(c).alias(c) for c in ("bytes", "disk", "files")]
    ages = F.array(*[F.sum(F.get("age", F.lit(k))) for k in range(len(BANDS) + 1)]).alias("age")
    return own.select(above.alias("path"), "bytes", "disk", "files", "age").filter("path <> '' and path <> '/'").groupBy("path").agg(*sums, ages)


def usage_children(rows: DataFrame, scope: str, now: int, top: int = TOP) -> DataFrame:
    """The folders directly in ``scope``, heaviest first: ``(path, bytes, disk, files, age, child_count)``.

    ``rows`` are the matching entries; child_count is before the cut. An empty scope (or ``/``) lists the topmost folders.
    """
    scope = scope.rstrip("/")
    inside = rows.filter(paths.under(F.col("path"), scope)) if scope else rows
    rest = F.substr(F.col("parent"), F.lit(len(scope) + 2))
    first = F.concat(F.lit(scope + "/"), F.substring_index(rest, "/", 1))
    below = charged(inside, now).filter(F.col("parent").startswith(scope + "/") & (rest != "")).withColumn("child", first)
    grouped = below.groupBy("child").agg(*_totals()).withColumnRenamed("child", "path")
    counted = grouped.crossJoin(F.broadcast(grouped.agg(F.count(F.lit(1)).alias("child_count"))))  # one row
    return counted.orderBy(F.desc("bytes"), "path").limit(max(top, 1))


def usage_root(rows: DataFrame, scope: str, now: int) -> DataFrame:
    """One row with the totals of ``scope``; the empty path stands for everything."""
    scope = scope.rstrip("/")
    inside = rows.filter(paths.under(F.col("path"), scope)) if scope else rows
    zero = [F.coalesce(c, F.lit(0)).alias(n) for c, n in zip((F.sum("bytes"), F.sum("disk")), ("bytes", "disk"), strict=True)]
    ages = [F.coalesce(F.sum(F.when(F.col("band") == k, F.col("bytes")).otherwise(0)), F.lit(0)) for k in range(len(BANDS) + 1)]
    return charged(inside, now).agg(*zero, F.count(F.lit(1)).alias("files"), F.array(*ages).alias("age")).select(F.lit(scope).alias("path"), "bytes", "disk", "files", "age")


def children_count(rows: DataFrame) -> DataFrame:
    return rows.groupBy("parent").agg(F.count(F.lit(1)).alias("children"))


def with_folder_weight(page: DataFrame, rows: DataFrame, now: int) -> DataFrame:
    """Add ``under`` (disk, files) to the folders of a page; null for files."""
    sizes = subtree_sizes(rows, now).select("path", F.struct("disk", "files").alias("weight"))
    empty = F.struct(F.lit(0).cast("long").alias("disk"), F.lit(0).cast("long").alias("files"))
    out = page.join(sizes, "path", "left").withColumn("under", F.when(F.col("is_dir"), F.coalesce("weight", empty)))
    return out.drop("weight")


def tree(rows: DataFrame, folder: str, depth: int = 1, limit: int = TREE_ROWS, dirs_only: bool = False) -> DataFrame:
    """``(path, level, is_dir, size, mtime, children, truncated)`` of what lies up to ``depth`` below ``folder``.

    Of each folder the first ``limit`` names are listed, by name without marks, folders before files
    among them; what lies under a folder that was cut off is not listed. Entries are read three times, however deep the listing goes.
    """
    folder = folder.rstrip("/")
    base = folder.count("/")
    inside = rows.filter(paths.under(F.col("path"), folder) & (F.col("depth") <= base + depth))
    if dirs_only:
        inside = inside.filter("is_dir")
    w = Window.partitionBy("parent").orderBy("bare", "path")
    placed = inside.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)
    shown = placed.select("path", "parent", "bare", "is_dir", "size", "mtime", (F.col("depth") - base).cast("int").alias("level"))
    listed = shown
    if depth > 1:
        between = F.filter(paths.ancestors_of(F.col("path")), lambda a: a.startswith(folder + "/") & (a != "/"))
        kept = shown.filter("is_dir").select(F.col("path").alias("above"), F.lit(1).alias("kept"))
        each = shown.withColumn("above", F.explode_outer(between)).join(kept, "above", "left")
        listed = each.groupBy(*shown.columns).agg(F.count("kept").alias("kept")).filter(F.col("kept") == F.col("level") - 1).drop("kept")
    inner = rows.filter(paths.under(F.col("path"), folder) & F.col("depth").between(base + 2, base + depth + 1))
    counts = children_count(inner.filter("is_dir") if dirs_only else inner).withColumnRenamed("parent", "path")
    out = listed.join(counts, "path", "left").withColumn("children", F.when(F.col("is_dir"), F.coalesce("children", F.lit(0))))
    return out.withColumn("truncated", F.coalesce(F.col("children") > limit, F.lit(False))).orderBy("level", "parent", F.desc("is_dir"), "bare", "path").drop("bare")
