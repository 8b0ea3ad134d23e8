"""Numbers behind charts: shares that add up, tails folded, bars, arcs, cells and the age ribbon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BARS, SPAN_DAYS = 24, 730


def largest_remainder(values: DataFrame, whole: int, out: str, value: str = "value", idx: str = "idx", group: list[str] | None = None) -> DataFrame:
    """Add ``out``: integers that sum to ``whole`` in proportion to the values; the largest remainders get the units left over, earlier ones first.

    All zeros give zeros. ``group`` parts the rows into charts of their own.
    """
    all_of = Window.partitionBy(*(group or []))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    total = F.sum(wide(value)).over(all_of)
    v = values.withColumn("_t", total.cast("decimal(38,0)"))
    scaled = (wide(value) * F.lit(whole)).cast("decimal(38,0)")
    some = F.col("_t") > 0
    v = v.withColumn("_u", F.when(some, F.floor(scaled / F.col("_t"))).otherwise(0).cast("long"))
    v = v.withColumn("_r", F.when(some, scaled - F.col("_u") * F.col("_t")).otherwise(0))
    v = v.withColumn("_place", F.row_number().over(all_of.orderBy(F.desc("_r"), idx))).withColumn("_short", F.lit(whole) - F.sum("_u").over(all_of))
    return v.withColumn(out, F.when(some, F.col("_u") + (F.col("_place") <= F.col("_short")).cast("long")).otherwise(0).cast("long")).drop("_t", "_u", "_r", "_place", "_short")


def shares(values: DataFrame, decimals: int = 1) -> DataFrame:
    """Add ``share``: percentages that sum to exactly 100."""
    scale = 10**decimals
    return largest_remainder(values, 100 * scale, "share").withColumn("share", F.col("share") / scale)


def cells(values: DataFrame, width: int) -> DataFrame:
    """Add ``cells``: the cells of a bar of ``width`` that each value gets."""
    return largest_remainder(values, width, "cells")


def fold_rest(values: DataFrame, keep: int, value: str = "value", idx: str = "idx") -> DataFrame:
    """``(place, idx, count, value)``: the ``keep`` largest values (earlier ones first among equals), and the others as one row without an idx."""
    placed = values.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(F.desc(value), idx)))
    rest = F.col("place") > keep
    grouped = placed.groupBy(F.when(rest, keep + 1).otherwise(F.col("place")).alias("place"))
    return grouped.agg(F.max(F.when(~rest, F.col(idx))).alias("idx"), F.count(F.lit(1)).alias("count"), F.sum(value).alias("value"))


def segments(values: DataFrame, value: str = "value", idx: str = "idx", length: float = 1.0) -> DataFrame:
    """Add ``start`` and ``width``: where each value lies on a bar of ``length`` (360: a ring's arcs; a circumference: its dashes)."""
    all_of = Window.partitionBy()
    total = F.sum(value).over(all_of)
    before = F.coalesce(F.sum(value).over(all_of.orderBy(idx).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = lambda x: F.when(total == 0, 0.0).otherwise(x.cast("double") / total * length)
    return values.withColumn("start", part(before)).withColumn("width", part(F.col(value)))


def ribbon_edges(bars: int = BARS, span: int = SPAN_DAYS) -> list[int]:
    """Upper edges in days, newest first, on a logarithmic scale, so that the last day, week and year all have room."""
    return [max(1, int((10 ** ((k + 1) / bars) - 1) / 9 * span + 0.5)) for k in range(bars)]


def row_band(days: Column) -> Column:
    """Which of the six bands of a row's colour an age in days has."""
    out = F.lit(5)
    for k, edge in reversed(list(enumerate((1, 7, 30, 365, 730)))):
        out = F.when(days < edge, k).otherwise(out)
    return out
