"""Counts of matching rows by kind, extension, child folder and age, in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathsonde.functions.kinds import kind_token
from pathsonde.lang import introspect
from pathsonde.operators.search import Engine

SCAN_CAP, KINDS_SHOWN, DAY = 200_000, 16, 86_400


def child_of(folder: str) -> Column:
    """The first part below ``folder``; null for rows that are not below it."""
    base = folder.rstrip("/") + "/"
    rest = F.substr(F.col("path"), F.lit(len(base) + 1))
    return F.when(F.col("path").startswith(base) & (rest != ""), F.substring_index(rest, "/", 1))


def age_band(edges: list[int], now: int) -> Column:
    """The first edge that the age in whole days does not pass, or ``older``."""
    days = F.expr(f"greatest(0, {now} - mtime) div {DAY}")
    out = F.lit("older")
    for e in sorted(edges, reverse=True):
        out = F.when(days <= e, str(e)).otherwise(out)
    return out


def question(name: str, now: int) -> Column:
    """kind, ext, dir:FOLDER or age:1,7,30."""
    head, _, rest = name.partition(":")
    if head == "kind":
        return kind_token(F.col("kind"))
    if head == "ext":
        return F.when(F.col("ext") != "", F.col("ext"))
    if head == "dir":
        return child_of(rest)
    if head == "age":
        return age_band([int(x) for x in rest.split(",")], now)
    raise ValueError(name)


def facets(rows: DataFrame, questions: list[str], now: int, top: int = 20, cap: int | None = SCAN_CAP) -> DataFrame:
    """``(question, key, count)``: the ``top`` keys of each question, most rows first and then by key.

    All questions are answered from one pass, which counts before it shuffles. Only ``cap`` rows are
    looked at, unless an age is asked for or ``cap`` is None. All bands of an age are kept.
    """
    some = rows if cap is None or any(q.startswith("age:") for q in questions) else rows.limit(cap)
    pairs = F.array(*[F.struct(F.lit(q).alias("question"), question(q, now).alias("key")) for q in questions])
    each = some.select(F.explode(pairs).alias("p")).select("p.*").filter(F.col("key").isNotNull())
    counted = each.groupBy("question", "key").agg(F.count(F.lit(1)).alias("count"))
    ages = counted.filter(F.col("question").startswith("age:"))
    if all(q.startswith("age:") for q in questions):
        return ages
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("count"), "key"))
    ranked = counted.filter(~F.col("question").startswith("age:")).withColumn("place", place)
    ranked = ranked.filter(F.col("place") <= max(top, KINDS_SHOWN))  # a constant, so that each task ranks and cuts before the exchange
    ranked = ranked.filter(F.col("place") <= F.when(F.col("question") == "kind", KINDS_SHOWN).otherwise(top)).drop("place")
    return ranked.unionByName(ages) if any(q.startswith("age:") for q in questions) else ranked


def sideways(engine: Engine, text: str, edges: list[int]) -> DataFrame:
    """Kinds counted without the query's ``kind:`` terms, ages without its ``dm:`` terms."""
    def wider(fields: set[str]) -> str:
        short = introspect.without(text, fields, engine.context)
        return text if short is None else short

    kinds = facets(engine.where(wider({"kind"})), ["kind"], engine.context.now, cap=None)
    return kinds.unionByName(facets(engine.where(wider({"dm"})), ["age:" + ",".join(map(str, edges))], engine.context.now, cap=None))
