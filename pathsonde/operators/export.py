"""Matching rows as cells: what a table or a CSV file shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathsonde.functions.kinds import kind_token, mode_string

CELLS = ("name", "path", "full", "ext", "size", "disk", "mtime", "ctime", "atime", "kind", "perm", "user", "group", "items")
BOM = "﻿"


def stamp(c: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` in UTC; empty for times that are not known."""
    return F.when(c > 0, F.date_format(F.to_utc_timestamp(F.timestamp_seconds(c), F.current_timezone()), "yyyy-MM-dd HH:mm:ss")).otherwise("")


def with_owner_names(rows: DataFrame, users: DataFrame, groups: DataFrame) -> DataFrame:
    """Add user and group names from ``(id, name)`` tables; numbers where there is none."""
    u = users.select(F.col("id").alias("uid"), F.col("name").alias("user"))
    g = groups.select(F.col("id").alias("gid"), F.col("name").alias("group"))
    out = rows.join(u, "uid", "left").join(g, "gid", "left")
    return out.withColumn("user", F.coalesce("user", F.col("uid").cast("string"))).withColumn("group", F.coalesce("group", F.col("gid").cast("string")))


def cell(name: str, has_names: bool) -> Column:
    plain = {"path": F.col("parent"), "full": F.col("path"), "kind": kind_token(F.col("kind")), "perm": mode_string(F.col("is_dir"), F.col("mode"))}
    if name in ("mtime", "ctime", "atime"):
        return stamp(F.col(name))
    if name == "user":
        return F.col("user") if has_names else F.col("uid").cast("string")
    if name == "group":
        return F.col("group") if has_names else F.col("gid").cast("string")
    if name == "items":
        return F.when(F.col("items") >= 0, F.col("items").cast("string")).otherwise("")
    return plain.get(name, F.col(name).cast("string") if name in CELLS else F.lit(""))


def cells(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The asked columns as text, in their order; a column that is not known is empty."""
    named = {"user", "group"} <= set(rows.columns)
    return rows.select(*[F.coalesce(cell(c, named), F.lit("")).alias(c) for c in columns])


def _quoted(c: Column) -> Column:
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def write_csv(rows: DataFrame, columns: list[str], path: str) -> None:
    """RFC 4180 with CRLF, as text files; each has the header, behind a byte order mark, before its first row."""
    out = cells(rows, columns)
    header = BOM + ",".join(columns)
    line = F.concat_ws(",", *[_quoted(F.col(c)) for c in columns])
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    lines = out.select(F.when(first, F.concat(F.lit(header + "\r\n"), line)).otherwise(line).alias("line"))
    if lines.isEmpty():
        lines = rows.sparkSession.createDataFrame([(header,)], "line string")
    lines.write.option("lineSep", "\r\n").text(path)
