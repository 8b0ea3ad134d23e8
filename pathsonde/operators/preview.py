"""What a preview of a file would show: a shape by its kind, or the head of its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathsonde.functions.kinds import NUMBER
from pathsonde.operators.content import is_binary

HEAD = 8192


def shape(kind: Column, ext: Column, content: Column) -> Column:
    """pdf, image, audio or video by extension and kind; else text or binary by the first bytes, and empty."""
    by_kind = F.when(ext == "pdf", "pdf")
    for name in ("image", "audio", "video"):
        by_kind = by_kind.when(kind == NUMBER[name], name)
    return by_kind.when(F.octet_length(content) == 0, "empty").when(is_binary(content), "binary").otherwise("text")


def preview(rows: DataFrame, contents: DataFrame, lines: int = 40) -> DataFrame:
    """``(source, path, shape, head)``: the first lines of what is text, from its first HEAD characters."""
    both = rows.filter(~F.col("is_dir")).join(contents, ["source", "path"])
    own = both.withColumn("shape", shape(F.col("kind"), F.col("ext"), F.col("content")))
    head = F.array_join(F.slice(F.split(F.substring("content", 1, HEAD), "\n", -1), 1, lines), "\n")
    return own.select("source", "path", "shape", F.when(F.col("shape") == "text", head).alias("head"))
