"""The ``entries`` relation: one row per path, its metadata, and columns derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathsonde.functions import kinds, paths, text

#: The stored columns; (source, path) is the key. Sentinels stand for what is unknown, so there are no nulls.
SCHEMA = T.StructType(
    [T.StructField("source", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("is_dir", T.BooleanType())]
    + [T.StructField(n, T.LongType()) for n in ("size", "mtime", "ctime", "atime", "mode", "uid", "gid", "disk", "items", "links")]
)
#: Columns that a segment keeps beside them, so that filters on names, kinds and folders reach the files.
DERIVED = T.StructType([T.StructField(n, T.IntegerType() if n == "kind" else T.LongType() if n == "depth" else T.StringType()) for n in ("name", "parent", "cased", "bare", "ext", "kind", "depth")])
META = [f.name for f in SCHEMA.fields[3:]]
FORMAT_VERSION = 2
#: The clock of relative times in queries over the sample tables.
NOW = 1_785_000_000

SAMPLE_EXTENSIONS = ("pdf", "rs", "JPG", "tar.gz", "", "mp3", "PY", "docx", "mp4", "json", "so", "ttf", "zip", "bin", "html", "averylongextension", "yml", "d.html")
SAMPLE_MODES = (0o100644, 0o100755, 0o104755, 0o100666, 0o120777)


def derive(entries: DataFrame) -> DataFrame:
    """Add name, parent, ext, kind, depth, ``cased`` and ``bare`` (the folded name with and without marks)."""
    e = entries.withColumn("name", paths.name_of(F.col("path"))).withColumn("parent", paths.parent_of(F.col("path")))
    e = e.withColumn("cased", text.fold_column(F.col("name"))).withColumn("bare", text.unaccent_folded_column(F.col("cased")))
    raw = F.when(F.col("is_dir"), "").otherwise(kinds.raw_extension(F.col("name")))
    e = e.withColumn("ext_cased", text.fold_column(raw)).withColumn("ext", text.unaccent_folded_column(F.col("ext_cased")))
    e = kinds.with_kind(e, "ext_cased")
    return e.withColumn("depth", paths.depth_of(F.col("path"))).drop("ext_cased")


def with_directories(files: DataFrame) -> DataFrame:
    """Add a row for each directory above a file, as a walk would find them."""
    above = files.select("source", "mtime", F.explode(paths.ancestors_of(F.col("path"))).alias("path"))
    dirs = above.groupBy("source", "path").agg(F.max("mtime").alias("mtime"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    dirs = dirs.select(
        "source", "path", F.lit(True).alias("is_dir"), zero.alias("size"), "mtime", F.col("mtime").alias("ctime"), F.col("mtime").alias("atime"),
        F.lit(0o40755).cast("long").alias("mode"), (one * 1000).alias("uid"), (one * 1000).alias("gid"), zero.alias("disk"), (-one).alias("items"), one.alias("links"),
    )
    return files.unionByName(dirs)


def _file(source: int, key: Column, path: Column, size: Column, mtime: Column) -> list[Column]:
    key, size, mtime = key.cast("long"), size.cast("long"), mtime.cast("long")
    mode = F.element_at(F.array(*map(F.lit, SAMPLE_MODES)), (key % 5 + 1).cast("int")).cast("long")
    owner = F.lit(1000) + key % 5
    return [
        F.lit(source).alias("source"), path.alias("path"), F.lit(False).alias("is_dir"), size.alias("size"), mtime.alias("mtime"), (mtime - key % 1000).alias("ctime"),
        (mtime + key % 86_400).alias("atime"), mode.alias("mode"), owner.cast("long").alias("uid"), owner.cast("long").alias("gid"),
        (F.ceil(size / 4096) * 4096).cast("long").alias("disk"), F.lit(-1).cast("long").alias("items"), (F.lit(1) + key % 3).cast("long").alias("links"),
    ]


def sample_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's tables as files of five sources: corpus, web, orders, parts, chats."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    c, glue = F.col, lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    slug = F.regexp_replace(F.substring("text", 1, 16), r"[^\p{L}\p{N}]+", "_")
    docs = read("documents").select(*_file(0, c("doc_id"), glue("/corpus/", c("source"), "/", c("lang"), "/", slug, "_", c("doc_id"), ".txt"), c("n_chars"), F.lit(1_700_000_000) + c("doc_id") * 7919 % 63_072_000))
    host = F.rtrim(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"[?#].*$", ""), F.lit("/"))
    pages = read("pages").select(*_file(1, c("page_id"), glue("/web/", host, "/page_", c("page_id"), ".html"), F.char_length("html"), F.lit(1_704_067_200) + 3600 * c("page_id")))
    when = F.unix_seconds(c("o_orderdate").cast("timestamp"))
    folder = glue("/orders/", c("o_orderstatus"), "/", F.replace("o_orderpriority", F.lit(" "), F.lit("_")), "/", F.date_format("o_orderdate", "yyyy"))
    orders = read("orders").select(*_file(2, c("o_orderkey"), glue(folder, "/order_", c("o_orderkey"), ".csv"), F.floor("o_totalprice"), when))
    ext = F.element_at(F.array(*map(F.lit, SAMPLE_EXTENSIONS)), (c("p_partkey") % len(SAMPLE_EXTENSIONS) + 1).cast("int"))
    stem = F.when(c("p_partkey") % 97 == 0, glue("/.gitignore_d", c("p_partkey"), "/.rs")).when(c("p_partkey") % 89 == 0, glue("/README_", c("p_partkey"))).otherwise(glue("/", F.replace("p_name", F.lit(" "), F.lit("_")), "_", c("p_partkey"), F.when(ext == "", "").otherwise(glue(".", ext))))
    parts = read("part").select(*_file(3, c("p_partkey"), glue("/parts/", F.replace("p_brand", F.lit("#"), F.lit("")), "/", c("p_type"), stem), F.when(c("p_partkey") % 53 == 0, 0).otherwise(F.floor(F.round(c("p_retailprice") * 100, 4))), F.lit(1_690_000_000) + 60 * c("p_partkey")))
    chats = read("conversations").select(*_file(4, c("conv_id"), glue("/chats/c", c("conv_id"), "/", c("turn"), "_", c("role"), ".md"), F.char_length("text"), F.lit(1_695_000_000) + 60 * c("conv_id") + c("turn")))
    return docs.unionByName(pages).unionByName(orders).unionByName(parts).unionByName(chats)


def sample_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and directories of the sample tables, with the derived columns."""
    return derive(with_directories(sample_files(spark, sf_dir)))


def sample_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(source, path, content)`` of the sources that have contents."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    c, glue = F.col, lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    slug = F.regexp_replace(F.substring("text", 1, 16), r"[^\p{L}\p{N}]+", "_")
    docs = read("documents").select(F.lit(0).alias("source"), glue("/corpus/", c("source"), "/", c("lang"), "/", slug, "_", c("doc_id"), ".txt").alias("path"), c("text").alias("content"))
    host = F.rtrim(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"[?#].*$", ""), F.lit("/"))
    pages = read("pages").select(F.lit(1).alias("source"), glue("/web/", host, "/page_", c("page_id"), ".html").alias("path"), c("html").alias("content"))
    chats = read("conversations").select(F.lit(4).alias("source"), glue("/chats/c", c("conv_id"), "/", c("turn"), "_", c("role"), ".md").alias("path"), c("text").alias("content"))
    return docs.unionByName(pages).unionByName(chats)


def write_segment(entries: DataFrame, path: str) -> None:
    """Write rows with their derived columns, in the order in which most queries return them, so that row groups have narrow ranges of time and path.

    Segments of another format are refused.
    """
    _check_format(entries.sparkSession, path, write=True)
    rows = entries if set(DERIVED.fieldNames()) <= set(entries.columns) else derive(entries)
    rows.select(*SCHEMA.fieldNames(), *DERIVED.fieldNames()).sortWithinPartitions(F.desc("mtime"), "path").write.mode("append").parquet(path)


def _check_format(spark: SparkSession, path: str, write: bool = False) -> None:
    """The format of a table of segments is the name of a folder that readers of data skip."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    mark = "_format-"
    found = [int(n[len(mark) :]) for s in (fs.listStatus(at) if fs.exists(at) else []) if (n := s.getPath().getName()).startswith(mark)]
    if found != [FORMAT_VERSION] and (found or not write):
        raise ValueError(f"{path} has segments of format {found or 'unknown'}, not {FORMAT_VERSION}")
    if not found:
        fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(at, f"{mark}{FORMAT_VERSION}"))


def read_segments(spark: SparkSession, *table: str) -> DataFrame:
    """Segments with their derived columns as they are stored; nothing is derived again."""
    for t in table:
        _check_format(spark, t)
    return spark.read.schema(T.StructType([*SCHEMA.fields, *DERIVED.fields])).parquet(*table)
