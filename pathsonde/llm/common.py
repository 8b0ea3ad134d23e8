"""What the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a temporary folder serves a local session; on a cluster that is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if spark not in _OWN:
        _OWN[spark] = "file://" + tempfile.mkdtemp(prefix="pathsonde-")
    return _OWN[spark]


_OWN: WeakKeyDictionary = WeakKeyDictionary()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This ends the lineage, survives lost executors, and tells the planner how many bytes there are. These
    are compressed; frames of repetitive arrays or texts are joined by ``shuffled``, which never broadcasts.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete what ``cut`` has written for these frames, once nothing that is still to run reads it."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join in which it is not to be broadcast, whatever its files' size."""
    return df.hint("shuffle_merge")


#: Bits of a filter for each key, and at most.
KEY_BITS, MOST_BITS = 16, 1 << 27


def parted(rows: DataFrame, hashed: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``hashed`` (a long) may be among the single column of ``keys``, and rows whose hash is surely not.

    It decides by a bitmap of at most MOST_BITS bits (16 MB), which is broadcast; where there are too many keys for
    it, more rows may be among them. So a join with ``keys`` need not exchange the rows that it has nothing for.
    """
    spark, (key,) = rows.sparkSession, keys.columns
    size = min(MOST_BITS, 1 << max(16, (KEY_BITS * keys.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(F.lit(3), c), F.lit(size))
    word, bit = (lambda p: F.shiftright(p, 6).cast("int")), (lambda p: p.bitwiseAND(F.lit(63)).cast("int"))
    set_ = keys.filter(F.col(key).isNotNull()).select(place(F.col(key)).alias("p")).groupBy(word(F.col("p")).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("p")))).alias("b"))
    every = spark.range(size >> 6).select(F.col("id").cast("int").alias("w")).join(set_, "w", "left").select(F.struct("w", F.coalesce("b", F.lit(0).cast("long")).alias("b")).alias("x"))
    name = free_name(rows, "_bits")
    bits = cut(every.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]).alias(name)))
    found = F.call_function("shiftrightunsigned", F.get(F.col(name), word(place(hashed))), bit(place(hashed))).bitwiseAND(F.lit(1).cast("long")) == 1
    both = rows.crossJoin(F.broadcast(bits))  # one row
    return both.filter(found).drop(name), both.filter(~F.coalesce(found, F.lit(False))).drop(name)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it (without regard to case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ascii_lower(c: Column) -> Column:
    """A-Z to lower case, everything else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, so that what a task makes of long texts stays small."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
