"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches, largest ids first. The keys of a batch are merge-anti-joined with the
runs so far: those not met before are the batch's own, and the document that keeps their lines is
settled; the rest only add to counts. Each batch is written as a run sorted by key. When a level has
FANOUT runs they are merged into one of the next level, and at the end all runs into one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathsonde.llm.common import ascii_lower, cut, free_name, parted

#: Space and 09-0D.
BLANKS = " \t\n\x0b\x0c\r"
#: Runs of a level that are merged into one of the next.
FANOUT = 2


def lines_of(text: Column) -> Column:
    """Lines between \\n; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _hashed(key: Column) -> Column:
    """128 bits of hash, in two columns that are seeded apart."""
    return F.struct(F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(7), key).alias("k2"))


class Runs:
    """The levels of runs ``(k1, k2, n, keeper)``; keeper is null where a run only adds to the count."""

    def __init__(self) -> None:
        self.levels: list[list[DataFrame]] = []

    def all(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    @staticmethod
    def _sorted(df: DataFrame) -> DataFrame:
        return cut(df.repartition("k1", "k2").sortWithinPartitions("k1", "k2"))

    @staticmethod
    def merge(runs: list[DataFrame]) -> DataFrame:
        if len(runs) == 1:
            return runs[0]
        both = reduce(DataFrame.unionByName, runs)
        return both.groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))

    def add(self, own: DataFrame) -> None:
        """Take the counts ``(k1, k2, n, keeper)`` of a batch whose ids are below those of all before."""
        if seen := self.all():
            known = reduce(DataFrame.unionByName, [r.select("k1", "k2") for r in seen])
            own = self._sorted(own)
            first = own.join(known, ["k1", "k2"], "left_anti")
            again = own.join(known, ["k1", "k2"], "left_semi").withColumn("keeper", F.lit(None).cast(own.schema["keeper"].dataType))
            own = first.unionByName(again)
        self._put(self._sorted(own), 0)

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == FANOUT:
            merged, self.levels[level] = self._sorted(self.merge(self.levels[level])), []
            self._put(merged, level + 1)


def _batches(df: DataFrame, key: str, batches: int) -> list[Column]:
    """Conditions that part the rows by ranges of ``key``, largest first; nulls come last."""
    shares = [k / batches for k in range(1, batches)]
    bounds = (df.agg(F.percentile_approx(key, shares, 1000)).first()[0] or []) if shares else []
    c, out, upper = F.col(key), [], None
    for b in sorted(set(bounds), reverse=True):
        out.append(c > b if upper is None else (c > b) & (c <= upper))
        upper = b
    rest = F.lit(True) if upper is None else c <= upper
    return [*out, rest | c.isNull()]


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int = 4) -> DataFrame:
    """Drop repeated lines from ``text`` and add ``n_lines`` and ``n_dropped``.

    A line's key is the line without blanks at its ends and with A-Z in lower case. Keys of at
    least ``min_chars`` code points that occur in at least ``min_docs`` documents (distinct values
    of ``key``, an integer) lose all their lines but those of the largest ``key`` that holds them.
    The other lines stay in order; a text that loses none is returned as it is, null included.

    Rows with a null ``key`` count as one document, below all others. Repeated rows are treated
    alike. All other columns stay; those named like the added ones are replaced. Nothing is sampled
    or capped, and no line's rows are gathered in one place: counts are summed before each exchange.
    """
    rows = df.drop(*[c for c in df.columns if c.lower() in ("n_lines", "n_dropped")])
    own = rows.select(F.col(key).cast("long").alias("did"), F.col(text).alias("text"))
    keys = F.transform(lines_of(F.col("text")), line_key)
    long_keys = F.array_distinct(F.filter(keys, lambda k: F.char_length(k) >= min_chars))
    runs = Runs()
    for batch in _batches(own, "did", batches):
        held = own.filter(batch).select(F.coalesce("did", F.lit(-(1 << 63))).alias("did"), F.explode(long_keys).alias("key"))
        held = held.select("did", _hashed(F.col("key")).alias("k")).select("did", "k.*")
        runs.add(held.groupBy("k1", "k2").agg(F.count_distinct("did").alias("n"), F.max("did").alias("keeper")))
    doomed = cut(Runs.merge(runs.all()).filter(F.col("n") >= min_docs).select("k1", "k2", "keeper"))

    at, h, drop, did = (free_name(rows, f"_{x}") for x in ("lines", "hash", "drop", "did"))
    mark = F.xxhash64(F.col("text"))
    placed = own.select(F.coalesce("did", F.lit(-(1 << 63))).alias("did"), mark.alias("h"), F.posexplode(keys).alias("pos", "key"))
    placed = placed.filter(F.char_length("key") >= min_chars).select("did", "h", "pos", _hashed(F.col("key")).alias("k")).select("did", "h", "pos", "k.*")
    hits = placed.join(doomed, ["k1", "k2"]).filter("did <> keeper")
    drops = cut(hits.groupBy("did", "h").agg(F.collect_set("pos").alias(drop)).select(F.col("did").alias(did), F.col("h").alias(h), drop))

    marked = rows.withColumn(did, F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))).withColumn(h, F.xxhash64(F.col(text)))
    perhaps, whole = parted(marked, F.col(h), drops.select(h))  # texts that surely lose nothing are not exchanged
    joined = perhaps.join(drops, [did, h], "left").unionByName(whole.withColumn(drop, F.lit(None).cast(drops.schema[drop].dataType)))
    joined = joined.withColumn(at, lines_of(F.col(text)))
    kept = F.array_except(F.sequence(F.lit(0), F.size(at) - 1), F.col(drop))
    cleaned = F.when(F.col(drop).isNull(), F.col(text)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col(at), i)), "\n"))
    out = joined.withColumn(text, cleaned).withColumn("n_lines", F.size(at).cast("long"))
    out = out.withColumn("n_dropped", F.when(F.col(drop).isNull(), F.lit(0)).otherwise(F.size(drop)).cast("long"))
    return out.select(*rows.columns, "n_lines", "n_dropped")
