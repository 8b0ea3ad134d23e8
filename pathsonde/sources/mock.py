"""A made-up tree of any size: every row follows from its number and a seed, so no task needs another's rows.

It resembles a shared server: projects of uneven sizes, in each of them folders by topic and year; a project's files
are of the formats of its trade, and were changed in bursts. Some rows are links, private, or shared by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathsonde.sources.entries import NOW, derive, with_directories

TRADES = {
    "software": "rs py ts go sql md toml json lock so", "office": "pdf docx xlsx pptx csv txt eml", "studio": "png jpg svg psd mp4 mov wav flac", "lab": "csv parquet h5 npy ipynb log json gz", "attic": "zip tar iso bak old 7z",
}
TOPICS = ("inbox", "drafts", "final", "assets", "reports", "notes", "exports", "Übersicht", "şablon", "tests")
SYLLABLES = ("ka", "ri", "mo", "ten", "la", "vu", "so", "el", "dar", "pin", "çe", "ös")
#: Projects for so many files; seconds of a burst; years back that files reach.
FILES_PER_PROJECT, BURST, YEARS = 400, 5400, 6
YEAR = 31_557_600


class _Draws:
    """Independent draws of a row, each by its own name."""

    def __init__(self, seed: int, *of: Column | str) -> None:
        self.seed, self.of = seed, of or ("id",)

    def below(self, what: str, n: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed), F.lit(what), *self.of), F.lit(n))

    def one(self, what: str, values: tuple[str, ...]) -> Column:
        return F.get(F.array(*map(F.lit, values)), self.below(what, len(values)).cast("int"))

    def share(self, what: str) -> Column:
        """Uniform from 0 to 1."""
        return self.below(what, 1_000_000) / 1e6


def mock_files(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """``n`` files in projects whose sizes fall off with their number; paths are unique."""
    row = _Draws(seed)
    projects = max(1, n // FILES_PER_PROJECT)
    own = spark.range(n).withColumn("project", F.floor(projects * F.pow(row.share("project"), 2)))
    job = _Draws(seed, "project")
    trade = F.get(F.array(*map(F.lit, TRADES)), job.below("trade", len(TRADES)).cast("int"))
    formats = F.get(F.array(*(F.array(*map(F.lit, f.split())) for f in TRADES.values())), job.below("trade", len(TRADES)).cast("int"))
    age = F.floor(YEARS * YEAR * F.pow(row.share("age"), 3))
    changed = (F.lit(NOW) - age - F.pmod(F.lit(NOW) - age, F.lit(BURST)) + row.below("second", 60)).cast("long")
    stem = F.concat(*(row.one(f"syllable{k}", SYLLABLES) for k in range(3)))
    stem = F.concat(stem, F.element_at(F.array(F.lit(""), F.lit("-final"), F.lit(" (copy)"), F.concat(F.lit("_"), F.year(F.timestamp_seconds(changed)))), (row.below("tail", 4) + 1).cast("int")))
    ext = F.when(row.below("bare", 12) == 0, "").otherwise(F.concat(F.lit("."), F.get(formats, row.below("ext", 5).cast("int"))))
    folders = [F.lit("/srv"), trade, F.concat(F.lit("p"), F.col("project")), row.one("topic", TOPICS)]
    folder = F.concat_ws("/", *folders, F.when(row.below("dated", 3) > 0, F.year(F.timestamp_seconds(changed)).cast("string")))
    path = F.concat(folder, F.lit("/"), stem, F.lit("~"), F.col("id"), ext)
    size = F.floor(F.pow(F.lit(10.0), 8 * row.share("size")) - 1).cast("long")
    mode = F.when(row.below("mode", 50) == 0, 0o120777).when(row.below("mode", 50) < 4, 0o100600).when(row.below("mode", 50) < 8, 0o100755).otherwise(0o100664)
    owner = (2000 + job.below("owner", 7)).cast("long")
    return own.select(
        F.lit(0).alias("source"), path.alias("path"), F.lit(False).alias("is_dir"), size.alias("size"), changed.alias("mtime"), (changed - row.below("born", BURST)).alias("ctime"),
        (changed + F.least(row.below("read", YEAR), age)).cast("long").alias("atime"), mode.cast("long").alias("mode"), owner.alias("uid"), F.lit(2000).cast("long").alias("gid"),
        (F.ceil(size / 4096) * 4096).cast("long").alias("disk"), F.lit(-1).cast("long").alias("items"), (1 + F.when(row.below("linked", 40) == 0, 1).otherwise(0)).cast("long").alias("links"),
    )


def mock_entries(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    return derive(with_directories(mock_files(spark, n, seed)))
