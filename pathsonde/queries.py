"""Every query of the engine over the sample tables, by name."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathsonde import oracle
from pathsonde.functions import kinds, text
from pathsonde.lang.fields import Context
from pathsonde.operators import charts, content, export, facets, reconcile, rules, usage
from pathsonde.operators.search import KEY, SORTS, Engine, keyed, order
from pathsonde.sources.entries import NOW, SCHEMA, sample_contents, sample_entries
from pathsonde.sources.table import VersionedTable
from pathsonde.streaming import changes as feed

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SHOWN = ["source", "path", "size", "mtime"]
AGES = oracle.AGES
AGE_QUESTION = "age:" + ",".join(map(str, AGES))


def query(f: Run) -> Run:
    QUERIES[f.__name__] = f
    return f


def engine(spark: SparkSession, sf_dir: str, **how) -> Engine:
    return Engine(sample_entries(spark, sf_dir), Context(NOW, home="/home/u"), **how)


def _predicate(question: str) -> Run:
    return lambda spark, sf_dir: engine(spark, sf_dir).where(question).select(*SHOWN)


QUERIES |= {name: _predicate(question) for name, (question, _) in oracle.PREDICATES.items()}


@query
def pred_exact_accents(spark, sf_dir):
    return engine(spark, sf_dir, exact_accents=True).where("on").select(*SHOWN)


@query
def pred_fuzzy_2(spark, sf_dir):
    """Two mistakes, by the alignment table."""
    return engine(spark, sf_dir).where("fuzzy:smlal_wdiget").select(*SHOWN)


def ranked(page: DataFrame, *keys) -> DataFrame:
    """Number the rows of a page, which is at most a thousand rows."""
    return page.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(*keys)))


def _sorted(sort: str, descending: bool) -> Run:
    def run(spark, sf_dir):
        own = engine(spark, sf_dir)
        asked = "bolt|folder:|ext:mp3|kind:doc"
        page = keyed(own.where(asked), sort, own.parse(asked)).orderBy(*order(descending)).limit(60)
        return ranked(page, *order(descending)).select("rank", "path")

    return run


QUERIES |= {f"sort_{s}_{way}": _sorted(s, way == "desc") for s in SORTS if s != "relevance" for way in ("asc", "desc")}


@query
def sort_size_rollup(spark, sf_dir):
    own = engine(spark, sf_dir, weights=usage.subtree_sizes(sample_entries(spark, sf_dir), NOW))
    page = keyed(own.where("bolt|folder:"), "size", own.parse(""), own.weights).orderBy(*order(True)).limit(60)
    return ranked(page, *order(True)).select("rank", "path")


@query
def page_offset(spark, sf_dir):
    page = engine(spark, sf_dir).rows("", "size", offset=120, limit=40)
    return ranked(page, F.desc("size"), F.desc("mtime"), "path").select("rank", "path")


@query
def page_after(spark, sf_dir):
    """The same page, reached from the last row of the one before."""
    own = engine(spark, sf_dir)
    last = own.rows("", "size", limit=120).orderBy("size", "mtime", F.desc("path")).select("size", "mtime", "path").first()
    page = own.after("", last.asDict(), "size", True, limit=40)
    return ranked(page, F.desc("size"), F.desc("mtime"), "path").select("rank", "path")


@query
def search_flagship(spark, sf_dir):
    page = engine(spark, sf_dir).search("ext:csv size:>100kb", "modified", limit=40).rows
    return ranked(page, F.desc("mtime"), "path").select("rank", "path", "size", "mtime")


def _relevant(asked: str) -> Run:
    def run(spark, sf_dir):
        own = engine(spark, sf_dir)
        page = keyed(own.where(asked), "relevance", own.parse(asked)).orderBy(*order(True)).limit(100)
        return ranked(page, *order(True)).select("rank", "path", F.col(KEY).alias("relevance"))

    return run


QUERIES |= {"relevance": _relevant("bolt"), "relevance_terms": _relevant("bolt red"), "relevance_folder": _relevant("small")}


@query
def count_all(spark, sf_dir):
    return engine(spark, sf_dir).count("", cap=1_000_000_000)


@query
def count_capped(spark, sf_dir):
    return engine(spark, sf_dir).count("bolt", cap=100)


@query
def similar_count(spark, sf_dir):
    return engine(spark, sf_dir).similar("anvli")


@query
def scan_entries(spark, sf_dir):
    return sample_entries(spark, sf_dir).select(*SCHEMA.fieldNames())


@query
def derived_columns(spark, sf_dir):
    return sample_entries(spark, sf_dir).select("source", "path", "name", "parent", "ext", "kind", "depth", "cased", "bare")


@query
def entry_stat(spark, sf_dir):
    return engine(spark, sf_dir).stat("/parts/Brand1").select(*SHOWN, "is_dir")


@query
def index_stats(spark, sf_dir):
    return reconcile.index_stats(sample_entries(spark, sf_dir))


@query
def mode_string(spark, sf_dir):
    return sample_entries(spark, sf_dir).select("source", "path", kinds.mode_string(F.col("is_dir"), F.col("mode")).alias("perm"))


def _owners(spark: SparkSession, sf_dir: str, base: int) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select((F.col("n_nationkey") + base).cast("long").alias("id"), F.col("n_name").alias("name"))


@query
def owner_join(spark, sf_dir):
    rows = export.with_owner_names(sample_entries(spark, sf_dir), _owners(spark, sf_dir, 1001), _owners(spark, sf_dir, 1002))
    return rows.select("source", "path", "user", "group")


@query
def export_cells(spark, sf_dir):
    return export.cells(engine(spark, sf_dir).where("bolt"), ["name", "path", "full", "ext", "size", "mtime", "kind", "perm", "user", "items", "nonsense"])


@query
def runs_when_opened(spark, sf_dir):
    return sample_entries(spark, sf_dir).filter(~F.col("is_dir") & kinds.runs_when_opened(F.col("kind"), F.col("ext"))).select("path")


@query
def turkish_upper(spark, sf_dir):
    return sample_entries(spark, sf_dir).select("source", "path", text.turkish_upper(F.col("name")).alias("upper"))


@query
def facet_kind(spark, sf_dir):
    return facets.facets(engine(spark, sf_dir).where(""), ["kind"], NOW, cap=None)


@query
def facet_ext(spark, sf_dir):
    return facets.facets(engine(spark, sf_dir).where(""), ["ext"], NOW, top=5, cap=None)


@query
def facet_dir(spark, sf_dir):
    return facets.facets(engine(spark, sf_dir).where(""), ["dir:/parts"], NOW, top=10, cap=None)


@query
def facet_age(spark, sf_dir):
    return facets.facets(engine(spark, sf_dir).where(""), [AGE_QUESTION], NOW)


@query
def facets_multi(spark, sf_dir):
    return facets.facets(engine(spark, sf_dir).where("bolt"), ["kind", "ext", "dir:/parts", AGE_QUESTION], NOW)


@query
def facets_sideways(spark, sf_dir):
    return facets.sideways(engine(spark, sf_dir), "bolt kind:code dm:1200d", AGES)


@query
def age_ribbon(spark, sf_dir):
    return facets.facets(engine(spark, sf_dir).where(""), ["age:" + ",".join(map(str, charts.ribbon_edges()))], NOW)


def flat(rows: DataFrame) -> DataFrame:
    return rows.select(*[c for c in rows.columns if c != "age"], *[F.get("age", F.lit(k)).alias(f"age{k}") for k in range(6)])


@query
def usage_root(spark, sf_dir):
    return flat(usage.usage_root(engine(spark, sf_dir).where(""), "/parts/", NOW))


@query
def usage_everything(spark, sf_dir):
    return flat(usage.usage_root(engine(spark, sf_dir).where(""), "/", NOW))


@query
def usage_children(spark, sf_dir):
    return flat(usage.usage_children(engine(spark, sf_dir).where(""), "/parts", NOW))


@query
def usage_top(spark, sf_dir):
    return flat(usage.usage_children(engine(spark, sf_dir).where(""), "/", NOW, top=3))


@query
def usage_filtered(spark, sf_dir):
    return flat(usage.usage_children(engine(spark, sf_dir).where("size:>1500"), "/corpus", NOW, top=5))


@query
def subtree_sizes(spark, sf_dir):
    return flat(usage.subtree_sizes(sample_entries(spark, sf_dir), NOW))


@query
def folder_weight(spark, sf_dir):
    own = sample_entries(spark, sf_dir)
    return usage.with_folder_weight(own, own, NOW).select("source", "path", F.col("under.disk").alias("under_disk"), F.col("under.files").alias("under_files"))


@query
def children_count(spark, sf_dir):
    return usage.children_count(sample_entries(spark, sf_dir))


@query
def dir_tree(spark, sf_dir):
    return usage.tree(sample_entries(spark, sf_dir), "/parts", depth=2, limit=4).select("path", "level", "is_dir", "children", "truncated")


@query
def dupes_size(spark, sf_dir):
    return content.top_groups(content.size_groups(content.duplicate_candidates(sample_entries(spark, sf_dir), 1000)))


def _with_content(spark, sf_dir):
    own = sample_entries(spark, sf_dir).filter("source in (0, 1, 4)")
    return content.duplicate_candidates(own, 200), sample_contents(spark, sf_dir)


@query
def dupes_content(spark, sf_dir):
    return content.top_groups(content.content_groups(*_with_content(spark, sf_dir))[0])


@query
def dupes_members(spark, sf_dir):
    return content.content_groups(*_with_content(spark, sf_dir))[1]


@query
def dupes_report(spark, sf_dir):
    own, contents = _with_content(spark, sf_dir)
    return content.duplicate_report(own, content.size_groups(own), content.content_groups(own, contents)[0])


def _lines(hits: DataFrame) -> DataFrame:
    each = hits.select("source", "path", F.explode("hits").alias("h"), "more")
    return each.select("source", "path", "h.line", "h.offset", "h.length", "more")


@query
def grep_text(spark, sf_dir):
    return _lines(content.grep(engine(spark, sf_dir), sample_contents(spark, sf_dir), "", "license"))


@query
def grep_regex(spark, sf_dir):
    return _lines(content.grep(engine(spark, sf_dir), sample_contents(spark, sf_dir), "", "token = .[0-9a-f]+", kind="regex", top=1000))


@query
def grep_outcomes(spark, sf_dir):
    return content.grep_outcomes(sample_contents(spark, sf_dir))


@query
def grep_hex(spark, sf_dir):
    return _lines(content.grep(engine(spark, sf_dir), sample_contents(spark, sf_dir), "", "74 6f 6b 65 6e20 3d", kind="hex", top=1000))


@query
def grep_in_query(spark, sf_dir):
    return _lines(content.grep(engine(spark, sf_dir), sample_contents(spark, sf_dir), "under:/chats", "the a", top=20))


@query
def content_and_query(spark, sf_dir):
    rows = content.search_content(engine(spark, sf_dir), sample_contents(spark, sf_dir), 'ext:txt content:"the " content:license')
    return rows.select("source", "path")


@query
def rules_exclude(spark, sf_dir):
    own = rules.Rules(paths=("/orders/F",), dirs=("Small", "brand2/promo"), files=(".RS",))
    return rules.apply_rules(sample_entries(spark, sf_dir), own)[0].select("source", "path")


@query
def rules_allow(spark, sf_dir):
    own = rules.Rules(paths=(), dirs=("small",), files=(), allow=("/parts/Brand1/SMALL", "Brand3/SMALL"), deny=("/chats/c1",))
    return rules.apply_rules(sample_entries(spark, sf_dir), own)[0].select("source", "path")


@query
def rules_gone(spark, sf_dir):
    return rules.apply_rules(sample_entries(spark, sf_dir), rules.Rules(paths=(), dirs=("small",), files=()))[1]


@query
def prefix_reduce(spark, sf_dir):
    return rules.reduce_prefixes(engine(spark, sf_dir).where("folder: 1"))


@query
def owner_of_path(spark, sf_dir):
    roots = spark.createDataFrame([(1, "/parts"), (2, "/parts/Brand1"), (3, "/orders"), (4, "/parts/Brand1/SMALL")], "source int, root string")
    own = engine(spark, sf_dir)
    return own.owner_of(roots, own.entries.select("path").distinct()).select("path", "source")


def _snapshots(spark, sf_dir):
    own = sample_entries(spark, sf_dir)
    old = own.filter("length(path) % 7 <> 0")
    new = own.filter("length(path) % 5 <> 0 and source <> 2").withColumn("size", F.expr("if(length(path) % 3 = 0 and not is_dir, size + 1, size)")).withColumn("atime", F.col("atime") + 5)
    return old, new, ["/parts", "/corpus", "/orders"], ["/parts/Brand1"]


@query
def reconcile_states(spark, sf_dir):
    return reconcile.classify(*_snapshots(spark, sf_dir))


@query
def reconcile_table(spark, sf_dir):
    return reconcile.reconcile(*_snapshots(spark, sf_dir)).select("source", "path", "size")


def sample_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as changes: errors remove a folder, views ask for a rescan, the rest write a file."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_id % 5 <> 0")
    folder = F.concat(F.lit("/feed/u"), F.col("user_id") % 40)
    file = F.concat(folder, F.lit("/f"), F.col("user_id") % 7, F.lit(".dat"))
    op = F.when(F.col("event_type") == "error", "remove_subtree").when(F.col("event_type") == "view", "rescan").otherwise("upsert")
    e = e.withColumn("op", op).filter(~((F.col("op") == "remove_subtree") & folder.endswith("1")))
    path = F.when(F.col("op") == "upsert", file).otherwise(folder)
    number = lambda n: F.lit(n).cast("long")
    entry = F.struct(*[{"is_dir": F.lit(False), "size": F.floor(F.col("value") * 100).cast("long"), "links": number(1), "items": number(-1)}.get(f.name, number(0)).alias(f.name) for f in SCHEMA.fields[2:]])
    return e.select(F.col("event_id").alias("seq"), "op", F.lit(0).alias("source"), path.alias("path"), entry.alias("entry"))


@query
def event_translation(spark, sf_dir):
    """The events as a watcher's reports: errors are missing paths, views unclear ones, signups new folders, some are lost."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    found = F.when(F.col("user_id") % 97 == 0, "overflow").when(F.col("event_type") == "error", "missing").when(F.col("event_type") == "view", "unclear").otherwise("there")
    path = F.when(F.col("user_id") % 194 != 0, F.concat(F.lit("/u"), F.col("user_id")))
    size = F.floor(F.col("value") * 100).cast("long")
    e = e.select(F.col("event_id").alias("seq"), F.lit(0).alias("source"), path.alias("path"), found.alias("found"), (F.col("event_type") == "signup").alias("fresh"), F.struct(size.alias("size")).alias("entry"))
    return feed.translate_events(e).select("seq", "op", "path", F.col("entry.size").alias("size"))


def sample_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_id % 3 = 0")
    path = F.concat(F.lit("/feed/u"), F.col("user_id") % 40, F.lit("/f"), F.col("user_id") % 7, F.lit(".dat"))
    rows = e.select(path.alias("path")).distinct()
    value = {"source": F.lit(0), "is_dir": F.lit(False), "size": F.lit(-1).cast("long"), "links": F.lit(1).cast("long"), "items": F.lit(-1).cast("long"), "path": F.col("path")}
    return rows.select(*[value.get(f.name, F.lit(0).cast("long")).alias(f.name) for f in SCHEMA.fields])


@query
def upsert_latest(spark, sf_dir):
    return reconcile.latest(sample_changes(spark, sf_dir)).select("path", F.col("entry.size").alias("size"))


@query
def apply_changes(spark, sf_dir):
    return reconcile.apply_changes(sample_table(spark, sf_dir), sample_changes(spark, sf_dir)).select("path", "size")


@query
def apply_report(spark, sf_dir):
    return reconcile.apply_report(sample_table(spark, sf_dir), sample_changes(spark, sf_dir))


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares; a temporary one where none is named, as in tests."""
    import tempfile

    shared = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="pathsonde-")
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"


@query
def stream_upsert(spark, sf_dir):
    """The changes as a stream of files, some per batch, applied to a versioned table."""
    base = scratch(spark)
    table = VersionedTable(spark, f"{base}/table")
    table.publish(sample_table(spark, sf_dir))
    own = sample_changes(spark, sf_dir)
    bounds = own.agg(F.expr("percentile_approx(seq, array(0.33, 0.66))").alias("b")).first().b
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        part = own.filter((F.lit(True) if low is None else F.col("seq") > low) & (F.lit(True) if high is None else F.col("seq") <= high))
        part.coalesce(1).write.mode("append").parquet(f"{base}/feed")
    stream = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/feed")
    feed.apply_stream(stream, table, f"{base}/checkpoint").awaitTermination()
    return table.read().select("path", "size")


@query
def debounce(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type = 'view'")
    u = F.col("user_id")
    path = F.when(u % 97 == 0, "").when(u % 2 == 0, F.concat(F.lit("/a/u"), u % 9)).otherwise(F.concat(F.lit("/a/u"), u % 9, F.lit("/x")))
    asked = e.select((u % 3).cast("int").alias("source"), (F.col("event_id") * 130 + u % 400).alias("at_ms"), path.alias("path"))
    return feed.debounce(asked).select("source", "burst", "run_at", F.array_join("paths", " ").alias("paths"))


def _kinds(spark, sf_dir):
    return sample_entries(spark, sf_dir).groupBy(F.col("kind").alias("idx")).agg(F.count(F.lit(1)).alias("value"))


@query
def shares_lrm(spark, sf_dir):
    return charts.shares(_kinds(spark, sf_dir))


@query
def bar_cells(spark, sf_dir):
    return charts.cells(_kinds(spark, sf_dir), 40)


@query
def fold_rest(spark, sf_dir):
    return charts.fold_rest(_kinds(spark, sf_dir), 4)


def _segments(length: float) -> Run:
    def run(spark, sf_dir):
        out = charts.segments(_kinds(spark, sf_dir), length=length)
        return out.select("idx", "value", F.round("start", 6).alias("start"), F.round("width", 6).alias("width"))

    return run


QUERIES |= {"bar_segments": _segments(1.0), "ring_arcs": _segments(360.0)}
