from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One of each kind; the driver compares them all.
NAMES = [
    "search_flagship", "pred_glob", "pred_under", "pred_ext_list", "pred_kind", "pred_time_day", "pred_regex", "pred_letters", "pred_bits_all", "pred_negated_range", "pred_accent_marked", "pred_exact_accents", "pred_fuzzy_1",
    "sort_name_asc", "sort_kind_desc", "sort_ext_asc", "sort_size_rollup", "usage_top", "facet_ext", "pred_fuzzy_2", "turkish_upper", "grep_hex", "grep_outcomes", "event_translation", "page_after", "relevance_terms", "count_capped", "derived_columns", "mode_string", "owner_join", "export_cells", "facets_multi", "facets_sideways", "age_ribbon", "usage_children",
    "subtree_sizes", "folder_weight", "dir_tree", "dupes_report", "grep_text", "content_and_query", "rules_allow", "prefix_reduce", "owner_of_path", "reconcile_table", "apply_report", "stream_upsert", "debounce", "shares_lrm", "fold_rest", "ring_arcs",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_and_sql_agree(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    result = duck.execute(entry.oracle_sql()[name])
    theirs = [d[0] for d in result.description]
    want = sorted(repr(tuple(r[theirs.index(c)] for c in sorted(theirs))) for r in result.fetchall())
    assert columns == sorted(theirs) and got == want


def test_duplicates_by_size_among_many_files(spark, tmp_path):
    for t in TABLES:
        os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    (tmp_path / "orders.parquet").unlink()
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT o.* REPLACE (i AS o_orderkey, CASE WHEN i < 200100 THEN 1000000 + i ELSE 2000 + i % 60 END AS o_totalprice)
      FROM range(201000) r(i), (SELECT * FROM '{SF}/orders.parquet' LIMIT 1) o) TO '{tmp_path}/orders.parquet' (FORMAT parquet)""")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = [tuple(r) for r in entry.queries()["dupes_size"](spark, str(tmp_path)).select("size", "files", "first_path", "waste").collect()]
    assert got == con.execute(entry.oracle_sql()["dupes_size"]).fetchall() and len(got) == 50


def test_every_query_has_sql_or_a_reason():
    without = {"pipeline"}
    assert {n for n in set(entry.queries()) - set(entry.oracle_sql()) if not n.startswith("op")} <= without
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["rank", "path", "size", "mtime"] and out.count() == 40


def test_the_rest_stands_without_the_training_data_package(tmp_path):
    root = Path(entry.__file__).parent
    shutil.copytree(root / "pathsonde", tmp_path / "pathsonde", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not [n for n in q if n.startswith('op')] and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q); print('fine')"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=120, check=False)
    assert done.stdout.strip() == "fine", done.stderr
