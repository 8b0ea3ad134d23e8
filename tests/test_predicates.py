from __future__ import annotations

import random

import pytest

from pathsonde.functions import text
from pathsonde.lang import ast, parser
from pathsonde.lang.fields import Context
from pathsonde.operators.search import Engine
from pathsonde.plans.compile import ContentNotIndexed, filter_column
from pathsonde.plans.reference import matches
from pathsonde.sources.entries import SCHEMA, derive, with_directories

NOW = 1_785_000_000
WORDS = ["rapor", "Dilekçe", "İSTANBUL", "ısı", "straße", "Ñandú", "кафе", "Йод", "Ωμέγα", "日本", "ﬁle", "ＡＢＣ", "naïve", "œuvre", "Þór", "kitap", "kitpa", "raporr", "durusmatutanagi", "durusmatutnagai", "x%y_z", "a.b.c", ".rs", "README", "license-mit", "Makefile", "order_1*"]
EXTENSIONS = ["", ".rs", ".JPG", ".tar.gz", ".PDF", ".html", ".averylongextension", ".é", ".mp3", ".bin"]


def rows(n=1200, seed=1):
    rng, seen = random.Random(seed), {}
    for i in range(n):
        folder = rng.choice(["/a", "/a-b", "/a/x", "/home/u/Projeler", "/home/u/.cache/target", "/é/Ş", ""])
        name = rng.choice(WORDS) + rng.choice(["", "_", " "]) + rng.choice(["", str(i), rng.choice(WORDS)]) + rng.choice(EXTENSIONS)
        path = f"{folder}/{name}"
        t = NOW - rng.choice([0, 3600, 86400 * 3, 86400 * 40, 86400 * 800])
        seen[path] = (0, path, False, rng.choice([0, 1, 1000, 1 << 20, 5 << 20]), t, t - 5, t + 5, rng.choice([0o100644, 0o100755, 0o104755, 0o120777]), 1000 + i % 3, 50 + i % 2, 4096, -1, 1 + i % 2)
    return list(seen.values())


@pytest.fixture(scope="module")
def entries(spark):
    e = derive(with_directories(spark.createDataFrame(rows(), SCHEMA))).cache()
    e.count()
    return e


@pytest.fixture(scope="module")
def plain(entries):
    return [r.asDict() for r in entries.collect()]


QUESTIONS = [
    "", "rapor", "DİLEKÇE", "dilekce", "ısı", "isi", "strasse", "straße", "nandu", "ñandú", "кафе", "йод", "иод", "ωμεγα", "日本", "abc", "ＡＢＣ", "oeuvre", "thor",
    "*.rs", "*.jpg", "*.averylongextension", ".rs", "?apor*", "x%y_z", "*%y_*", '"order_1*"', "a/x", "/é/ş", "path:PROJELER", "under:/a", "under:/a/", "under:/", "parent:/a", "parent:/",
    "ext:é", "ext:e;gz", "ext:averylongextension", "file:", "folder:", "size:>0", "size:1mb..2mb", "!size:1mb..2mb", "kind:code", "kind:folder|kind:exec", "kind:build", "kind:doc",
    "dm:1d", "dm:2026-07-25", "dc:<7d", "da:>=2026-01-01", "depth:2", "depth:>2", "regex:^r.*[0-9]$", "regex:^\\w+$", "regex:ç", "len:<8", "len:=5", "case:README", "case:readme",
    "fuzzy:kitap", "fuzzy:rapro", "fuzzy:durusmatutanagi", "fuzzy:makefiel", "letters:rpr", "letters:x%z", "user:1001", "group:50", "perm:644", "perm:-111", "perm:/4000", "node:l", "suid:", "ww:",
    "empty:", "!empty:", "pic:|audio:", "rapor|kitap !ext:pdf", "!rapor|kitap", "kitap;rapor", "zz:1|rapor", "kind:zurna", "endwith:gz", "in:/nowhere",
]


@pytest.mark.parametrize("exact", [False, True])
def test_filters_against_the_plain_matcher(entries, plain, exact):
    """All questions in one pass: a column for each."""
    parsed = {q: parser.parse(q, Context(NOW), exact) for q in QUESTIONS}
    got = entries.select("path", *[filter_column(p).alias(f"q{k}") for k, p in enumerate(parsed.values())]).collect()
    found = {k: {r.path for r in got if r[f"q{k}"]} for k in range(len(parsed))}
    for k, (q, p) in enumerate(parsed.items()):
        assert found[k] == {e["path"] for e in plain if matches(e, p)}, q


def test_random_conjunctions(entries, plain):
    rng = random.Random(7)
    parsed = [parser.parse(" ".join(rng.choice(["", "!"]) + rng.choice(QUESTIONS[1:]) for _ in range(rng.randint(1, 3))), Context(NOW)) for _ in range(40)]
    got = entries.select("path", *[filter_column(p).alias(f"q{k}") for k, p in enumerate(parsed)]).collect()
    for k, p in enumerate(parsed):
        assert {r.path for r in got if r[f"q{k}"]} == {e["path"] for e in plain if matches(e, p)}, p


def test_errors(entries):
    own = Engine(entries, Context(NOW))
    with pytest.raises(Exception, match="Unclosed group"):
        own.where("regex:(").count()
    with pytest.raises(ContentNotIndexed):
        own.where("content:x")


@pytest.mark.parametrize(("term", "name", "want"), [("abc", "xxabcxx", 0), ("abc", "acb", 1), ("ca", "abc", 1), ("kitap", "kitpa", 1), ("kitap", "ktp", 2), ("abc", "", 3), ("", "abc", 0)])
def test_distance(term, name, want):
    assert text.substring_distance(term, name) == want


def test_folding_columns_agree_with_python(spark):
    samples = [*WORDS, "ÀÉÎõü ŁØÐþ ǅ", "á̂b̧", "שָׁלוֹם", "مُحَمَّد", "İıIi", "Straße ﬀ", "ΟΔΟΣ ΑΒ", "ΣΑΣ", "ς", "\U0001f600 Ａ１"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    for r in df.select("s", text.fold_column(df.s).alias("f"), text.unaccent_column(df.s).alias("u")).collect():
        assert (r.f, r.u) == (text.fold(r.s), text.unaccent(r.s)), r.s


def test_distances_of_many_names():
    rng = random.Random(8)
    for _ in range(60):
        term = "".join(rng.choices("abcé", k=rng.randint(1, 9)))
        names = ["", *("".join(rng.choices("abcdé🙂", k=rng.randint(0, 14))) for _ in range(40))]
        assert text.substring_distances(term, names).tolist() == [text.substring_distance(term, n) for n in names]


def test_plans_prune(spark, entries, tmp_path):
    from pathsonde.sources.entries import read_segments, write_segment

    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    write_segment(entries, str(tmp_path / "t"))
    own = Engine(read_segments(spark, str(tmp_path / "t")), Context(NOW))
    plan = own.where("under:/a size:>1mb dm:>1d").select("path")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(path,/a/)" in plan and "GreaterThan(size" in plan and "GreaterThan(mtime" in plan
    assert "ReadSchema: struct<path:string,size:bigint,mtime:bigint>" in plan
    plan = own.where("bolt ext:pdf;rs kind:code parent:/a *.rs depth:4").select("path")._jdf.queryExecution().executedPlan().toString()
    for pushed in ("StringContains(bare,bolt)", "In(ext, [pdf,rs])", "EqualTo(kind,2)", "EqualTo(parent,/a)", "StringEndsWith(bare,.rs)", "EqualTo(depth,4)"):
        assert pushed in plan, pushed
    assert "Join" not in plan and "translate" not in plan
    (tmp_path / "t" / "_format-2").rename(tmp_path / "t" / "_format-1")
    for bad in (lambda: read_segments(spark, str(tmp_path / "t")), lambda: write_segment(entries, str(tmp_path / "t"))):
        with pytest.raises(ValueError, match="format"):
            bad()
    assert "TakeOrderedAndProject" in own.rows("bolt", "modified")._jdf.queryExecution().executedPlan().toString()


def test_similar_and_typos(entries):
    own = Engine(entries, Context(NOW))
    assert own.stat("/a", ("/a/b", "/a")).columns and own.parse("report ab !tmp one|two").narrowing_terms(3) == ["report"]
    with pytest.raises(ValueError, match="source"):
        own.stat("/ab", ("/a",))
    assert own.similar("kitapp").first().total > 0 and own.similar("abc") is None
    assert isinstance(Engine(entries, Context(NOW), typos="always").parse("kitap").groups[0][0].match, ast.NameNear)
    page = own.search("kind:zurna rapor", limit=5)
    assert page.misread and "rapor" in page.sentence and page.rows.count() == 0
    assert own.explain("kind:im")["completions"] == ["kind:image"]
