from __future__ import annotations

from collections import defaultdict

import pytest

from pathsonde.llm.linededup import BLANKS, dedup_lines


def plain(rows, min_chars=40, min_docs=5):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    low = lambda d: -(1 << 63) if d is None else d
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(k := line.strip(BLANKS).translate(lower)) >= min_chars:
                holders[k].add(low(d))
    keep = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if keep.get(x.strip(BLANKS).translate(lower), low(d)) == low(d)]
        out.append((d, t if len(kept) == len(lines) else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, n_LINES int")
    out = dedup_lines(df, **more).collect()
    assert list(out[0].asDict()) == ["doc_id", "text", "n_lines", "n_dropped"] if out else True
    return out


def same(got, want):
    key = lambda x: tuple((y is None, y or 0 if not isinstance(y, str) else y) for y in x)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_cases(spark):
    line, other = "This line is long enough to be looked at by dedup", "Ünother line that is also long enough, ñandú ñandú"
    rows = [(i, f"start {i}\n  {line.upper() if i % 2 else line}\t\r\nend\n") for i in range(6)]
    rows += [(i, other + "\n" + other) for i in range(10, 15)]
    rows += [(i, "short\nshort") for i in range(20, 27)] + [(30, "y" * 39), (31, "y" * 40), (32, "y" * 40)]
    rows += [(None, line), (40, None), (41, ""), (42, "\n\n"), (5, rows[5][1]), (3, other), (50, "\n".join([other] * 3000))]
    same(run(spark, rows), plain(rows))
    same(run(spark, rows, batches=1), plain(rows))


def test_empty(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("batches", [2, 7])
def test_documents(spark, batches):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = plain([(r.doc_id, r.text) for r in df.collect()])
    assert sum(x[3] for x in want) > 100
    same(dedup_lines(df, batches=batches).collect(), want)
