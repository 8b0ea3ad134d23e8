from __future__ import annotations

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipe
from pathsonde.llm.memo import ENTRIES
from tests.llm.test_linededup import plain as plain_lines
from tests.llm.test_neardedup import brute as plain_groups
from tests.llm.test_pii import plain as plain_spans

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage makes of sf0.01, the input first."""
    where, out = tmp_path_factory.mktemp("stages"), [spark.read.parquet(f"{SF}/documents.parquet")]
    for k, (_, stage) in enumerate(pipe.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{where}/{k}")
        out.append(spark.read.parquet(f"{where}/{k}"))
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_order_and_columns(stages):
    assert [n for n, _ in pipe.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "PII", "packing"]
    assert all(df.columns == COLUMNS for df in stages[:-1])
    assert all(df.dtypes == stages[0].dtypes for df in stages[:-1])


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    kept = {d for d, _ in pairs(stages[1])}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean, toxic = [d for d, y in labels.items() if y == 0], [d for d, y in labels.items() if y == 1]
    assert sum(d in kept for d in clean) >= 0.97 * len(clean) and sum(d not in kept for d in toxic) >= 0.6 * len(toxic)


def test_lines(stages):
    want = {d: t for d, t, _, _ in plain_lines(pairs(stages[1]))}
    assert dict(pairs(stages[2])) == want and all(r.n_chars == len(r.text) for r in stages[2].collect())


def test_near_copies(stages):
    want = {k for _, k in plain_groups(pairs(stages[2]))}
    got = {d for d, _ in pairs(stages[3])}
    assert got == want
    before = dict(pairs(stages[2]))
    assert all(before[d] == t for d, t in pairs(stages[3]))


def test_personal_data(stages):
    before, after = dict(pairs(stages[3])), dict(pairs(stages[4]))
    assert before.keys() == after.keys() and not any(plain_spans(t) for t in after.values())
    clean = [d for d, t in before.items() if not plain_spans(t)]
    assert sum(before[d] == after[d] for d in clean) >= 0.99 * len(clean)


def test_packing(stages):
    texts, tok = dict(pairs(stages[4])), Tokenizer.from_file(pipe.WORD_BPE)
    pieces = stages[5].collect()
    lengths: dict = {}
    for p in pieces:
        lengths[p.doc_id] = lengths.get(p.doc_id, 0) + p.length
    some = list(texts)[::17]
    assert lengths.keys() == texts.keys() and all(lengths[d] == len(tok.encode(texts[d], add_special_tokens=False).ids) + 1 for d in some)
    used = sum(lengths.values()) / (len({p.sequence_id for p in pieces if p.window == 2048}) * 2048 + sum(np.unique([(p.sequence_id, p.window) for p in pieces if p.window < 2048], axis=0)[:, 1]))
    assert used > 0.99


def test_odd_rows_pass_through_every_stage(spark, tmp_path):
    rows = [(None, None, None, None, None, 1), (3, "", "en", "s", 0, 2), (3, "", "en", "s", 0, 2), (4, "call +1 (386) 555-3733 " * 3000, None, "s", 5, 3), (None, "x@y.zz", "en", None, 6, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _score int")
    for frame in (docs, docs.limit(0)):
        for _, stage in pipe.STAGES[:-1]:
            out = stage(spark, frame, SF)
            assert out.columns == docs.columns and out.count() <= frame.count()
        assert pipe.STAGES[-1][1](spark, frame, SF).agg({"length": "sum"}).first() is not None
    assert pipe.drop_near_copies(spark, docs, SF).count() == 3


def test_run(spark):
    assert pipe.run(spark, "/root/testdata/sf0.001").count() > 100


def test_packing_workers_remember_less_than_25_mb(spark, monkeypatch):
    asked, pack = [], pipe.packing.pack_documents
    monkeypatch.setattr(pipe.packing, "pack_documents", lambda *args, **how: asked.append(how.get("remembered", ENTRIES)) or pack(*args, **how))
    pipe.pack(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(0), SF)
    assert len(asked) == 1 and 2 * 150 * asked[0] < 25e6
