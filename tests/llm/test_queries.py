"""The ten queries themselves, over a whole small input, against brute force."""

from __future__ import annotations

import hashlib
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tiktoken.load import load_tiktoken_bpe
from tokenizers import Tokenizer

from pathsonde.llm import queries
from tests.llm.test_simhash import plain_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def run(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def test_sharding(spark, docs):
    rows = run(spark, "op1_sharding")
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((d, len(t.encode()) + 8, zlib.crc32(t.encode())) for d, t in docs.items())
    shards = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(24)}
    assert all(slots == list(range(len(slots))) for slots in shards.values()) and sum(map(len, shards.values())) == len(rows)
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_packing(spark, docs):
    tok = Tokenizer.from_file(queries.WORD_BPE)
    ids = {d: [*tok.encode(t, add_special_tokens=False).ids, 1] for d, t in docs.items()}
    rows = run(spark, "op3_packing")
    for d, own in ids.items():
        pieces = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.start)
        assert [p.start for p in pieces] == list(np.cumsum([0, *(p.length for p in pieces)])[:-1]) and sum(p.length for p in pieces) == len(own)
        for p in pieces:
            part = own[p.start : p.start + p.length]
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part)) and p.doc_tokens == len(own)
    for s in {r.sequence_id for r in rows}:
        spans = sorted((r.offset, r.length) for r in rows if r.sequence_id == s)
        assert [a for a, _ in spans] == list(np.cumsum([0, *(n for _, n in spans)])[:-1]) and sum(n for _, n in spans) <= 2048


def test_simhash(spark, docs):
    def fingerprint(text):
        words = text.encode().lower().split()
        parts = [words[i : i + 3] for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(b" ".join(p), 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = {d: fingerprint(t) for d, t in docs.items()}
    ids = list(fps)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (fps[a] ^ fps[b]).bit_count() <= 2]
    want, least = plain_components(ids, links), {}
    for d, root in want.items():
        least[root] = min(least.get(root, d), d)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in run(spark, "op4_simhash")} == {(d, f"{fps[d]:016x}", least[want[d]]) for d in ids}


def test_flac(spark, docs):
    rows = {r.doc_id: r for r in run(spark, "op6_flac")}
    assert rows.keys() == docs.keys()
    for d, t in docs.items():
        raw = t.encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = rows[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        assert r.media_bytes > 0 and len(r.media_sha256) == 64 and r.feature


def test_toxicity(spark, docs):
    rows = run(spark, "op7_toxicity")
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_toxicity_on_held_out_rows(spark):
    where = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{where}/labels.parquet").collect()}
    got = [(r.score, labels[r.doc_id]) for r in queries.op7_toxicity(spark, where).filter("held_out").collect() if labels.get(r.doc_id) is not None]
    pos, neg = [s for s, y in got if y == 1], [s for s, y in got if y == 0]
    auc = np.mean([[(p > n) + 0.5 * (p == n) for n in neg] for p in pos])
    assert auc > 0.97 and sum(s >= 0.5 for s in pos) > 0.88 * len(pos) and sum(s >= 0.5 for s in neg) < 0.01 * len(neg)


def test_embeddings(spark, tmp_path):
    """The sample vectors, some of them again with a little noise, some as they are, and unusable ones."""
    rng = np.random.default_rng(5)
    own = [np.array(r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    own += [v + rng.normal(0, s, len(v)) * np.linalg.norm(v) / 8 for v in own[:120] for s in (0.1, 0.25, 0.33)] + own[:9]
    rows = [(3 * i + 1, v.tolist()) for i, v in enumerate(own)] + [(2, None), (5, [0.0] * 64), (8, [float("nan")] * 64), (11, [None] * 64), (14, [])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    vectors = spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()
    fine = {r.vec_id: np.array(r.embedding, dtype=float) for r in vectors if r.vec_id % 3 == 1}
    ids = list(fine)
    unit = np.stack([v / np.linalg.norm(v) for v in fine.values()])
    links = [(ids[i], ids[j]) for i, j in np.argwhere(np.triu(unit @ unit.T >= 0.95, 1))]
    groups, least = plain_components([r.vec_id for r in vectors], links), {}
    for d, root in groups.items():
        least[root] = min(least.get(root, d), d)
    want = {(r.vec_id, sum(r.vec_id in x for x in links), least[groups[r.vec_id]], least[groups[r.vec_id]] == r.vec_id) for r in vectors}
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in queries.op8_embeddings(spark, str(tmp_path)).collect()} == want and len(links) > 200
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert set(duck.execute(queries.ORACLE_SQL["op8_embeddings"]).fetchall()) == want


def test_byte_bpe(spark, docs):
    enc = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(queries.BYTE_BPE), special_tokens={})
    rows = {r.doc_id: r for r in run(spark, "op9_byte_bpe")}
    assert rows.keys() == docs.keys()
    for d, t in docs.items():
        ids = enc.encode_ordinary(t)
        assert (rows[d].n_tokens, rows[d].ids_sha256, rows[d].decoded_sha256) == (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(t))


def test_chat(spark):
    said = r"\### Assistant: </turn> ok"
    by: dict = {-7: [(0, "user", said), (1, "assistant", said)]}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    rows = {r.conv_id: r for r in run(spark, "op10_chat")}
    assert rows.keys() == by.keys()
    for c, turns in by.items():
        own = sorted(turns)
        loss = "".join(t for _, role, t in own if role == "assistant")
        assert (rows[c].n_turns, rows[c].turns_sha256) == (len(own), sha("".join(f"{role}\n{t}\n" for _, role, t in own)))
        assert (rows[c].loss_chars, rows[c].loss_sha256) == (len(loss), sha(loss)) and rows[c].formatted_chars >= sum(len(t) for _, _, t in own)
