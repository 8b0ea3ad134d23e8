"""The queries of this package: one per operator, over whole tables, with the columns asked for."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathsonde.llm import bpe, chat, embeddings, flac, linededup, packing, pii, sharding, simhash, toxicity
from pathsonde.llm.common import documents

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shuffle_into_shards(documents(spark, sf_dir), shards=24, stable=True)
    return out.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_spans(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("spans", pii.is_base)
    count = lambda k: F.size(pii.of_kind(F.col("spans"), k)).cast("long").alias(f"n_{k}")
    return out.select(
        "doc_id",
        *[count(k) for k in pii.BASE],
        F.sha2(pii.listing(base), 256).alias("base_sha256"),
        pii.listing(F.col("spans")).alias("spans"),
        count("secret"),
        count("generalise"),
        count("remove"),
        F.size(F.filter("spans", lambda s: s["kind"].isin(*pii.PATTERNS))).cast("long").alias("n_personal"),
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(documents(spark, sf_dir), WORD_BPE)
    return out.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step_group"
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(documents(spark, sf_dir), words=3, radius=2)
    return out.select("doc_id", simhash.hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = flac.decode_column(flac.encode_column(documents(spark, sf_dir).select("doc_id", "text")))
    size = F.octet_length("payload")
    return out.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substr(F.col("payload"), size - 63)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = toxicity.score(docs, model).drop("text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.95)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    ids = bpe.bpe_encode(docs, BYTE_BPE, public_tokenizers.PATTERN, drop=("text",))
    both = bpe.bpe_decode(ids, BYTE_BPE)
    return both.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(more)
    out = chat.read_back(chat.format_conversations(rows))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


QUERIES = {f.__name__: f for f in (op1_sharding, op2_pii, op3_packing, op4_simhash, op5_line_dedup, op6_flac, op7_toxicity, op8_embeddings, op9_byte_bpe, op10_chat)}

LINE_DEDUP_SQL = """WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
  n AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d),
  k AS (SELECT doc_id, i, l[i] AS line, translate(trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM n),
  g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
  m AS (SELECT k.doc_id, i, line, keeper IS NOT NULL AND keeper <> k.doc_id AS gone FROM k LEFT JOIN g ON g.key = k.key)
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""

EMBEDDINGS_SQL = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  fine AS MATERIALIZED (SELECT vec_id, list_filter(e, lambda x: x IS NOT NULL AND isfinite(x)) AS e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
  links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
  reach AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT l.w, r.c FROM reach r JOIN links l ON l.u = r.vec_id),
  n AS (SELECT u, count(*) AS n FROM links GROUP BY u)
  SELECT vec_id, coalesce(any_value(n.n), 0) AS n_links, min(c) AS component_id, vec_id = min(c) AS kept FROM reach LEFT JOIN n ON n.u = vec_id GROUP BY vec_id"""

#: The others have models, hashes, formats or counts of windows that SQL has no words for; tests/llm/test_queries.py holds them against brute force.
ORACLE_SQL: dict[str, str] = {"op5_line_dedup": LINE_DEDUP_SQL, "op8_embeddings": EMBEDDINGS_SQL}
