"""The corpus pipeline: toxicity, line dedup, near-dedup, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept; all but the
last return the columns of ``documents``. ``run`` writes each stage's result to the shared folder and
reads it again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathsonde.llm import linededup, neardedup, packing, pii, toxicity
from pathsonde.llm.common import cut, documents, free_name, release

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
#: Words that a packing worker remembers in each of two generations: beside a heap that the stages before have filled, there is less room than for packing alone.
REMEMBERED = 75_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least 0.5 go; the model learns from the labels beside them.

    Null and empty texts have a score like any other; copies have equal scores and go or stay together. Rows with a
    null id are scored, but never learned from. Columns of any name stay as they are. An empty table gives no rows.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs, "_score")
    return toxicity.score(docs, model, out=score).filter(F.col(score) < 0.5).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat across documents stay in the one of the largest id; documents stay, with n_chars counted anew.

    Null texts stay null, with their n_chars. Rows of one id are one document, and a null id is below all others;
    repeated rows are treated alike. Columns of any name stay. An empty table gives no rows.
    """
    out = linededup.dedup_lines(docs)
    return out.withColumn("n_chars", _chars(out)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document of the least id stays.

    Null and empty texts are one group. A null id is above all others; of rows of equal id one stays. Columns of
    any name stay. An empty table gives no rows.
    """
    return neardedup.drop_near_duplicates(docs)


def drop_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, secrets and terms that give them away are replaced; n_chars is counted anew.

    Null texts stay null, with their n_chars; ids are not read. Copies are cleaned alike and count once for the terms. Columns
    of any name stay. An empty table gives no rows.
    """
    spans = free_name(docs, "_spans")
    out = pii.sanitise(pii.find_spans(docs, out=spans), spans=spans)
    return out.withColumn("n_chars", _chars(out)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048 ids.

    A null or empty text is its final id alone. Rows are packed one by one, whatever their ids, so copies and ties are
    packed as often as they occur. An empty table gives no rows.
    """
    out = packing.pack_documents(docs, WORD_BPE, remembered=REMEMBERED)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step_group")


def _chars(df: DataFrame):
    kind = df.schema["n_chars"].dataType
    return F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast(kind)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("SimHash near-dedup", drop_near_copies), ("PII", drop_personal_data), ("packing", pack)]

#: Training, fingerprints, terms and token ids are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), []
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        release(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
