"""The corpus pipeline: quality classifier, line dedup, n-gram Jaccard join,
mixing sources to target weights, BPE encoding. Every stage is written as
Parquet in the shared folder and reread as the next stage's documents; all but
the last return the columns of documents.

Repeated rows: rows with equal doc_id are one document to stages 2 and 3, and
all its rows stay or go together. Rows without doc_id pass stages 2 and 3."""

from __future__ import annotations

import public_tokenizers
from motorisk.llm import bpe, line_dedup, mixing, ngram_join, quality
from motorisk.llm.common import Stages, free_name, table
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The draws hash with functions DuckDB lacks and the joins iterate; the stages are tested against brute force.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents the importance resampling rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: later lines that match an earlier one go; n_chars follows the text."""
    return line_dedup.dedup_lines(docs, short=True).withColumn("n_chars", F.length("text").cast("long"))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of every group of near copies the document with the smallest id stays."""
    found = ngram_join.jaccard_components(docs)
    return docs.join(found.where("component_id <> doc_id").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: every document at least once, small sources again up to the repetition limit."""
    epoch, order = (free_name(docs.columns, x) for x in ("epoch", "order_hash"))
    return mixing.mix(docs, epoch=epoch, order=order).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: token ids of every row."""
    coded = bpe.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality classifier", keep_quality), ("line dedup", dedup_lines), ("n-gram Jaccard join", dedup_documents),
          ("mixing sources", mix_sources), ("BPE encoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs, st = table(spark, sf_dir, "documents"), Stages(spark)
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = st.write(docs, name.replace(" ", "_"))
            st.drop(before)
    return docs
