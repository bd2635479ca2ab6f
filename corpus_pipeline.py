"""A corpus pipeline: documents in a known language, without repeated lines, near copies and benchmark items, as tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet
and read again for the next one. All but the last return the columns of ``documents``; the last adds
``ids``, ``n_tokens`` and ``round_trip`` (the ids decode to the text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm import bpe, decontaminate, langid, lines, simhash
from ledgerscope.llm.common import register, table, written
from ledgerscope.llm.queries import tokenizer_path


ROWS_AT_ONCE = "1000"  # whole documents that go to a Python worker together


def _in_small_batches(spark: SparkSession) -> None:
    """Documents have kilobytes each; Spark's 10,000 rows a batch would hold tens of megabytes several times over."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_AT_ONCE)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents and keeps those whose language is accepted; the label stays as it was."""
    _in_small_batches(spark)
    judged = langid.identify(docs, langid.learn(docs))
    return judged.where("accepted").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; a document that has lost all lines stays, with an empty text."""
    return lines.without_repeats(docs, least=1).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked SimHash fingerprints stays, that of the smallest doc_id."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _in_small_batches(spark)
    coded = bpe.encode(docs, tokenizer_path(), round_trip=True)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select(*docs.columns, "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

# No SQL states the language models, the component search or the merges.
ORACLE_SQL = None


@register("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
