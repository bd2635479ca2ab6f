import corpus_pipeline
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerscope.llm.common import written

FOLDER = "/root/testdata/sf0.001"


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and sorted(int(n[2:].split("_")[0]) for n in names if n[:2] == "op" and n[2].isdigit()) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "tokens"]


def test_stages_and_run_agree(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, FOLDER))
        counts.append(docs.count())
        if name != "tokens":
            assert docs.columns == columns
            assert docs.where("n_chars <> length(text)").isEmpty()
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    assert docs.where(~F.col("round_trip")).isEmpty()
    ran = corpus_pipeline.run(spark, FOLDER)
    assert ran.columns == docs.columns
    key = ["doc_id", "text", "n_tokens"]
    assert ran.select(key).exceptAll(docs.select(key)).isEmpty() and ran.count() == counts[-1]


def test_stages_on_odd_documents(spark, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        plain = docs.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
        for _, stage in corpus_pipeline.STAGES:
            plain = written(stage(spark, plain, FOLDER))
        assert plain.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "n_tokens", "round_trip"]
