"""Reports, check reports and CSV tables as files: written by the sinks, then read back."""

from pyspark.sql import functions as F

from ledgerscope.plans import questions
from ledgerscope.plans.checks import check_sections, judge, write_check_report
from ledgerscope.plans.reports import report_documents, write_report_files
from ledgerscope.sources.scratch import scratch_folder
from ledgerscope.sources.star import read_table
from ledgerscope.sources.tables import NULL_TOKENS, read_sales, write_csv
from workload.audits import REPORT_SQL, SLUG_SQL, _conversation_reports
from workload.profiles import EVIDENCE_SQL, JUDGED_SQL, _evidence, _rules, check_report  # noqa: F401
from workload.registry import QUERIES, register, with_sales

GENERATED = "2026-09-15 10:30:00"
BLOCKS_SQL = REPORT_SQL.format(slug=SLUG_SQL.format(text="question", default="analysis_report", length=70)).replace("chr(10, 10)", "chr(10), chr(10)")


def _read_back(spark, folder):
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.regexp_extract("path", r"[^/]+$", 0).alias("filename"), F.col("content").cast("string").alias("text"))


@register("report_files", f"""
WITH blocks AS ({BLOCKS_SQL}),
reports AS (SELECT question_id, filename, string_agg(block, '' ORDER BY seq) AS text FROM blocks GROUP BY 1, 2)
SELECT CASE WHEN question_id = min(question_id) OVER (PARTITION BY filename) THEN filename
            ELSE concat(regexp_replace(filename, '[.]md$', '_'), question_id, '.md') END AS filename, text FROM reports""")
def report_files(spark, sf_dir):
    asked, steps = _conversation_reports(spark, sf_dir)
    folder = scratch_folder(spark)
    write_report_files(report_documents(asked, steps, GENERATED), folder)
    return _read_back(spark, folder)


@register("check_report_file", f"""
WITH sections AS ({QUERIES['check_report'].sql}),
texts AS (SELECT string_agg(concat(chr(10), section), '' ORDER BY number) AS body,
                 count(*) FILTER (WHERE section LIKE '%**Status:** PASS%') AS passed, count(*) AS total FROM sections)
SELECT 'required_query_evaluation_20260915_103000.md' AS filename,
       concat('# Required Query Evaluation', chr(10), chr(10), '**Generated:** {GENERATED}', chr(10), chr(10), '**Dataset:** `sales`', chr(10), chr(10),
              '**Overall:** ', passed, '/', total, ' PASS', chr(10), chr(10), '---', chr(10), body) AS text FROM texts""")
def check_report_file(spark, sf_dir):
    evidence = _evidence(spark, sf_dir)
    judged = judge(evidence, _rules(spark))
    folder = scratch_folder(spark)
    write_check_report(check_sections(evidence, judged, questions.QUESTIONS), judged, folder, "sales", GENERATED)
    return _read_back(spark, folder)


@register("csv_round_trip", f"""
SELECT c_custkey, CASE WHEN c_custkey % 60 < {len(NULL_TOKENS)} THEN NULL ELSE concat(c_name, ', "', c_mktsegment, '"') END AS label,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS balance FROM customer""")
def csv_round_trip(spark, sf_dir):
    """Customers go through the CSV sink and source; each text for a missing cell stands in some rows, and commas and quotes in the others."""
    key = F.col("c_custkey")
    token = F.element_at(F.array(*map(F.lit, NULL_TOKENS)), (key % 60 + 1).cast("int"))
    label = F.concat(F.col("c_name"), F.lit(', "'), F.col("c_mktsegment"), F.lit('"'))
    rows = read_table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(key % 60 < len(NULL_TOKENS), token).otherwise(label).alias("label"), F.when(key % 7 != 0, F.col("c_acctbal")).alias("balance")
    )
    folder = scratch_folder(spark)
    write_csv(rows, folder)
    return read_sales(spark, folder, schema="c_custkey bigint, label string, balance double")
