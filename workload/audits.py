"""Answers, claims, charts and reports.

Each customer stands for a question: its answer states two percentages and two
chart files, some of them wrong on purpose, and its evidence is the numbers
computed from its order lines.
"""

from pyspark.sql import functions as F

from ledgerscope.functions.money import percent_of
from ledgerscope.functions.text import CHART_SLUG_LENGTH, REPORT_SLUG_LENGTH, slug
from ledgerscope.operators.audit import (
    audit_answers, evidence_long, extract_claims, supported_claims, unsupported_charts, unsupported_claims,
)
from ledgerscope.plans.reports import rejected_questions, report_documents
from ledgerscope.sources.star import read_table, sales
from workload.registry import register, with_sales

EVIDENCE_COLUMNS = ("lines", "revenue", "margin", "discounted")


def _facts(spark, sf_dir):
    totals = sales(spark, sf_dir, "customer_id", "revenue", "profit", "discount").groupBy("customer_id").agg(
        F.count("*").alias("lines"),
        F.sum("revenue").cast("double").alias("revenue"),
        percent_of(F.sum("profit"), F.sum("revenue")).alias("margin"),
        percent_of(F.count("discount"), F.count("*")).alias("discounted"),
    )
    return totals


def _two_places(number):
    """The number cut to two decimals, as text."""
    cents = F.floor(number * 100)
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def _answers(facts):
    key = F.col("customer_id")
    name = key.cast("string")
    margin = F.col("margin") + F.when(key % 7 == 0, 3.0).otherwise(0.0)
    sign = F.when(key % 11 == 0, "-").otherwise("")
    chart = F.when(key % 13 == 0, "Customer_").otherwise("customer_")
    text = F.concat(
        F.lit("Customer "), name, F.lit(" placed "), F.col("lines").cast("string"), F.lit(" lines.\nThe margin was "),
        sign, _two_places(margin), F.lit("% and "), _two_places(F.col("discounted")),
        F.lit(" % of the lines had a discount.\nCharts:\n- "), chart, name, F.lit("_margin.png\n- customer_"),
        name, F.when(key % 5 == 0, "_forecast.png").otherwise("_margin.png"),
    )
    return facts.select(key.alias("question_id"), text.alias("answer"))


def _charts(facts):
    key = F.col("customer_id")
    return facts.select(
        key.alias("question_id"),
        F.concat(F.lit("customer_"), key.cast("string"), F.lit("_margin.png")).alias("filename"),
        F.when(key % 3 == 0, "error").otherwise("success").alias("status"),
    )


FACTS_SQL = """
, totals AS (SELECT customer_id, count(*) AS lines, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(profit) AS DOUBLE) AS profit,
                    CAST(count(discount) AS DOUBLE) AS filled FROM sales GROUP BY 1),
facts AS (SELECT customer_id, lines, revenue, profit / nullif(revenue, 0) * 100 AS margin,
                 filled / CAST(lines AS DOUBLE) * 100 AS discounted FROM totals),
cents AS (SELECT *, CAST(floor((margin + CASE WHEN customer_id % 7 = 0 THEN 3.0 ELSE 0.0 END) * 100) AS BIGINT) AS margin_cents,
                 CAST(floor(discounted * 100) AS BIGINT) AS discounted_cents FROM facts),
answers AS (SELECT customer_id AS question_id, concat(
    'Customer ', customer_id, ' placed ', lines, ' lines.', chr(10), 'The margin was ', CASE WHEN customer_id % 11 = 0 THEN '-' ELSE '' END,
    margin_cents // 100, '.', lpad(CAST(margin_cents % 100 AS VARCHAR), 2, '0'), '% and ',
    discounted_cents // 100, '.', lpad(CAST(discounted_cents % 100 AS VARCHAR), 2, '0'), ' % of the lines had a discount.', chr(10),
    'Charts:', chr(10), '- ', CASE WHEN customer_id % 13 = 0 THEN 'Customer_' ELSE 'customer_' END, customer_id, '_margin.png', chr(10),
    '- customer_', customer_id, CASE WHEN customer_id % 5 = 0 THEN '_forecast.png' ELSE '_margin.png' END) AS answer FROM cents),
evidence AS (
SELECT customer_id AS question_id, 1 AS seq, 'lines' AS path, CAST(lines AS DOUBLE) AS value FROM facts
UNION ALL SELECT customer_id, 1, 'revenue', revenue FROM facts
UNION ALL SELECT customer_id, 1, 'margin', margin FROM facts
UNION ALL SELECT customer_id, 1, 'discounted', discounted FROM facts),
produced AS (SELECT customer_id AS question_id, concat('customer_', customer_id, '_margin.png') AS filename FROM facts WHERE customer_id % 3 <> 0),
texts AS (SELECT 'answer' AS source, question_id, answer FROM answers UNION ALL SELECT 'document', doc_id, text FROM documents),
lists AS (SELECT source, question_id, regexp_extract_all(replace(answer, '%', '% '),
                 '(?:^|[^\\p{L}\\p{N}_.])(-?[0-9]+(?:\\.[0-9]+)?)[\\s\\p{Z}]*%', 1) AS stated FROM texts),
claims AS (SELECT source, question_id, generate_subscripts(stated, 1) - 1 AS position, unnest(stated) AS stated FROM lists),
numbers AS (SELECT source, question_id, CAST(position AS INT) AS position, stated, CAST(stated AS DOUBLE) AS claim FROM claims),
checked AS (SELECT question_id, position, stated, claim, EXISTS (
    SELECT 1 FROM evidence e WHERE e.question_id = n.question_id
    AND abs(abs(claim) - abs(value)) <= greatest(0.02::DOUBLE, abs(claim) * 0.002::DOUBLE)) AS supported
  FROM numbers n WHERE source = 'answer'),
files AS (SELECT DISTINCT question_id, unnest(regexp_extract_all(answer, '(?i)[\\p{L}\\p{N}_\\-]+\\.png')) AS filename FROM answers),
unproduced AS (SELECT * FROM files ANTI JOIN produced USING (question_id, filename))
"""


@register("evidence_long", with_sales(FACTS_SQL + "SELECT question_id, seq, path, value FROM evidence"))
def evidence(spark, sf_dir):
    return evidence_long(_facts(spark, sf_dir), "customer_id", EVIDENCE_COLUMNS)


@register("claims_extracted", with_sales(FACTS_SQL + "SELECT source, question_id, position, stated, claim FROM numbers"))
def claims_extracted(spark, sf_dir):
    answers = extract_claims(_answers(_facts(spark, sf_dir))).withColumn("source", F.lit("answer"))
    documents = extract_claims(read_table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("source", F.lit("document"))
    return answers.unionByName(documents)


@register("claims_unsupported", with_sales(FACTS_SQL + "SELECT question_id, position, stated, claim FROM checked WHERE NOT supported"))
def claims_unsupported(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    return unsupported_claims(extract_claims(_answers(facts)), evidence_long(facts, "customer_id", EVIDENCE_COLUMNS))


@register("claims_supported", with_sales(FACTS_SQL + "SELECT question_id, position, stated, claim FROM checked WHERE supported"))
def claims_supported(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    return supported_claims(extract_claims(_answers(facts)), evidence_long(facts, "customer_id", EVIDENCE_COLUMNS))


@register("charts_unsupported", with_sales(FACTS_SQL + "SELECT question_id, filename FROM unproduced"))
def charts_unsupported(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    return unsupported_charts(_answers(facts), _charts(facts))


@register("answer_audit", with_sales(FACTS_SQL + """,
bad_claims AS (SELECT question_id, count(*) AS n, string_agg(concat(stated, '%'), ', ' ORDER BY position) AS items
               FROM checked WHERE NOT supported GROUP BY 1),
bad_files AS (SELECT question_id, count(*) AS n, string_agg(filename, ', ' ORDER BY filename) AS items FROM unproduced GROUP BY 1)
SELECT a.question_id, coalesce(f.n, 0) AS chart_problems, coalesce(c.n, 0) AS claim_problems,
       coalesce(f.items, '') AS unsupported_charts, coalesce(c.items, '') AS unsupported_percentages,
       f.n IS NULL AND c.n IS NULL AS passed
FROM answers a LEFT JOIN bad_claims c ON a.question_id = c.question_id LEFT JOIN bad_files f ON a.question_id = f.question_id"""))
def answer_audit(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    return audit_answers(_answers(facts), evidence_long(facts, "customer_id", EVIDENCE_COLUMNS), _charts(facts))


SLUG_SQL = (
    "left(coalesce(nullif(regexp_replace(regexp_replace(lower({text}), '[^a-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), "
    "'{default}'), {length})"
)


@register("question_slugs", f"""
SELECT conv_id, turn, {SLUG_SQL.format(text='text', default='analysis_report', length=70)} AS report_slug,
       {SLUG_SQL.format(text='text', default='chart', length=80)} AS chart_slug
FROM conversations WHERE role = 'user'""")
def question_slugs(spark, sf_dir):
    asked = read_table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return asked.select(
        "conv_id", "turn",
        slug(F.col("text"), "analysis_report", REPORT_SLUG_LENGTH).alias("report_slug"),
        slug(F.col("text"), "chart", CHART_SLUG_LENGTH).alias("chart_slug"),
    )


def _conversation_reports(spark, sf_dir):
    """A conversation as a question, its last answer, and one step per turn."""
    turns = read_table(spark, sf_dir, "conversations")
    asked, answered = F.col("role") == "user", F.col("role") == "assistant"
    questions = turns.groupBy("conv_id").agg(
        F.min_by("text", F.when(asked, F.col("turn"))).alias("question"),
        F.max_by("text", F.when(answered, F.col("turn"))).alias("answer"),
    )
    questions = questions.select(F.col("conv_id").alias("question_id"), "question", "answer", F.lit("conversations").alias("dataset"))
    short = F.length("text") < 60
    steps = turns.select(
        F.col("conv_id").alias("question_id"),
        (F.col("turn") + 1).alias("seq"),
        F.col("role").alias("tool"),
        F.concat(F.lit("{'chars': "), F.length("text").cast("string"), F.lit("}")).alias("arguments"),
        F.when(short, "error").otherwise("success").alias("status"),
        F.when(short, "short turn").alias("message"),
    )
    return questions, steps


REPORT_SQL = """
WITH questions AS (SELECT conv_id AS question_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS question,
                          arg_max(text, turn) FILTER (WHERE role = 'assistant') AS answer FROM conversations GROUP BY 1),
bare AS (SELECT question_id, regexp_replace(question, '^[[:space:]\\p{{Z}}]+|[[:space:]\\p{{Z}}]+$', '', 'g') AS question,
                regexp_replace(answer, '^[[:space:]\\p{{Z}}]+|[[:space:]\\p{{Z}}]+$', '', 'g') AS answer FROM questions),
valid AS (SELECT * FROM bare WHERE coalesce(question, '') <> '' AND coalesce(answer, '') <> ''),
named AS (SELECT *, concat('20260915_103000_', {slug}, '.md') AS filename FROM valid)
SELECT question_id, CAST(0 AS BIGINT) AS seq, filename, concat('# Analysis Report', chr(10, 10), '**Generated:** 2026-09-15 10:30:00', chr(10, 10),
       '**Dataset:** `conversations`', chr(10, 10), '---', chr(10, 10), '## Question', chr(10, 10), question, chr(10, 10), '---', chr(10, 10),
       '## Final Analysis', chr(10, 10), answer, chr(10, 10), '---', chr(10, 10), '## Analytical Tools Used', chr(10)) AS block FROM named
UNION ALL
SELECT question_id, CAST(turn + 1 AS BIGINT), filename, concat('### ', turn + 1, '. `', role, '`', chr(10, 10), '**Arguments**', chr(10, 10), '```text', chr(10),
       '{{''chars'': ', length(text), '}}', chr(10), '```', chr(10, 10), '**Status:** ',
       CASE WHEN length(text) < 60 THEN 'Error — short turn' ELSE 'Completed' END, chr(10))
FROM conversations JOIN named ON conv_id = question_id"""


@register("report_documents", REPORT_SQL.format(
    slug=SLUG_SQL.format(text="question", default="analysis_report", length=70)).replace("chr(10, 10)", "chr(10), chr(10)"))
def reports(spark, sf_dir):
    questions, steps = _conversation_reports(spark, sf_dir)
    return report_documents(questions, steps, "2026-09-15 10:30:00")


@register("report_rejects", """
WITH questions AS (SELECT conv_id AS question_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS question,
                          arg_max(text, turn) FILTER (WHERE role = 'assistant') AS answer FROM conversations GROUP BY 1),
bare AS (SELECT question_id, regexp_replace(question, '[[:space:]\\p{Z}]+', '', 'g') AS question, regexp_replace(answer, '[[:space:]\\p{Z}]+', '', 'g') AS answer FROM questions)
SELECT question_id, CASE WHEN coalesce(question, '') = '' THEN 'question is empty' ELSE 'answer is empty' END AS reason
FROM bare WHERE coalesce(question, '') = '' OR coalesce(answer, '') = ''""")
def report_rejects(spark, sf_dir):
    return rejected_questions(_conversation_reports(spark, sf_dir)[0])
