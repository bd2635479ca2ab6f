import random

from pyspark.sql import functions as F

from ledgerscope.operators.audit import (
    audit_answers, evidence_long, extract_claims, supported_claims, unsupported_charts, unsupported_claims,
)

ANSWERS = "question_id bigint, answer string"
EVIDENCE = "question_id bigint, seq int, path string, value double"
CHARTS = "question_id bigint, filename string, status string"


def claims_of(spark, text):
    rows = extract_claims(spark.createDataFrame([(1, text)], ANSWERS)).orderBy("position").collect()
    return [row.claim for row in rows]


def test_extraction(spark):
    assert claims_of(spark, "fell by 15.13%, or -15.1 % in all") == [15.13, -15.1]
    assert claims_of(spark, "1,234% 5%6% x7% v1.5% .5% é9% a-8%") == [234.0, 5.0, 6.0, 8.0]
    assert claims_of(spark, "no numbers %") == []


def audit(spark, answer, numbers=(), charts=()):
    answers = spark.createDataFrame([(1, answer)], ANSWERS)
    evidence = spark.createDataFrame([(1, 1, "p", float(n)) for n in numbers], EVIDENCE)
    produced = spark.createDataFrame([(1, *chart) for chart in charts], CHARTS)
    return audit_answers(answers, evidence, produced).first()


def test_invented_chart(spark):
    row = audit(spark, "Made $796,047.76.\nCharts:\n- category_revenue_comparison.png", [796047.76])
    assert not row.passed and row.unsupported_charts == "category_revenue_comparison.png"


def test_produced_chart(spark):
    assert audit(spark, "see a-b_c.png", charts=[("a-b_c.png", "success")]).passed
    assert audit(spark, "see a-b_c.png", charts=[("a-b_c.png", None)]).passed
    assert not audit(spark, "see a-b_c.png", charts=[("a-b_c.png", "error")]).passed
    assert not audit(spark, "see A-B_c.PNG", charts=[("a-b_c.png", "success")]).passed


def test_unsupported_percentage(spark):
    row = audit(spark, "It contributed 53% of revenue, 20% of cost and 53% again.", [796047.76, 511179.56, 20])
    assert not row.passed and row.unsupported_percentages == "53%, 53%" and row.claim_problems == 2


def test_supported_percentages(spark):
    assert audit(spark, "It contributed 56.32% of revenue.", [56.3201]).passed
    assert audit(spark, "Revenue decreased by 15.13%.", [-15.131117523527692]).passed
    assert audit(spark, "No claims at all.").passed


def test_band_join_equals_brute_force(spark):
    numbers = random.Random(5)
    evidence, claims = [], []
    for question in range(4):
        for _ in range(60):
            value = numbers.choice([0.0, 0.01, 9.98, 10.0, 10.02, numbers.uniform(0, 30), numbers.uniform(0, 5000), 10 ** numbers.uniform(-4, 9)])
            value *= numbers.choice([1, -1])
            evidence.append((question, 1, "p", value))
            for step in (0, 0.0199, 0.02, 0.0201, -0.0199, -0.0201, 0.00199 * value, 0.00201 * value, -0.00199 * value, 0.005 * value):
                claims.append((question, len(claims), "", numbers.choice([1, -1]) * (value + step)))
    evidence += [(0, 2, "inf", float("inf")), (0, 2, "nan", float("nan")), (1, 2, "none", None)]
    c = spark.createDataFrame(claims, "question_id int, position int, stated string, claim double")
    e = spark.createDataFrame(evidence, "question_id int, seq int, path string, value double")
    by_question = {q: [abs(v) for k, _, _, v in evidence if k == q and v is not None and abs(v) < float("inf")] for q in range(4)}
    expected = {
        position
        for question, position, _, claim in claims
        if any(abs(abs(claim) - v) <= max(0.02, abs(claim) * 0.002) for v in by_question[question])
    }
    assert {row.position for row in supported_claims(c, e).collect()} == expected
    assert {row.position for row in unsupported_claims(c, e).collect()} == set(range(len(claims))) - expected
    assert 0 < len(expected) < len(claims)


def test_claim_join_is_an_equality_join(spark):
    c = spark.createDataFrame([(1, 0, "5", 5.0)], "question_id int, position int, stated string, claim double")
    e = spark.createDataFrame([(1, 1, "p", 5.0)], EVIDENCE)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = unsupported_claims(c, e)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin [cast(question_id" in plan or "SortMergeJoin [question_id" in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_one_hot_question(spark):
    """One question holds nearly all rows; no band of it holds many."""
    e = spark.range(50_000).select(F.lit(1).alias("question_id"), F.lit(1).alias("seq"), F.lit("p").alias("path"), (F.col("id") * 1.0).alias("value"))
    c = spark.range(50_000).select(F.lit(1).alias("question_id"), F.col("id").cast("int").alias("position"), F.lit("").alias("stated"), (F.col("id") + 0.5).alias("claim"))
    found = unsupported_claims(c, e).agg(F.count("*"), F.max("claim")).first()
    assert tuple(found) == (250, 249.5)  # 0.5 is within 0.2 % of itself from 250.5 on


def test_evidence_long(spark):
    results = spark.createDataFrame([(1, 2.5, True, None)], "q int, ratio double, flag boolean, missing double")
    rows = evidence_long(results, "q", ["ratio", "missing"]).collect()
    assert [tuple(row) for row in rows] == [(1, 1, "ratio", 2.5)]


def test_charts_of_two_answers(spark):
    answers = spark.createDataFrame([(1, "x.png x.png y.png"), (2, "x.png")], ANSWERS)
    charts = spark.createDataFrame([(1, "x.png", "success")], CHARTS)
    assert sorted(map(tuple, unsupported_charts(answers, charts).collect())) == [(1, "y.png"), (2, "x.png")]
