"""Claims in written answers against the numbers and charts that were computed.

Tables: ``answers(question_id, answer)`` with one answer per question,
``evidence(question_id, seq, path, value)`` and
``charts(question_id, filename, status)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.functions.columns import data_type, numeric, quoted
from ledgerscope.functions.text import CHART_FILE, PERCENTAGE

# A claim may differ from its evidence by this much, or this part of itself.
ABSOLUTE_TOLERANCE = 0.02
RELATIVE_TOLERANCE = 0.002

# Bands are half a tolerance wide, so evidence within it lies at most 3 bands away.
NEAR_BANDS = range(-3, 4)


def extract_claims(texts: DataFrame, question: str = "question_id", text: str = "answer") -> DataFrame:
    """``(question_id, position, stated, claim)`` for each percentage of each text."""
    stated = F.regexp_extract_all(quoted(text), F.lit(PERCENTAGE), 1)
    found = texts.where(quoted(text).contains("%")).select(
        quoted(question).alias("question_id"), F.posexplode(stated).alias("position", "stated")
    )
    return found.withColumn("claim", F.col("stated").cast("double"))


def evidence_long(results: DataFrame, question: str, columns: Sequence[str], seq: int = 1) -> DataFrame:
    """The numbers of a result as ``(question_id, seq, path, value)``, one row each. A flag is no number."""
    columns = [name for name in columns if not isinstance(data_type(results, name), T.BooleanType)]
    numbers = results.select(
        quoted(question).alias("question_id"), *(numeric(results, name).cast("double").alias(name) for name in columns)
    )
    long = numbers.unpivot(["question_id"], [quoted(name) for name in columns], "path", "value")
    return long.where(F.col("value").isNotNull()).select("question_id", F.lit(seq).alias("seq"), "path", "value")


def _band(size: Column) -> Column:
    """Position on a scale where one tolerance is two units, everywhere.

    The tolerance is constant up to ``turn`` and proportional above, so the
    scale is linear below it and logarithmic above.
    """
    turn = ABSOLUTE_TOLERANCE / RELATIVE_TOLERANCE
    above = turn / ABSOLUTE_TOLERANCE + F.log(size / turn) / RELATIVE_TOLERANCE
    return F.floor(2 * F.when(size <= turn, size / ABSOLUTE_TOLERANCE).otherwise(above))


def _near_evidence(evidence: DataFrame) -> DataFrame:
    """Smallest and largest number of each band, listed under every band near it.

    They are all a claim needs: its nearest evidence in a lower band is that
    band's largest number and in a higher band the smallest, and any number in
    its own band is near enough. Signs are ignored, as a fall may be stated as
    a positive number.
    """
    size = F.abs(F.col("value"))
    finite = size < float("inf")  # false for null, infinity and NaN
    bands = (
        evidence.where(finite)
        .groupBy(F.col("question_id"), _band(size).alias("band"))
        .agg(F.min(size).alias("lowest"), F.max(size).alias("highest"))
    )
    near = F.explode(F.array(*(F.col("band") + step for step in NEAR_BANDS))).alias("near_band")
    return bands.select(F.col("question_id").alias("evidence_question"), near, "lowest", "highest")


def _match(claims: DataFrame, evidence: DataFrame, how: str) -> DataFrame:
    size = F.abs(F.col("claim"))
    tolerance = F.greatest(F.lit(ABSOLUTE_TOLERANCE), size * RELATIVE_TOLERANCE)
    distance = F.least(F.abs(size - F.col("lowest")), F.abs(size - F.col("highest")))
    same_band = (F.col("question_id") == F.col("evidence_question")) & (F.col("claim_band") == F.col("near_band"))
    banded = claims.withColumn("claim_band", _band(size))
    return banded.join(_near_evidence(evidence), same_band & (distance <= tolerance), how).drop("claim_band")


def unsupported_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims without a number of the same question within the tolerance, signed or unsigned.

    An equality join on question and band: no claim meets all evidence of its
    question, and one question with much of the data is spread over its bands.
    """
    return _match(claims, evidence, "left_anti")


def supported_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims with such a number."""
    return _match(claims, evidence, "left_semi")


def mentioned_charts(answers: DataFrame) -> DataFrame:
    """Distinct ``(question_id, filename)`` of the chart files named in answers."""
    names = F.regexp_extract_all(F.col("answer"), F.lit(CHART_FILE), 1)
    return answers.select("question_id", F.explode(F.array_distinct(names)).alias("filename")).distinct()


def unsupported_charts(answers: DataFrame, charts: DataFrame) -> DataFrame:
    """Chart files named in an answer but not produced for it; the case of the name counts."""
    failed = F.coalesce(F.col("status") == "error", F.lit(False))
    produced = charts.where(~failed).select("question_id", "filename")
    return mentioned_charts(answers).join(produced, ["question_id", "filename"], "left_anti")


def audit_answers(answers: DataFrame, evidence: DataFrame, charts: DataFrame) -> DataFrame:
    """One row per answer: its unsupported chart files and percentages, and whether it passes.

    The lists are gathered per question. They come from one answer's text and
    are no longer than it.
    """
    claims = unsupported_claims(extract_claims(answers), evidence).select(
        "question_id", F.lit("claim").alias("kind"), F.col("position").alias("place"),
        F.concat(F.col("stated"), F.lit("%")).alias("item"),
    )
    files = unsupported_charts(answers, charts).select(
        "question_id", F.lit("chart").alias("kind"), F.lit(0).alias("place"), F.col("filename").alias("item")
    )
    problems = claims.unionByName(files)

    def listed(kind: str) -> Column:
        items = F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("place", "item"))))
        return F.array_join(F.transform(items, lambda entry: entry.getField("item")), ", ")

    per_question = problems.groupBy("question_id").agg(
        F.count_if(F.col("kind") == "chart").alias("chart_problems"), F.count_if(F.col("kind") == "claim").alias("claim_problems"),
        listed("chart").alias("charts"), listed("claim").alias("claims"),
    )
    return answers.select("question_id").join(per_question, "question_id", "left").select(
        "question_id",
        F.coalesce(F.col("chart_problems"), F.lit(0)).alias("chart_problems"),
        F.coalesce(F.col("claim_problems"), F.lit(0)).alias("claim_problems"),
        F.coalesce(F.col("charts"), F.lit("")).alias("unsupported_charts"),
        F.coalesce(F.col("claims"), F.lit("")).alias("unsupported_percentages"),
        F.col("chart_problems").isNull().alias("passed"),
    )
