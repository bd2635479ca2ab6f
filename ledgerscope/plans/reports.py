"""Report documents: question, answer and the numbered steps behind it.

Tables: ``questions(question_id, question, answer, dataset)`` and
``steps(question_id, seq, tool, arguments, status, message)`` with ``seq``
counting 1, 2, ... within a question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions.text import REPORT_SLUG_LENGTH, slug
from ledgerscope.sources.text_files import write_pieces

BAND = 65_536  # blocks of a report that are put in order together
NO_STEPS = "No analytical tools were used.\n"
EDGE_SPACE = r"^[\t-\r \x1c-\x1f\x85\p{Z}]+|[\t-\r \x1c-\x1f\x85\p{Z}]+$"


def _stripped(text: str) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(F.col(text), EDGE_SPACE, "")


def _blank(text: str) -> Column:
    return F.coalesce(_stripped(text), F.lit("")) == ""


def rejected_questions(questions: DataFrame) -> DataFrame:
    """Questions that get no report, with the reason."""
    reason = (
        F.when(_blank("question"), "question is empty")
        .when(_blank("answer"), "answer is empty")
        .when(_blank("dataset"), "dataset name is empty")
    )
    return questions.select("question_id", reason.alias("reason")).where(F.col("reason").isNotNull())


def step_block(seq: Column, tool: Column, arguments: Column, status: Column, message: Column) -> Column:
    """Text of one step; its status is an error or completed. A step without a number shows a dash."""
    outcome = F.when(
        status == "error", F.concat(F.lit("Error — "), F.coalesce(message, F.lit("Unknown error")))
    ).otherwise("Completed")
    return F.concat(
        F.lit("### "), F.coalesce(seq.cast("string"), F.lit("–")), F.lit(". `"), F.coalesce(tool, F.lit("unknown_tool")),
        F.lit("`\n\n**Arguments**\n\n```text\n"), F.coalesce(arguments, F.lit("{}")),
        F.lit("\n```\n\n**Status:** "), outcome, F.lit("\n"),
    )


def report_documents(questions: DataFrame, steps: DataFrame, generated: str) -> DataFrame:
    """``(question_id, seq, filename, block)``: the blocks of each report in order of ``seq``, head first (0).

    A report is its blocks one after another; :func:`write_reports` puts them into files. No group
    is gathered, so a question may have any number of steps. ``generated`` is ``yyyy-MM-dd HH:mm:ss`` text.
    """
    stamp = generated.replace("-", "").replace(":", "").replace(" ", "_")
    name = F.concat(F.lit(f"{stamp}_"), slug(F.col("question"), "analysis_report", REPORT_SLUG_LENGTH), F.lit(".md"))
    valid = questions.where(~(_blank("question") | _blank("answer") | _blank("dataset"))).select(
        "question_id", name.alias("filename"), *(_stripped(c).alias(c) for c in ("question", "answer", "dataset"))
    )
    head = F.concat(
        F.lit(f"# Analysis Report\n\n**Generated:** {generated}\n\n**Dataset:** `"), F.col("dataset"),
        F.lit("`\n\n---\n\n## Question\n\n"), F.col("question"),
        F.lit("\n\n---\n\n## Final Analysis\n\n"), F.col("answer"),
        F.lit("\n\n---\n\n## Analytical Tools Used\n"),
    )
    heads = valid.select("question_id", F.lit(0).cast("bigint").alias("seq"), "filename", head.alias("block"))
    block = step_block(F.col("seq"), F.col("tool"), F.col("arguments"), F.col("status"), F.col("message"))
    blocks = steps.join(valid.select("question_id", "filename"), "question_id").select(
        "question_id", F.col("seq").cast("bigint").alias("seq"), "filename", block.alias("block")
    )
    bare = valid.join(steps.select("question_id"), "question_id", "left_anti")
    notes = bare.select("question_id", F.lit(1).cast("bigint").alias("seq"), "filename", F.lit(NO_STEPS).alias("block"))
    return heads.unionByName(blocks).unionByName(notes)


def write_reports(documents: DataFrame, path: str) -> None:
    """One folder for each report with its text; a task writes a report block by block and holds none whole."""
    ordered = documents.repartition("question_id").sortWithinPartitions("question_id", "filename", "seq")
    folder = F.concat_ws("_", F.col("question_id").cast("string"), "filename")
    ordered.select(folder.alias("report"), F.col("block").alias("value")).write.partitionBy("report").text(path)


def report_pieces(documents: DataFrame) -> DataFrame:
    """``(name, at, piece)``: the blocks of :func:`report_documents` with the file of their report and the byte where they start.

    Blocks are put in order within bands of ``BAND`` numbers; a band starts after the bytes of the bands before
    it, so a report of any length is spread over tasks. Of reports with the same file name the one of the smallest
    question_id keeps it, the others get their id at its end. Blocks of equal number stand by their text, those without a number last.
    """
    names = documents.where("seq = 0").select("question_id", "filename")
    firsts = names.groupBy("filename").agg(F.min("question_id").alias("first_id"))
    own = F.concat(F.regexp_replace("filename", r"\.md$", "_"), F.col("question_id").cast("string"), F.lit(".md"))
    files = names.join(firsts, "filename").select("question_id", F.when(F.col("question_id") == F.col("first_id"), F.col("filename")).otherwise(own).alias("name"))

    band = F.coalesce(F.floor(F.col("seq") / BAND), F.lit((1 << 31) - 1)).cast("bigint")
    sized = documents.select("question_id", "seq", F.coalesce("block", F.lit("")).alias("block"), band.alias("band"), F.octet_length(F.coalesce("block", F.lit(""))).cast("bigint").alias("size"))
    totals = sized.groupBy("question_id", "band").agg(F.sum("size").alias("total"))
    before = F.sum("total").over(Window.partitionBy("question_id").orderBy("band")) - F.col("total")
    starts = totals.withColumn("start", before).join(files, "question_id").select("question_id", "band", "start", "name")  # a row for each band
    within = Window.partitionBy("question_id", "band").orderBy(F.col("seq").asc_nulls_last(), "block").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("within", F.sum("size").over(within) - F.col("size")).join(starts, ["question_id", "band"])
    return placed.select("name", (F.col("start") + F.col("within")).alias("at"), F.col("block").alias("piece"))


def write_report_files(documents: DataFrame, path: str, overwrite: bool = False) -> None:
    """One ``.md`` file for each report in the folder ``path``; a failed task leaves none."""
    write_pieces(report_pieces(documents), path, overwrite)
