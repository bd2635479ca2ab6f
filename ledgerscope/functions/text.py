"""Slugs, and the patterns of percentages and chart file names in answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a percentage and as a chart file in an answer.
# (?U) makes \w and \s cover all scripts.
PERCENTAGE = r"(?U)(?<![\w.])(-?[0-9]+(?:\.[0-9]+)?)\s*%"
CHART_FILE = r"(?iU)([\w\-]+\.png)"

REPORT_SLUG_LENGTH = 70
CHART_SLUG_LENGTH = 80


def slug(text: Column, default: str, length: int) -> Column:
    """File-name form of a text: lower case, other characters as ``_``, cut to ``length``."""
    safe = F.regexp_replace(F.lower(text), "[^a-z0-9_-]+", "_")
    stripped = F.regexp_replace(safe, "^_+|_+$", "")
    return F.substring(F.coalesce(F.nullif(stripped, F.lit("")), F.lit(default)), 1, length)

