"""Sales analytics over Spark DataFrames: DataFrame in, DataFrame out."""

from ledgerscope.functions.labels import axis_label, with_period
from ledgerscope.functions.money import derive_financials
from ledgerscope.functions.periods import distinct_periods, latest_periods, period_filter
from ledgerscope.functions.text import slug
from ledgerscope.operators.asof import asof_join
from ledgerscope.operators.audit import (
    audit_answers, evidence_long, extract_claims, supported_claims, unsupported_charts, unsupported_claims,
)
from ledgerscope.operators.change import compare_periods, largest_decline, period_change
from ledgerscope.operators.charts import chart_points, chart_series, scatter_points
from ledgerscope.operators.constraints import check_constraints
from ledgerscope.operators.filters import filter_rows, match_count, preview
from ledgerscope.operators.intervals import interval_join
from ledgerscope.operators.lattice import subtotals
from ledgerscope.operators.median import exact_median
from ledgerscope.operators.ordered import moving_average, ranks, running_totals, top_rows
from ledgerscope.operators.profile import (
    profile_dates, profile_duplicates, profile_header, profile_missing, profile_numeric, profile_sample, profile_types,
)
from ledgerscope.operators.shares import deviations, missing_by, pivot_sum, ratio_by, share_of_total
from ledgerscope.operators.snapshots import snapshot_difference
from ledgerscope.operators.statistics import group_aggregate, rows_analyzed, statistics, summarize
from ledgerscope.operators.updates import apply_overrides
from ledgerscope.plans.checks import check_document, check_sections, checks_summary, judge, run_checks, write_check_report
from ledgerscope.plans.reports import rejected_questions, report_documents, report_pieces, write_report_files, write_reports
from ledgerscope.sources.dates import promote_dates
from ledgerscope.sources.tables import read_monthly, read_sales, write_csv, write_sales
from ledgerscope.sources.text_files import write_pieces
from ledgerscope.streaming.windows import append_to, session_table, sessions, windowed
