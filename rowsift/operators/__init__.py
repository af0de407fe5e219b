"""Operators: filters, row ids, matching, requests, scorers, replies, run log."""

from .containment import rows_containing
from .filters import (
    distinct_values,
    filter_any_term,
    filter_contains,
    filter_related,
    is_empty,
    keep_columns,
    match_count,
    observe_count,
)
from .matching import match_values
from .replies import (
    explode_records,
    merge_verdicts,
    parse_matches,
    parse_replies,
    quarantine,
    records_to_table,
    standardize,
)
from .replystore import ReplyStore
from .requests import build_match_requests, build_requests, render_records
from .rowid import with_place, with_row_id
from .runlog import RunLog
from .scoring import evaluate_rules, score_requests

__all__ = [
    "ReplyStore", "RunLog", "build_match_requests", "build_requests", "distinct_values",
    "evaluate_rules", "explode_records", "filter_any_term", "filter_contains", "filter_related",
    "is_empty", "keep_columns", "match_count", "match_values", "merge_verdicts",
    "observe_count", "parse_matches", "parse_replies", "quarantine", "records_to_table",
    "render_records", "rows_containing", "score_requests", "standardize",
    "with_place", "with_row_id",
]
