"""Whole jobs over log files, from paths to a result DataFrame."""

from logweir.plans.reports import (
    filter_report,
    filter_report_summary,
    follow_report,
    load_lines,
    parse_report,
    stats_report,
)

__all__ = [
    "filter_report", "filter_report_summary", "follow_report", "load_lines", "parse_report", "stats_report",
]
