"""DataFrame to DataFrame operators."""

from logweir.operators.detect import detect_format, with_format
from logweir.operators.export import (
    csv_projection,
    csv_rows,
    filter_summary_json,
    json_projection,
    json_rows,
    preview,
    stats_json,
    write_csv,
    write_json,
    write_parquet,
)
from logweir.operators.filters import filter_condition, filter_logs, filter_summary
from logweir.operators.numbering import number_by_order, number_scanned
from logweir.operators.parse import entries, parse_lines, parse_logs, rejects
from logweir.operators.ranks import nearest_rank
from logweir.operators.slices import head_lines, tail_lines
from logweir.operators.stats import (
    distribution_shares,
    errors_per_hour,
    level_distribution,
    method_distribution,
    response_times,
    stats_distributions,
    stats_document,
    stats_summary,
    status_distribution,
    tally,
    top_ips,
    top_paths,
    top_paths_view,
)

__all__ = [
    "csv_projection", "csv_rows", "detect_format", "distribution_shares", "entries",
    "errors_per_hour", "filter_condition", "filter_logs", "filter_summary", "filter_summary_json", "head_lines",
    "json_projection", "json_rows", "level_distribution", "method_distribution",
    "nearest_rank", "number_by_order", "number_scanned", "parse_lines", "parse_logs",
    "preview", "rejects", "response_times", "stats_distributions", "stats_document",
    "stats_json", "stats_summary", "status_distribution", "tail_lines", "tally", "top_ips", "top_paths_view",
    "top_paths", "with_format", "write_csv", "write_json", "write_parquet",
]
