"""Parse, filter and statistics jobs."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.operators.detect import detect_format, with_format
from logweir.operators.filters import filter_logs, filter_summary
from logweir.operators.parse import parse_lines, parse_logs
from logweir.operators.slices import head_lines, tail_lines
from logweir.operators.stats import stats_document, tally
from logweir.patterns import DETECTION_LINES, FOLLOW_LINES, PREVIEW_LINES, TOP_ENTRIES
from logweir.session import cut_lineage
from logweir.sources import read_heads, read_lines
from logweir.streaming import follow_lines, follow_rows, tail_view, with_lasting_format

Paths = str | Sequence[str]


def _with_detected(spark: SparkSession, paths: Paths, lines: DataFrame, format: str) -> DataFrame:
    """Formats are told from the heads of files, so the files are not scanned for them."""
    if format != "auto":
        return lines
    return with_format(lines, detect_format(read_heads(spark, paths, DETECTION_LINES)))


def load_lines(
    spark: SparkSession, paths: Paths, format: str = "auto", line_numbers: bool = True
) -> DataFrame:
    """All lines of the files, with a ``format`` column if formats are to be told."""
    lines = read_lines(spark, paths, line_numbers=line_numbers)
    return _with_detected(spark, paths, lines, format)


def parse_report(
    spark: SparkSession,
    paths: Paths,
    format: str = "auto",
    lines: int = PREVIEW_LINES,
    from_tail: bool = False,
    **options,
) -> DataFrame:
    """Entries of the first or last ``lines`` lines of each file.

    The first lines are read without scanning the files. The last need a count of all lines,
    for their numbers to be true.
    """
    if from_tail:
        chosen = tail_lines(read_lines(spark, paths, with_totals=True), lines)
    else:
        chosen = head_lines(read_heads(spark, paths, lines), lines)
    return parse_logs(_with_detected(spark, paths, chosen, format), format, **options)


def _entries(spark, paths, format, line_numbers, options) -> DataFrame:
    loaded = load_lines(spark, paths, format, line_numbers)
    return parse_logs(loaded, format, **options)


PARSE_OPTIONS = ("pattern", "honor_offset", "syslog_year")


def filter_report(
    spark: SparkSession, paths: Paths, format: str = "auto", line_numbers: bool = True, **criteria
) -> DataFrame:
    """Entries that meet all criteria. Without ``line_numbers``, one narrow pass."""
    options = {k: criteria.pop(k) for k in PARSE_OPTIONS if k in criteria}
    return filter_logs(_entries(spark, paths, format, line_numbers, options), **criteria)


def filter_report_summary(
    spark: SparkSession, paths: Paths, format: str = "auto", **criteria
) -> DataFrame:
    """How many entries meet all criteria."""
    options = {k: criteria.pop(k) for k in PARSE_OPTIONS if k in criteria}
    return filter_summary(_entries(spark, paths, format, False, options), **criteria)


def stats_report(
    spark: SparkSession,
    paths: Paths,
    format: str = "auto",
    top_n: int = TOP_ENTRIES,
    line_numbers: bool = True,
    **options,
) -> DataFrame:
    """Statistics document. Line numbers only decide ties in the top lists; without them,
    ties go by name and the counting scan is saved."""
    parsed = parse_lines(load_lines(spark, paths, format, line_numbers), format, **options)
    return stats_document(cut_lineage(tally(parsed)), top_n)


def follow_report(
    spark: SparkSession,
    path: str,
    format: str = "auto",
    initial_lines: int | str = FOLLOW_LINES,
    levels: Sequence[str] = (),
    highlight: str | None = None,
    follow: Mapping[str, object] | None = None,
    **options,
) -> DataFrame:
    """Stream of display rows of growing files. With ``auto``, the format of each file is told
    once, when it first has lines, and kept with the stream's checkpoint; ``line`` is NULL. For
    true line numbers, and for files of many gigabytes, use ``streaming.view_batches``.

    ``follow`` has options of ``streaming.follow_rows``."""
    follow = dict(follow or {})
    if format == "auto":
        lines = with_lasting_format(follow_rows(spark, path, initial_lines, **follow))
    else:
        lines = follow_lines(spark, path, initial_lines, **follow)
    return tail_view(lines, format, levels, highlight, **options)
