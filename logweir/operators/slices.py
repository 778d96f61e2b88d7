"""First and last lines of every file, taken before anything is parsed."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def head_lines(lines: DataFrame, n: int) -> DataFrame:
    return lines.where(F.col("line_number") <= n)


def tail_lines(lines: DataFrame, n: int) -> DataFrame:
    """Needs lines numbered ``with_totals``; keeps the true line numbers."""
    return lines.where(F.col("line_number") > F.col("file_lines") - n)
