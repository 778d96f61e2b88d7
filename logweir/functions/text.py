"""Text: trimming, truncation, escaping, display."""

from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from logweir.functions.regexes import to_java
from logweir.patterns import WHITE_SPACE_RUNS

WHITE_SPACE = "".join(chr(c) for a, b in WHITE_SPACE_RUNS for c in range(a, b + 1))


def strip(text: Column) -> Column:
    """Drop Unicode white space and byte-order marks at both ends.

    A character-set trim costs a fraction of a regular expression here.
    """
    return F.trim(text, F.lit(WHITE_SPACE))


def truncate(text: Column, width: int) -> Column:
    """At most ``width`` characters, the last three being dots if something was cut."""
    short = F.concat(F.substring(text, 1, width - 3), F.lit("..."))
    return F.when(F.length(text) > width, short).otherwise(text)


def csv_field(text: Column) -> Column:
    """Quote a field that holds a comma, a quote or a newline; double its quotes."""
    needs_quotes = text.contains(",") | text.contains('"') | text.contains("\n")
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(needs_quotes, quoted).otherwise(text)


def iso_time(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def hour_key(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH")


def display_time(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss")


def compiles(spark: SparkSession, java_pattern: str) -> bool:
    """Whether the JVM accepts a pattern. Runs on one constant, before any data is read."""
    try:
        spark.sql("SELECT '' RLIKE :pattern", {"pattern": java_pattern}).collect()
        return True
    except PySparkException:
        return False


def highlight(
    spark: SparkSession, text: Column, pattern: str, before: str = "<<", after: str = ">>"
) -> Column:
    """Put markers around every match, whatever its case; a broken pattern marks nothing."""
    if not pattern:
        return text
    java = f"(?iu)({to_java(pattern)})"
    if not compiles(spark, java):
        return text
    escape = str.maketrans({"\\": "\\\\", "$": "\\$"})
    return F.regexp_replace(
        text, java, before.translate(escape) + "$1" + after.translate(escape)
    )
