"""Numbers read from text, and report arithmetic. Nothing here raises under ANSI mode."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweir.functions.regexes import to_java

_INT = to_java(r"^\s*([+-]?\d+)")
_FLOAT = to_java(r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")


def int_prefix(text: Column, kind: str = "bigint") -> Column:
    """The integer a text starts with, else NULL: ``'12kb'`` gives 12."""
    return F.regexp_extract(text, _INT, 1).try_cast(kind)


def float_prefix(text: Column) -> Column:
    """The number a text starts with, else NULL."""
    return F.regexp_extract(text, _FLOAT, 1).try_cast("double")


def percent(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part * F.lit(100.0), whole), 1)


def megabytes(size: Column) -> Column:
    return F.round(size / F.lit(1024.0 * 1024.0), 2)


def plain_number(number: Column) -> Column:
    """A double as JSON and people write it: 120, 12000000, 0.0001; with an exponent only from
    1e21 on and below 1e-6."""
    text = number.cast("string")
    digits = F.when(F.abs(number) >= 1, text.try_cast("decimal(38,16)").cast("string")).otherwise(
        text.try_cast("decimal(38,30)").cast("string")
    )
    decimal = F.regexp_replace(F.regexp_replace(digits, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    scaled = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\.0(?=E|$)", ""), "E-", "e-"), r"E(?=[0-9])", "e+")
    return (
        F.when(~text.contains("E"), F.regexp_replace(text, r"\.0$", ""))
        .when((F.abs(number) >= 1e-6) & (F.abs(number) < 1e21), decimal)
        .otherwise(scaled)
    )
