"""Times read from text. An impossible date is NULL, never an error."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweir.functions.levels import lookup
from logweir.functions.regexes import to_java
from logweir.patterns import ACCESS_DATE, EPOCH_MILLIS_ABOVE, EPOCH_MILLIS_LIMIT, MONTHS

_ACCESS_DATE = to_java(ACCESS_DATE)
_OFFSET = to_java(ACCESS_DATE + r"\s*([+-]\d{4})")
_RUN_OF_SPACE = to_java(r"\s+")


def access_date_text(date: Column) -> Column:
    """The 20 characters of an access date that matter, or an empty text."""
    return F.regexp_extract(date, _ACCESS_DATE, 0)


def access_offset_text(date: Column) -> Column:
    """Zone offset that follows an access date, or an empty text."""
    return F.regexp_extract(date, _OFFSET, 7)


def access_time(date_text: Column, offset_text: Column | None = None) -> Column:
    """Time of ``dd/Mon/yyyy:HH:mm:ss``, as wall clock unless an offset is given.

    Cutting the fixed layout into ISO order and casting is several times faster than a
    formatter pattern.
    """
    parts = [
        F.substring(date_text, 8, 4), F.lit("-"),
        lookup(MONTHS, F.substring(date_text, 4, 3)), F.lit("-"),
        F.substring(date_text, 1, 2), F.lit(" "),
        F.substring(date_text, 13, 8),
    ]
    if offset_text is not None:
        parts.append(offset_text)
    return F.concat(*parts).try_cast("timestamp")


def general_time(text: Column) -> Column:
    """Time in one of the accepted notations, to the millisecond; else NULL.

    Accepted: ISO 8601 dates and times with ``-`` or ``/`` between date parts, with or
    without zone; and ``[Wdy,] d Mon yyyy HH:mm:ss zone``.
    """
    slashes = F.regexp_replace(text, r"^(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3")
    iso = F.coalesce(
        text.try_cast("timestamp"),
        F.regexp_replace(slashes, _RUN_OF_SPACE, " ").try_cast("timestamp"),
    )
    mail = F.regexp_replace(text, r"^[A-Za-z]{3,9},?\s+", "")
    mail = F.regexp_replace(mail, r"(?:GMT|UTC|UT|Z)$", "+0000")
    mail = F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z"))
    time = F.when(text.rlike(r"^\d{4}(?:[-/]|$)"), iso).when(
        text.rlike(r"^(?:[A-Za-z]{3,9},?\s+)?\d{1,2} [A-Z][a-z]{2} \d{4} "), mail
    )
    return F.date_trunc("millisecond", time)


def epoch_time(number: Column) -> Column:
    """Time of an epoch number: milliseconds if it is large, else seconds."""
    millis = F.when(number > EPOCH_MILLIS_ABOVE, number).otherwise(number * 1000)
    in_range = F.abs(millis) <= EPOCH_MILLIS_LIMIT
    return F.when(in_range, F.timestamp_millis(millis.try_cast("bigint")))


def syslog_time(text: Column, year: Column) -> Column:
    """Time of ``Mon d HH:mm:ss``, which names no year."""
    dated = F.concat(F.regexp_replace(text, _RUN_OF_SPACE, " "), F.lit(" "), year)
    return F.try_to_timestamp(dated, F.lit("MMM d HH:mm:ss yyyy"))
