"""Column functions: every one maps columns to a column and runs inside the JVM."""

from logweir.functions.jsonfields import JsonLine, is_json
from logweir.functions.levels import (
    keyword_level,
    normalize_level,
    numeric_level,
    status_class,
    status_level,
)
from logweir.functions.numbers import float_prefix, int_prefix, megabytes, percent
from logweir.functions.regexes import capture, named_groups, to_java
from logweir.functions.text import (
    csv_field,
    display_time,
    highlight,
    hour_key,
    iso_time,
    strip,
    truncate,
)
from logweir.functions.times import access_time, epoch_time, general_time, syslog_time

__all__ = [
    "JsonLine", "access_time", "capture", "csv_field", "display_time", "epoch_time",
    "float_prefix", "general_time", "highlight", "hour_key", "int_prefix", "is_json",
    "iso_time", "keyword_level", "megabytes", "named_groups", "normalize_level",
    "numeric_level", "percent", "status_class", "status_level", "strip", "syslog_time",
    "to_java", "truncate",
]
