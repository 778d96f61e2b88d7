"""Conjunctive filter over entries."""

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions.numbers import percent
from logweir.functions.regexes import to_java
from logweir.functions.text import compiles
from logweir.functions.times import general_time


def _bound(entries: DataFrame, value: str | datetime) -> Column:
    """A time bound as a literal; a text that names no time is an error, not a missing bound."""
    if isinstance(value, datetime):
        return F.lit(value).cast("timestamp")
    given = entries.sparkSession.sql("SELECT :value AS value", {"value": value})
    micros = given.select(F.unix_micros(general_time(F.col("value")))).first()[0]
    if micros is None:
        raise ValueError(f"not a time: {value}")
    return F.timestamp_micros(F.lit(micros))


def filter_condition(
    entries: DataFrame,
    levels: Sequence[str] = (),
    statuses: Sequence[int] = (),
    ips: Sequence[str] = (),
    methods: Sequence[str] = (),
    path: str | None = None,
    since: str | datetime | None = None,
    until: str | datetime | None = None,
    contains: str | None = None,
    not_contains: str | None = None,
    drop_untimed: bool = False,
) -> Column:
    """All given criteria, joined by AND. A criterion left empty does not restrict.

    * ``levels`` must be lower case to match anything; ``methods`` match in any case.
    * ``path`` is searched as a pattern in any case, or as plain text if it is no pattern.
    * ``since`` and ``until`` are inclusive and keep entries without a time, unless
      ``drop_untimed``.
    * ``contains`` and ``not_contains`` look into the raw line, in any case.

    A criterion on a missing value is NULL, which a filter drops. The tests on the raw line
    come first and the pattern last: they are tried in this order.
    """
    criteria = []
    raw = F.lower("raw")
    if contains:
        criteria.append(raw.contains(contains.lower()))
    if not_contains:
        criteria.append(~raw.contains(not_contains.lower()))
    if levels:
        criteria.append(F.lower("level").isin(list(levels)))
    if statuses:
        criteria.append(F.col("status").isin([int(s) for s in statuses]))
    if ips:
        criteria.append(F.col("ip").isin(list(ips)))
    if methods:
        criteria.append(F.upper("method").isin([m.upper() for m in methods]))
    time = F.col("timestamp")
    if since is not None:
        criteria.append(time.isNull() | (time >= _bound(entries, since)))
    if until is not None:
        criteria.append(time.isNull() | (time <= _bound(entries, until)))
    if drop_untimed and (since is not None or until is not None):
        criteria.append(time.isNotNull())
    if path:
        java = f"(?iu){to_java(path)}"
        is_pattern = compiles(entries.sparkSession, java)
        criteria.append(F.col("path").rlike(java) if is_pattern else F.col("path").contains(path))
    return reduce(lambda a, b: a & b, criteria) if criteria else F.lit(True)


def filter_logs(entries: DataFrame, **criteria) -> DataFrame:
    """Entries that meet all criteria of :func:`filter_condition`.

    The criteria on the raw line pass below the parser, down to the scan.
    """
    return entries.where(filter_condition(entries, **criteria))


def filter_summary(entries: DataFrame, **criteria) -> DataFrame:
    """One row: entries, matching entries, and their percentage, in a single pass."""
    matches = filter_condition(entries, **criteria)
    counted = entries.agg(
        F.count("*").alias("total"), F.count_if(matches).cast("bigint").alias("matched")
    )
    return counted.withColumn("percentage", percent(F.col("matched"), F.col("total")))
