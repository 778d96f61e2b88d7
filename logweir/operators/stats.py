"""Statistics over entries.

:func:`tally` reads the lines once and shuffles once; it keeps a count for every distinct
value of every dimension, and all reports can be drawn from it. Where just one figure is
wanted, the functions that take entries group by that column alone, so that the parser
evaluates nothing else.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions.levels import status_class
from logweir.functions.numbers import percent
from logweir.functions.text import hour_key, iso_time, truncate
from logweir.operators.ranks import rank_columns
from logweir.patterns import STATS_PATH_WIDTH, TOP_ENTRIES
from logweir.session import cut_lineage

PERCENTILES = {"p95_response_time": 95 / 100, "p99_response_time": 99 / 100}
DISTRIBUTIONS = ["level", "status", "method", "error_hour", "path", "ip"]


def is_error() -> Column:
    """Counts as an error in the hourly report; ``fatal`` alone does not."""
    return (F.col("level") == "error") | F.coalesce(F.col("status") >= 500, F.lit(False))


def _keys() -> dict[str, Column]:
    """Text key of an entry in each distribution; NULL where it takes no part."""
    return {
        "level": F.lower("level"),
        "status": status_class(F.col("status")),
        "method": F.nullif("method", F.lit("")),
        "error_hour": F.when(is_error(), hour_key(F.col("timestamp"))),
        "path": F.nullif("path", F.lit("")),
        "ip": F.nullif("ip", F.lit("")),
    }


def tally(parsed: DataFrame) -> DataFrame:
    """Counts per (dimension, key, number) of parsed lines, in one scan and one shuffle.

    Besides the distributions there are the dimensions ``line`` (keys parsed and failed,
    with bytes and first and last time) and ``response_time`` (one row per distinct number).
    Counting starts before the shuffle, so a key held by most lines costs nothing extra.
    The minimum of the line number, not of a text, keeps the aggregation hash-based.
    """
    of_entry = F.col("parsed")
    no_text, no_number = F.lit(None).cast("string"), F.lit(None).cast("double")

    def fact(dimension: str, key: Column, number=no_number, size=None, time=None) -> Column:
        return F.struct(
            F.lit(dimension).alias("dimension"),
            key.alias("key"),
            number.alias("number"),
            (F.lit(None) if size is None else size).cast("bigint").alias("size"),
            (F.lit(None) if time is None else time).cast("timestamp").alias("time"),
        )

    line = F.when(of_entry, "parsed").otherwise("failed")
    facts = [fact("line", line, size=F.col("size"), time=F.col("timestamp"))]
    facts += [fact(name, F.when(of_entry, key)) for name, key in _keys().items()]
    facts.append(fact("response_time", no_text, number=F.col("response_time")))
    return (
        parsed.select("line_number", F.inline(F.array(*facts)))
        .where(F.col("key").isNotNull() | F.col("number").isNotNull())
        .groupBy("dimension", "key", "number")
        .agg(
            F.count("*").alias("count"),
            F.min("line_number").alias("first_line"),
            F.sum("size").alias("size"),
            F.min("time").alias("first_time"),
            F.max("time").alias("last_time"),
        )
    )


# --- reports drawn from a tally ---------------------------------------------------------


def stats_summary(tallied: DataFrame) -> DataFrame:
    """One row of totals, time range, bytes and response times. Pass a materialised tally."""
    lines = F.col("dimension") == "line"
    times = F.col("dimension") == "response_time"
    totals = tallied.where(lines | times).agg(
        _sum_where(lines).alias("total_lines"),
        _sum_where(lines & (F.col("key") == "parsed")).alias("parsed_lines"),
        _sum_where(lines & (F.col("key") == "failed")).alias("failed_lines"),
        F.min("first_time").alias("first_time"),
        F.max("last_time").alias("last_time"),
        F.try_divide(
            F.sum(F.when(times, F.col("number") * F.col("count"))),
            F.sum(F.when(times, F.col("count"))),
        ).alias("avg_response_time"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("total_bytes"),
    )
    counts = tallied.where(times).select(F.col("number").alias("value"), "count")
    # Two single rows side by side.
    return totals.join(rank_columns(counts, PERCENTILES), F.lit(True)).select(
        "total_lines", "parsed_lines", "failed_lines", "first_time", "last_time",
        "avg_response_time", *PERCENTILES, "total_bytes",
    )


def _sum_where(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("count"))), F.lit(0)).cast("bigint")


def stats_distributions(tallied: DataFrame) -> DataFrame:
    """All distributions in long form: dimension, key, count, first_line."""
    wanted = tallied.where(F.col("dimension").isin(DISTRIBUTIONS))
    return wanted.select("dimension", "key", "count", "first_line")


def top_of(tallied: DataFrame, dimension: str, n: int = TOP_ENTRIES) -> DataFrame:
    """The ``n`` most frequent keys of a dimension; of equal ones, the first seen."""
    wanted = tallied.where(F.col("dimension") == dimension)
    return wanted.orderBy(F.desc("count"), "first_line", "key").limit(n).select(
        F.col("key").alias(dimension), "count"
    )


def distribution_shares(tallied: DataFrame) -> DataFrame:
    """Percentage of all entries in each level and status class."""
    parsed = tallied.where("dimension = 'line' AND key = 'parsed'").agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("_parsed")
    )
    shares = tallied.where(F.col("dimension").isin("level", "status"))
    # The other side is one row.
    return shares.join(F.broadcast(parsed), F.lit(True)).select(
        "dimension", "key", "count", percent(F.col("count"), F.col("_parsed")).alias("percentage")
    )


def stats_document(tallied: DataFrame, top_n: int = TOP_ENTRIES) -> DataFrame:
    """One nested row with all statistics.

    Levels, statuses, methods and hours become maps; paths and addresses only appear as top
    lists, which are cut to ``top_n`` before they are gathered.
    """
    in_maps = {
        "level_distribution": "level",
        "status_distribution": "status",
        "method_distribution": "method",
        "errors_per_hour": "error_hour",
    }
    maps = tallied.where(F.col("dimension").isin(*in_maps.values())).agg(
        *[
            F.map_from_entries(
                F.array_sort(
                    F.collect_list(
                        F.when(F.col("dimension") == dimension, F.struct("key", "count"))
                    )
                )
            ).alias(name)
            for name, dimension in in_maps.items()
        ]
    )

    def top(dimension: str, name: str) -> DataFrame:
        ranked = top_of(tallied, dimension, top_n)
        sortable = F.struct((-F.col("count")).alias("order"), F.col("_at"), dimension, "count")
        gathered = F.array_sort(F.collect_list(sortable))
        shown = F.transform(gathered, lambda e: F.struct(e[dimension].alias(dimension), e["count"].alias("count")))
        return ranked.withColumn("_at", F.monotonically_increasing_id()).agg(shown.alias(name))

    # Every side is a single row.
    document = stats_summary(tallied)
    for part in (maps, top("path", "top_paths"), top("ip", "top_ips")):
        document = document.join(part, F.lit(True))
    return document.select(
        "total_lines", "parsed_lines", "failed_lines",
        F.struct(
            iso_time(F.col("first_time")).alias("from"), iso_time(F.col("last_time")).alias("to")
        ).alias("time_range"),
        "level_distribution", "status_distribution", "top_paths", "top_ips",
        "method_distribution", "errors_per_hour", "avg_response_time", *PERCENTILES,
        "total_bytes",
    )


# --- single figures drawn from entries --------------------------------------------------


def _count_by(entries: DataFrame, key: Column, name: str) -> DataFrame:
    keyed = entries.select(key.alias(name)).where(F.col(name).isNotNull())
    return keyed.groupBy(name).agg(F.count("*").alias("count"))


def level_distribution(entries: DataFrame) -> DataFrame:
    return _count_by(entries, _keys()["level"], "level")


def status_distribution(entries: DataFrame) -> DataFrame:
    return _count_by(entries, _keys()["status"], "status_class")


def method_distribution(entries: DataFrame) -> DataFrame:
    return _count_by(entries, _keys()["method"], "method")


def errors_per_hour(entries: DataFrame) -> DataFrame:
    return _count_by(entries, _keys()["error_hour"], "hour")


def _top(entries: DataFrame, name: str, n: int) -> DataFrame:
    keyed = entries.select(_keys()[name].alias(name), "line_number")
    counted = keyed.where(F.col(name).isNotNull()).groupBy(name).agg(
        F.count("*").alias("count"), F.min("line_number").alias("_first")
    )
    return counted.orderBy(F.desc("count"), "_first", name).limit(n).select(name, "count")


def top_paths_view(entries: DataFrame, n: int = TOP_ENTRIES) -> DataFrame:
    """The most frequent paths for display, each shortened to the width that reports have."""
    shown = truncate(F.col("path"), STATS_PATH_WIDTH)
    return top_paths(entries, n).select(shown.alias("path"), "count")


def top_paths(entries: DataFrame, n: int = TOP_ENTRIES) -> DataFrame:
    """Most frequent paths; of equally frequent ones, the first seen."""
    return _top(entries, "path", n)


def top_ips(entries: DataFrame, n: int = TOP_ENTRIES) -> DataFrame:
    """Most frequent addresses; of equally frequent ones, the first seen."""
    return _top(entries, "ip", n)


def response_times(entries: DataFrame, exact: bool = True) -> DataFrame:
    """One row: average, 95th and 99th percentile by nearest rank.

    The exact way counts distinct values first and never gathers them in one task. The
    other way keeps a fixed-size sketch, in one pass and without a stop in between.
    """
    timed = entries.select(F.col("response_time").alias("value")).where("value IS NOT NULL")
    if not exact:
        sketches = [
            F.percentile_approx("value", p, 100_000).alias(name) for name, p in PERCENTILES.items()
        ]
        return timed.agg(F.avg("value").alias("avg_response_time"), *sketches)
    counts = cut_lineage(timed.groupBy("value").agg(F.count("*").alias("count")))
    average = counts.agg(
        F.try_divide(F.sum(F.col("value") * F.col("count")), F.sum("count")).alias(
            "avg_response_time"
        )
    )
    # Two single rows side by side.
    return average.join(rank_columns(counts, PERCENTILES), F.lit(True))
