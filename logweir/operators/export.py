"""Projections for display and export, and sinks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions.numbers import plain_number
from logweir.functions.text import csv_field, display_time, iso_time, truncate
from logweir.patterns import MESSAGE_WIDTH, PATH_WIDTH

CSV_COLUMNS = [
    "line", "timestamp", "level", "status", "method", "path", "message", "ip", "size",
    "response_time",
]


def json_projection(entries: DataFrame) -> DataFrame:
    """The columns of a JSON export, under the names they have there."""
    return entries.select(
        F.col("line_number").alias("line"),
        iso_time(F.col("timestamp")).alias("timestamp"),
        "level", "message", "source", "ip", "method", "path", "status", "size",
        F.col("response_time").alias("responseTime"),
    )


def _json_text(entries: DataFrame) -> DataFrame:
    """Export columns packed as JSON text: absent fields are left out, an absent time is not."""
    packed = json_projection(entries)
    rest = [name for name in packed.columns if name not in ("line", "timestamp", "responseTime")]
    head = F.concat(
        F.lit('{"line":'), F.coalesce(F.col("line").cast("string"), F.lit("null")),
        F.lit(',"timestamp":'),
        F.coalesce(F.concat(F.lit('"'), "timestamp", F.lit('"')), F.lit("null")),
        F.lit(","),
    )
    fields = F.to_json(F.struct(*rest))
    time = F.coalesce(F.concat(F.lit(',"responseTime":'), plain_number(F.col("responseTime"))), F.lit(""))
    tail = F.concat(F.substring(fields, F.lit(2), F.length(fields) - 2), time, F.lit("}"))
    return packed.select(F.concat(head, tail).alias("value"))


def json_rows(entries: DataFrame) -> DataFrame:
    """One JSON text per entry."""
    return _json_text(entries)


def csv_projection(entries: DataFrame) -> DataFrame:
    """The columns of a CSV export. Missing values are empty, and so is a zero."""

    def shown(name: str) -> Column:
        value = F.col(name)
        return F.when(value != 0, value)

    return entries.select(
        F.col("line_number").alias("line"),
        iso_time(F.col("timestamp")).alias("timestamp"),
        "level",
        shown("status").alias("status"),
        "method", "path", "message", "ip",
        shown("size").alias("size"),
        shown("response_time").alias("response_time"),
    )


def csv_rows(entries: DataFrame) -> DataFrame:
    """One line of CSV text per entry; only path and message are ever quoted."""
    cells = {
        "path": csv_field(F.col("path")),
        "message": csv_field(F.col("message")),
        "response_time": plain_number(F.col("response_time")),
    }
    texts = [cells.get(name, F.col(name)).cast("string") for name in CSV_COLUMNS]
    row = F.concat_ws(",", *[F.coalesce(text, F.lit("")) for text in texts])
    return csv_projection(entries).select(row.alias("value"))


def preview(entries: DataFrame, with_file: bool = False) -> DataFrame:
    """Rows for display: method and shortened path of a request, else a shortened message."""
    detail = F.when(
        F.col("method").isNotNull() & (F.col("method") != ""),
        truncate(F.nullif("path", F.lit("")), PATH_WIDTH),
    ).otherwise(truncate(F.col("message"), MESSAGE_WIDTH))
    return entries.select(
        *(["file"] if with_file else []),
        F.col("line_number").alias("line"),
        display_time(F.col("timestamp")).alias("timestamp"),
        F.upper("level").alias("level"),
        "status",
        F.nullif("method", F.lit("")).alias("method"),
        detail.alias("detail"),
    )


def has_http(entries: DataFrame) -> DataFrame:
    """One row: whether any entry has a status."""
    return entries.agg(
        F.coalesce(F.bool_or(F.col("status").isNotNull()), F.lit(False)).alias("has_http")
    )


def stats_json(document: DataFrame) -> DataFrame:
    """The statistics document as one JSON text, absent figures as null."""
    packed = F.to_json(F.struct(*document.columns), {"ignoreNullFields": "false"})
    return document.select(packed.alias("value"))


def filter_summary_json(summary: DataFrame) -> DataFrame:
    """The counts of ``filter_summary`` as one JSON text; of no entries the percentage is NaN."""
    share = F.coalesce(F.format_string("%.1f", F.col("percentage")), F.lit("NaN"))
    share = F.when(F.col("percentage").isNull(), F.lit("NaN")).otherwise(share)
    text = F.format_string('{"total":%d,"matched":%d,"percentage":"%s"}', F.col("total"), F.col("matched"), share)
    return summary.select(text.alias("value"))


def in_line_order(entries: DataFrame) -> DataFrame:
    """Sort by file and line over all output files."""
    return entries.repartitionByRange("file", "line_number").sortWithinPartitions(
        "file", "line_number"
    )


def write_json(entries: DataFrame, path: str, ordered: bool = False, mode: str = "error") -> None:
    rows = json_rows(in_line_order(entries) if ordered else entries)
    rows.write.mode(mode).text(path)


def write_csv(entries: DataFrame, path: str, ordered: bool = False, mode: str = "error") -> None:
    """CSV with a header in every part file."""
    rows = csv_projection(in_line_order(entries) if ordered else entries)
    rows = rows.withColumn("response_time", plain_number(F.col("response_time")))
    rows.write.mode(mode).csv(
        path,
        header=True,
        escape='"',
        emptyValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def write_parquet(entries: DataFrame, path: str, mode: str = "error") -> None:
    """Parquet in one folder per day, for later queries to skip days.

    Rebalancing gathers a day into few files and still splits a day that is too large.
    """
    dated = entries.withColumn("event_date", F.to_date("timestamp"))
    dated.hint("rebalance", F.col("event_date")).write.mode(mode).partitionBy(
        "event_date"
    ).parquet(path)
