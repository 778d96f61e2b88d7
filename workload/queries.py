"""One query per operator, over whole tables."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import logweir as lw
from logweir.functions import highlight, megabytes
from logweir.operators.detect import is_apache, is_nginx, is_syslog
from logweir.functions.jsonfields import is_json
from logweir.operators.export import has_http
from logweir.operators.stats import top_of
from logweir.plans import filter_report, follow_report, parse_report, stats_report
from logweir.session import cut_lineage, scratch_path
from logweir.streaming import follow_lines, follow_rows, live_counts, number_batches, stream_folder, view_batches
from workload import render as R

SYSLOG_YEAR = 2024
SHOWN = [name for name in lw.ENTRY_COLUMNS if name not in ("file", "format", "raw")]

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def show(df: DataFrame) -> DataFrame:
    """Times without zone and averages to six digits, to compare with another engine."""
    columns = []
    for name, kind in df.dtypes:
        column = F.col(name)
        if kind == "timestamp":
            column = column.cast("timestamp_ntz")
        if name in ("status", "size"):
            # A nullable integer is shown differently by data frame libraries.
            column = column.cast("double")
        if name.startswith("avg_"):
            column = F.round(column, 6)
        columns.append(column.alias(name))
    return df.select(*columns)


def entries_of(spark, sf_dir, template, format, **options) -> DataFrame:
    return lw.parse_logs(
        R.event_lines(spark, sf_dir, template), format, syslog_year=SYSLOG_YEAR, **options
    )


def access(spark, sf_dir) -> DataFrame:
    return entries_of(spark, sf_dir, R.nginx, "nginx")


def parsed_access(spark, sf_dir) -> DataFrame:
    return lw.parse_lines(R.event_lines(spark, sf_dir, R.nginx), "nginx")


def tallied(spark, sf_dir) -> DataFrame:
    return cut_lineage(lw.tally(parsed_access(spark, sf_dir)))


def _parse(name: str, template, format: str, **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return show(entries_of(spark, sf_dir, template, format, **options).select(*SHOWN))

    QUERIES[name] = run


_parse("parse_apache", R.apache, "apache")
_parse("parse_apache_offset", R.apache, "apache", honor_offset=True)
_parse("parse_nginx_access", R.nginx, "nginx")
_parse("parse_nginx_error", R.nginx_error, "nginx")
_parse("parse_nginx_mixed", R.nginx_mixed, "nginx")
_parse("parse_json", R.json, "json")
_parse("parse_syslog", R.syslog, "custom")
_parse("parse_simple_ts", R.timestamped, "custom")
_parse("parse_bracketed", R.bracketed, "custom")
_parse("parse_plain", R.plain, "custom")
_parse("parse_custom_cascade", R.cascade, "custom")
_parse("parse_user_pattern", R.user_pattern, "custom", pattern=R.USER_PATTERN)


@query
def parse_documents(spark, sf_dir):
    """Whole texts of the documents as free-form lines, numbered within each source."""
    lw.configure(spark)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = lw.lines_from_table(documents, "text", order_col="doc_id", file_col="source")
    return lw.parse_logs(lines, "custom").select("file", "line_number", "level", "message", "source")


@query
def parse_conversations(spark, sf_dir):
    lw.configure(spark)
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    lines = lw.lines_from_table(turns, "text", file_col="role")
    entries = lw.parse_logs(lines, "custom")
    return entries.groupBy("file", "level", "source").agg(
        F.count("*").alias("count"), F.sum(F.length("message")).alias("chars")
    )


@query
def rejects(spark, sf_dir):
    lines = R.event_lines(spark, sf_dir, R.apache)
    return lw.rejects(lw.parse_lines(lines, "apache")).select("line_number", "raw", "format")


@query
def format_predicates(spark, sf_dir):
    """Which formats each line of the mixed files looks like."""
    rows = R.events_of_files(spark, sf_dir)
    lines = lw.lines_from_table(rows, "line", number_col="line_number", file_col="log")
    raw = F.trim("value")
    return lines.select(
        "line_number",
        is_apache(raw).alias("apache"),
        is_nginx(raw).alias("nginx"),
        is_json(raw).alias("json"),
        is_syslog(raw).alias("syslog"),
    )


@query
def detect_format(spark, sf_dir):
    """From numbered lines of a table."""
    rows = R.events_of_files(spark, sf_dir)
    lines = lw.lines_from_table(rows, "line", order_col="event_id", file_col="log")
    return lw.detect_format(lines).select(F.col("file").cast("bigint").alias("log"), "format")


@query
def detect_format_files(spark, sf_dir):
    """From the heads of files."""
    heads = lw.read_heads(spark, R.log_files(spark, sf_dir), 5)
    return lw.detect_format(heads).select(R.log_of(F.col("file")).alias("log"), "format")


def _by_user(spark, sf_dir, with_totals=False):
    rows = R.read_events(spark, sf_dir).select(
        "event_id",
        F.when(F.expr("user_id % 3 = 0"), "web-a").otherwise("web-b").alias("site"),
        R.blank_some(R.corrupted(R.apache())).alias("line"),
    )
    return lw.lines_from_table(
        rows, "line", order_col="event_id", file_col="site", with_totals=with_totals
    )


@query
def number_lines(spark, sf_dir):
    return _by_user(spark, sf_dir).select(
        "file", "line_number", F.length(F.trim("value")).alias("chars")
    )


@query
def number_lines_files(spark, sf_dir):
    lines = lw.read_lines(spark, R.log_files(spark, sf_dir))
    return lines.select(
        R.log_of(F.col("file")).alias("log"),
        "line_number",
        F.col("value").startswith("corrupt").alias("corrupt"),
    )


@query
def head_n(spark, sf_dir):
    """First 50 lines of each site, parsed."""
    lines = lw.head_lines(_by_user(spark, sf_dir), 50)
    return lw.parse_logs(lines, "apache").select("file", "line_number", "ip", "path", "status")


@query
def tail_n(spark, sf_dir):
    """Last 50 lines of each site, parsed, with their true numbers."""
    lines = lw.tail_lines(_by_user(spark, sf_dir, with_totals=True), 50)
    return lw.parse_logs(lines, "apache").select("file", "line_number", "ip", "path", "status")


@query
def parse_report_files(spark, sf_dir):
    """Format told per file, first 50 lines of each, from text files."""
    shown = parse_report(spark, R.log_files(spark, sf_dir), syslog_year=SYSLOG_YEAR)
    return show(
        shown.select(
            R.log_of(F.col("file")).alias("log"), "format", "line_number", "level", "status", "path"
        )
    )


@query
def parse_report_tail_files(spark, sf_dir):
    shown = parse_report(
        spark, R.log_files(spark, sf_dir), lines=20, from_tail=True, syslog_year=SYSLOG_YEAR
    )
    return show(
        shown.select(
            R.log_of(F.col("file")).alias("log"), "format", "line_number", "level", "status", "path"
        )
    )


@query
def filter_report_files(spark, sf_dir):
    matching = filter_report(
        spark, R.log_files(spark, sf_dir), syslog_year=SYSLOG_YEAR, levels=["error", "warn"]
    )
    return matching.groupBy(R.log_of(F.col("file")).alias("log"), "format", "level").agg(
        F.count("*").alias("count")
    )


@query
def stats_report_files(spark, sf_dir):
    document = stats_report(spark, R.log_files(spark, sf_dir), syslog_year=SYSLOG_YEAR)
    return document.select(
        "total_lines", "parsed_lines", "failed_lines", "total_bytes",
        F.col("time_range.from").alias("from"),
        F.element_at("level_distribution", "error").alias("errors"),
        F.element_at("method_distribution", "GET").alias("gets"),
        F.size("errors_per_hour").cast("bigint").alias("error_hours"),
        "p99_response_time",
    )


FILTERS = {
    "filter_level": dict(levels=["error", "warn"]),
    "filter_status": dict(statuses=[404, 500]),
    "filter_ip": dict(ips=["10.0.0.7", "10.0.0.16"]),
    "filter_method": dict(methods=["post", "Put"]),
    "filter_path": dict(path="^/(PURCHASE|view)/1"),
    "filter_time": dict(since="2024-01-05T00:00:00", until="2024-01-20T12:00:00"),
    "filter_contains": dict(contains="AGENT/3"),
    "filter_not_contains": dict(not_contains="agent/3"),
    "filter_all": dict(
        levels=["info", "warn"], statuses=[200, 404, 302], methods=["GET"],
        ips=[f"10.0.0.{i}" for i in range(100)], path="/(view|click)/",
        since="2024-01-03", until="2024-01-28", contains="http/1.1", not_contains="agent/5",
    ),
}


def _filter(name: str, criteria: dict) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        matching = lw.filter_logs(access(spark, sf_dir), **criteria)
        return show(matching.select("line_number", "timestamp", "level", "ip", "path", "status"))

    QUERIES[name] = run


for _name, _criteria in FILTERS.items():
    _filter(_name, _criteria)


@query
def filter_untimed(spark, sf_dir):
    """Entries without a time pass a time filter."""
    entries = entries_of(spark, sf_dir, R.bracketed, "custom")
    return show(
        lw.filter_logs(entries, since="2024-01-15", levels=["error"]).select("line_number", "timestamp")
    )


@query
def filter_summary(spark, sf_dir):
    return lw.filter_summary(access(spark, sf_dir), statuses=[404, 500], contains="/click/")


@query
def level_distribution(spark, sf_dir):
    return lw.level_distribution(access(spark, sf_dir))


@query
def status_distribution(spark, sf_dir):
    return lw.status_distribution(access(spark, sf_dir))


@query
def method_distribution(spark, sf_dir):
    return lw.method_distribution(access(spark, sf_dir))


@query
def errors_per_hour(spark, sf_dir):
    return lw.errors_per_hour(access(spark, sf_dir))


@query
def top_paths(spark, sf_dir):
    return lw.top_paths(access(spark, sf_dir), 10)


@query
def top_ips(spark, sf_dir):
    return lw.top_ips(access(spark, sf_dir), 10)


@query
def response_times(spark, sf_dir):
    return show(lw.response_times(access(spark, sf_dir)))


@query
def stats_counts(spark, sf_dir):
    return lw.stats_summary(tallied(spark, sf_dir)).select(
        "total_lines", "parsed_lines", "failed_lines"
    )


@query
def stats_time_range(spark, sf_dir):
    return show(lw.stats_summary(tallied(spark, sf_dir)).select("first_time", "last_time"))


@query
def total_bytes(spark, sf_dir):
    return lw.stats_summary(tallied(spark, sf_dir)).select(
        "total_bytes", megabytes(F.col("total_bytes")).alias("megabytes")
    )


@query
def stats_summary(spark, sf_dir):
    return show(lw.stats_summary(tallied(spark, sf_dir)))


@query
def stats_one_pass(spark, sf_dir):
    """All distributions from one scan."""
    return lw.stats_distributions(lw.tally(parsed_access(spark, sf_dir)))


@query
def distribution_shares(spark, sf_dir):
    return lw.distribution_shares(tallied(spark, sf_dir))


@query
def top_of_tally(spark, sf_dir):
    return top_of(tallied(spark, sf_dir), "path", 25)


@query
def stats_document(spark, sf_dir):
    document = lw.stats_document(tallied(spark, sf_dir), 5)
    return document.select(
        "total_lines", "parsed_lines", "failed_lines", "total_bytes",
        F.col("time_range.from").alias("from"), F.col("time_range.to").alias("to"),
        F.element_at("level_distribution", "error").alias("errors"),
        F.element_at("status_distribution", "4xx").alias("client_errors"),
        F.element_at("method_distribution", "GET").alias("gets"),
        F.size("errors_per_hour").cast("bigint").alias("error_hours"),
        F.expr("top_paths[0].path").alias("first_path"),
        F.expr("top_ips[4].ip").alias("fifth_ip"),
        F.expr("top_ips[4].count").alias("fifth_ip_count"),
        "p95_response_time",
    )


@query
def csv_projection(spark, sf_dir):
    return show(lw.csv_projection(access(spark, sf_dir)))


@query
def csv_rows(spark, sf_dir):
    return lw.csv_rows(entries_of(spark, sf_dir, R.nginx_mixed, "nginx"))


@query
def json_projection(spark, sf_dir):
    return show(lw.json_projection(access(spark, sf_dir)))


@query
def json_rows(spark, sf_dir):
    return lw.json_rows(entries_of(spark, sf_dir, R.bracketed, "custom"))


@query
def preview(spark, sf_dir):
    return show(lw.preview(entries_of(spark, sf_dir, R.nginx_mixed, "nginx")))


@query
def has_http_entries(spark, sf_dir):
    return has_http(access(spark, sf_dir))


@query
def highlighted(spark, sf_dir):
    entries = access(spark, sf_dir)
    marked = highlight(spark, F.col("message"), "post|/VIEW")
    return entries.select("line_number", marked.alias("message"))


@query
def parquet_by_day(spark, sf_dir):
    """Entries written as Parquet in day folders, then read back for some days only."""
    path = scratch_path(spark, "entries")
    lw.write_parquet(access(spark, sf_dir), path)
    days = spark.read.parquet(path).where(F.col("event_date") >= "2024-01-15")
    return days.groupBy(F.col("event_date").cast("string").alias("event_date")).agg(
        F.count("*").alias("count"), F.sum("size").alias("bytes")
    )


# --- streams: run until all input present has been read, then show what was written ------


def _drain(writer, name: str, spark_checkpoint: str | None = None) -> None:
    spark_checkpoint = spark_checkpoint or scratch_path(SparkSession.active(), name)
    run = writer.option("checkpointLocation", spark_checkpoint).trigger(availableNow=True)
    run.start().awaitTermination()


@query
def live_counts_stream(spark, sf_dir):
    """Hourly counts over a stream of lines rendered from the events table."""
    lw.configure(spark)
    source = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(source).schema
    # As a pattern, since the file stream takes folders and patterns but no single file.
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    rows = R.with_fields(rows.withColumn("ts", F.col("ts").cast("timestamp")))
    lines = lw.lines_from_table(
        rows.withColumn("line", R.corrupted(R.nginx())), "line", number_col="line_number"
    )
    out = scratch_path(spark, "live-counts")
    counts = live_counts(lw.parse_logs(lines, "nginx"))
    _drain(
        counts.writeStream.outputMode("complete").foreachBatch(
            lambda batch, _: batch.write.mode("overwrite").parquet(out)
        ),
        "live-checkpoint",
    )
    return show(spark.read.parquet(out))


@query
def follow_numbered_stream(spark, sf_dir):
    """Text files followed from their start, lines numbered across batches."""
    path = R.log_files(spark, sf_dir).removeprefix("file:")
    lines = follow_lines(spark, path, "all", range_bytes=64 << 10)
    out = scratch_path(spark, "followed")

    def keep(numbered, batch_id):
        numbered.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    _drain(
        lines.writeStream.foreachBatch(number_batches(scratch_path(spark, "counts"), keep)),
        "follow-checkpoint",
    )
    return spark.read.parquet(out).select(
        R.log_of(F.col("file")).alias("log"),
        "line_number",
        F.col("value").startswith("corrupt").alias("corrupt"),
    )


@query
def follow_report_stream(spark, sf_dir):
    """Display rows of followed files, errors and warnings only, format told per file."""
    path = R.log_files(spark, sf_dir).removeprefix("file:")
    rows = follow_report(
        spark, path, initial_lines="all", levels=["error", "warn"], highlight="/click",
        syslog_year=SYSLOG_YEAR,
    )
    out = scratch_path(spark, "tail-view")
    _drain(rows.writeStream.format("parquet").option("path", out), "tail-checkpoint")
    return show(spark.read.parquet(out).drop("line"))


@query
def follow_late_file_stream(spark, sf_dir):
    """Format told per file: some files are there at the start, some are empty then and filled
    between two drains, some come between them. Each drain is a restart of the stream."""
    lw.configure(spark)
    rows, live = R.events_of_files(spark, sf_dir), scratch_path(spark, "late-files")
    out, checkpoint = scratch_path(spark, "late-view"), scratch_path(spark, "late-checkpoint")
    empty = rows.where("log % 4 = 1").withColumn("line", F.lit(None).cast("string"))
    for present in (rows.where("log % 2 = 0").unionByName(empty), rows):
        R.write_files(present, live)
        shown = follow_report(spark, live, initial_lines="all", syslog_year=SYSLOG_YEAR)
        _drain(shown.writeStream.format("parquet").option("path", out), "", checkpoint)
    return show(spark.read.parquet(out).drop("line"))


def _numbered_view(spark, live: str, **options) -> Callable[[], DataFrame]:
    """Drains the display rows of a folder's files, with line numbers, at each call."""
    out, state, checkpoint = (scratch_path(spark, f"view-{n}") for n in ("out", "state", "checkpoint"))

    def keep(rows, batch_id):
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    def drain() -> DataFrame:
        run = view_batches(state, keep, syslog_year=SYSLOG_YEAR)
        _drain(follow_rows(spark, live, **options).writeStream.foreachBatch(run), "", checkpoint)
        return spark.read.parquet(out)

    return drain


def _early() -> Column:
    """Rows that are there when following begins; a quarter of the files has none."""
    return F.expr(f"event_id % {R.FILE_ROWS} < {R.FILE_ROWS} * 0.52 AND log % 4 <> 3")


@query
def follow_backlog_stream(spark, sf_dir):
    """The last 10 lines of each file and what is appended later, with their true numbers."""
    lw.configure(spark)
    rows, live = R.events_of_files(spark, sf_dir), scratch_path(spark, "backlog-files")
    drain = _numbered_view(spark, live, initial_lines=10, range_bytes=64 << 10)
    for present in (rows.where(_early()), rows):
        R.write_files(present, live)
        shown = drain()
    return show(shown.select(R.log_of(F.col("file")).alias("log"), "line", "level", "status", "method", "detail"))


@query
def follow_rotation_stream(spark, sf_dir):
    """Files that are renamed and begun anew between two drains: each line once."""
    lw.configure(spark)
    rows, live = R.events_of_files(spark, sf_dir), scratch_path(spark, "rotated-files")
    drain = _numbered_view(spark, live, initial_lines="all")
    for present, renamed in ((rows.where(_early()), False), (rows.where(~_early()), True)):
        R.write_files(present, live, renamed)
        shown = drain()
    return show(shown.select(R.log_of(F.col("file")).alias("log"), "line", "level", "status", "method", "detail"))


@query
def stream_folder_levels(spark, sf_dir):
    """Text files dropped into a folder, read as a stream; levels of the parsed lines."""
    out = scratch_path(spark, "dropped")
    rows = stream_folder(spark, R.log_files(spark, sf_dir))
    _drain(lw.parse_logs(rows, "custom").writeStream.format("parquet").option("path", out), "dropped-checkpoint")
    shown = spark.read.parquet(out)
    return shown.groupBy(R.log_of(F.col("file")).alias("log")).agg(F.count("*").alias("lines"))


# --- sinks: written, and read back as text -----------------------------------------------


@query
def json_sink(spark, sf_dir):
    out = scratch_path(spark, "json-sink")
    lw.write_json(access(spark, sf_dir), out, ordered=True)
    return spark.read.text(out)


@query
def csv_sink(spark, sf_dir):
    out = scratch_path(spark, "csv-sink")
    lw.write_csv(access(spark, sf_dir), out)
    return spark.read.text(out).where(~F.col("value").startswith("line,timestamp,"))


@query
def stats_json_text(spark, sf_dir):
    """The statistics document as JSON text, and figures found in it."""
    text = lw.stats_json(lw.stats_document(cut_lineage(lw.tally(parsed_access(spark, sf_dir)))))
    found = {
        "total_lines": "$.total_lines", "total_bytes": "$.total_bytes", "first": "$.time_range.from",
        "infos": "$.level_distribution.info", "found": "$.status_distribution.2xx", "puts": "$.method_distribution.PUT",
        "path": "$.top_paths[0].path", "path_count": "$.top_paths[0].count", "third_ip": "$.top_ips[2].ip",
    }
    return text.select(*[F.get_json_object("value", place).alias(name) for name, place in found.items()])


@query
def filter_summary_text(spark, sf_dir):
    return lw.filter_summary_json(lw.filter_summary(access(spark, sf_dir), statuses=[404, 500], contains="/click/"))


def _long(spark, sf_dir) -> DataFrame:
    """Entries whose paths and messages are from 5 to 120 characters long."""
    tail = F.repeat(F.lit("/part-9"), (F.col("line_number") % 17).cast("int"))
    rows = access(spark, sf_dir).withColumn("path", F.concat("path", tail))
    rows = rows.withColumn("message", F.concat("message", tail))
    return rows.withColumn("method", F.when(F.col("line_number") % 2 == 0, F.col("method")))


@query
def preview_cut(spark, sf_dir):
    """Paths cut at 40 characters and messages at 80."""
    return lw.preview(_long(spark, sf_dir)).select("line", "method", "detail")


@query
def top_paths_cut(spark, sf_dir):
    """The 50 most frequent long paths, cut at 35 characters for display."""
    return lw.top_paths_view(_long(spark, sf_dir), 50)
