"""Turn rows of the given tables into log lines, inside the Spark plan.

The tables hold no log text. Each function adds a column ``line`` computed from the row, so
the lines grow with the tables and the expected answer can be told from the source columns.
"""

import os
import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir import configure, lines_from_table
from logweir.session import scratch_path

METHODS = {"click": "GET", "view": "GET", "signup": "PUT", "purchase": "POST", "error": "DELETE"}
STATUSES = {"view": 200, "purchase": 201, "signup": 302, "click": 404, "error": 500}
LEVELS = {"view": "info", "purchase": "notice", "signup": "debug", "click": "warn", "error": "error"}
NUMBERS = {"view": 30, "purchase": 35, "signup": 20, "click": 40, "error": 50}
WORDS = {
    "view": "page shown", "purchase": "order placed", "signup": "debug trail of signup",
    "click": "Warning: slow click", "error": "unhandled Exception",
}
FILE_ROWS = 2500


def choose(table: dict, key: str = "event_type") -> Column:
    chain = F
    for name, value in table.items():
        chain = chain.when(F.col(key) == name, value)
    return chain


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return with_fields(events.withColumn("ts", F.col("ts").cast("timestamp")))


def with_fields(events: DataFrame) -> DataFrame:
    """Columns every template draws from."""
    cents = F.round(F.col("value") * 100).cast("bigint").cast("string")
    return events.select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        (F.col("event_id") + 1).alias("line_number"),
        F.concat(
            F.lit("10.0."), F.expr("user_id div 256"), F.lit("."), F.expr("user_id % 256")
        ).alias("ip"),
        choose(METHODS).alias("method"),
        F.concat(F.lit("/"), "event_type", F.lit("/"), F.expr("event_id % 50")).alias("path"),
        choose(STATUSES).cast("string").alias("status"),
        F.when(F.expr("event_id % 10 = 0"), "-").otherwise(cents).alias("size"),
        F.concat(
            F.lit("0."), F.lpad(F.expr("event_id % 997").cast("string"), 3, "0")
        ).alias("rt"),
        choose(LEVELS).alias("level"),
        choose(WORDS).alias("words"),
    )


def _joined(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _c(name: str) -> Column:
    return F.col(name).cast("string")


def _request() -> Column:
    date = F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss")
    return _joined(
        "[", date, ' +0000] "', _c("method"), " ", _c("path"), ' HTTP/1.1" ', _c("status"), " ",
        _c("size"),
    )


def apache() -> Column:
    agent = F.when(
        F.expr("event_id % 2 = 0"), _joined(' "http://ref.example/" "agent/', F.expr("user_id % 7"), '"')
    ).otherwise("")
    return _joined(_c("ip"), " - u", _c("user_id"), " ", _request(), agent)


def nginx() -> Column:
    return _joined(
        _c("ip"), " - - ", _request(), ' "-" "agent/', F.expr("user_id % 7"), '" ', _c("rt")
    )


def nginx_error() -> Column:
    return _joined(
        F.date_format("ts", "yyyy/MM/dd HH:mm:ss"), " [", F.upper("level"), "] ",
        F.expr("user_id + 1"), "#0: *", _c("event_id"), " ", _c("words"), ", client: ", _c("ip"),
    )


def nginx_mixed() -> Column:
    return F.when(F.expr("event_id % 3 = 0"), nginx_error()).otherwise(nginx())


def json() -> Column:
    """Millisecond numbers and ISO texts as times, numbers and texts as levels."""
    even = F.expr("event_id % 2 = 0")
    fields = F.struct(
        F.when(even, choose(NUMBERS)).alias("level"),
        F.when(~even, F.upper(choose(LEVELS | {"purchase": "warning"}))).alias("severity"),
        F.when(even, F.unix_millis(F.date_trunc("second", "ts"))).alias("time"),
        F.when(~even, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("timestamp"),
        F.concat_ws(" ", "words", "event_id").alias("msg"),
        F.col("ip").alias("remoteAddress"),
        F.struct("method", F.col("path").alias("url")).alias("req"),
        F.struct(F.col("status").cast("int").alias("statusCode")).alias("res"),
        F.when(F.col("size") != "-", F.col("size").cast("bigint")).alias("contentLength"),
        F.col("rt").cast("double").alias("duration"),
    )
    return F.to_json(fields)


def syslog() -> Column:
    return _joined(
        F.date_format("ts", "MMM "), F.lpad(F.date_format("ts", "d"), 2, " "),
        F.date_format("ts", " HH:mm:ss"), " host", F.expr("user_id % 5"), " app-",
        _c("event_type"), "[", _c("user_id"), "]: ", _c("words"), " ", _c("event_id"),
    )


def timestamped() -> Column:
    return _joined(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), " [", F.upper("level"), "] ", _c("words"), " ",
        _c("event_id"),
    )


def bracketed() -> Column:
    date = _joined("[", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "] ")
    return _joined(
        F.when(F.expr("event_id % 2 = 0"), date).otherwise(""), "[", F.upper("level"), "] ",
        _c("words"), " ", _c("event_id"),
    )


def plain() -> Column:
    return _joined(_c("words"), " ", _c("event_id"))


def cascade() -> Column:
    return (
        F.when(F.expr("event_id % 4 = 0"), syslog())
        .when(F.expr("event_id % 4 = 1"), timestamped())
        .when(F.expr("event_id % 4 = 2"), bracketed())
        .otherwise(plain())
    )


USER_PATTERN = (
    r"at (?<timestamp>\S+ \S+) <(?<level>\w*)> (?<ip>[\d.]+) (?:(?<method>[A-Z]+) (?<path>\S+))? "
    r"=> (?<status>\d+) \[(?<size>\d*)\](?:\s+(?<message>.+))?"
)


def user_pattern() -> Column:
    return _joined(
        "at ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), " <",
        F.when(F.expr("event_id % 5 = 0"), "").otherwise(F.upper("level")), "> ", _c("ip"), " ",
        _c("method"), " ", _c("path"), " => ", _c("status"), " [",
        F.when(F.col("size") == "-", "").otherwise(F.col("size")), "] ", _c("words"),
    )


def corrupted(line: Column) -> Column:
    """One line in a hundred matches no structured format."""
    return F.when(
        F.expr("event_id % 100 = 99"), _joined("corrupt ", _c("event_id"))
    ).otherwise(line)


def event_lines(spark: SparkSession, sf_dir: str, template) -> DataFrame:
    """Lines of one file, numbered by the table itself."""
    rows = read_events(spark, sf_dir).withColumn("line", corrupted(template()))
    return lines_from_table(rows, "line", number_col="line_number")


def blank_some(line: Column) -> Column:
    return F.when(F.expr("event_id % 7 = 3"), " \t").otherwise(line)


def events_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows dealt to files that differ in format; one line in seven is blank."""
    rows = read_events(spark, sf_dir).withColumn("log", F.expr(f"event_id div {FILE_ROWS}"))
    line = (
        F.when(F.expr("log % 4 = 0"), apache())
        .when(F.expr("log % 4 = 1"), nginx())
        .when(F.expr("log % 4 = 2"), json())
        .otherwise(syslog())
    )
    return rows.withColumn("line", blank_some(corrupted(line)))


_written: dict = {}
_lock = threading.Lock()


def log_files(spark: SparkSession, sf_dir: str) -> str:
    """Write the rows of :func:`events_of_files` as text files once per session.

    A file holds a fixed number of rows, so no writer grows with the table.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    with _lock:
        if key not in _written:
            path = scratch_path(spark, "log-files")
            rows = events_of_files(spark, sf_dir)
            (
                rows.repartition(F.col("log"))
                .sortWithinPartitions("log", "event_id")
                .select("log", "line")
                .write.partitionBy("log")
                .text(path)
            )
            _written[key] = path
        return _written[key]


def write_files(rows: DataFrame, folder: str, renamed: bool = False) -> None:
    """Write the rows' lines to one growing file per log, each by a task, below a shared folder.

    A file that is there gets its lines again and then those that are new, so a task may run
    twice. With ``renamed``, a file that is there is moved aside first, as rotation does.
    """

    def write(frame):
        frame = frame.sort_values("event_id")
        path = f"{folder}/log={frame['log'].iloc[0]}.log"
        os.makedirs(folder, exist_ok=True)
        if renamed and os.path.exists(path) and not os.path.exists(path + ".1"):
            os.rename(path, path + ".1")
        with os.fdopen(os.open(path, os.O_RDWR | os.O_CREAT), "r+b") as out:
            out.write("".join(line + "\n" for line in frame["line"].dropna()).encode())
        return frame[["log"]].head(1)

    lines = rows.select("log", "event_id", "line")
    lines.groupBy("log").applyInPandas(write, "log bigint").count()


def log_of(file: Column) -> Column:
    """Number of the file, from its path."""
    return F.regexp_extract(file, r"log=(\d+)", 1).cast("bigint")
