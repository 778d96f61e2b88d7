"""Follow growing log files: the same parser and filters as in batch jobs."""

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweir.functions.text import highlight as mark
from logweir.functions.text import strip
from logweir.operators.attach import attach
from logweir.operators.detect import elected, votes
from logweir.operators.export import preview
from logweir.operators.filters import filter_logs
from logweir.operators.parse import parse_logs
from logweir.patterns import FOLLOW_LINES
from logweir.session import configure, cut_lineage
from logweir.streaming.follow_source import LogFollowSource

LINE_KINDS = ("line", "backlog")
VOTES = ("json", "apache", "nginx")
STATE = "batch bigint, file_id string, lines bigint, format string"


def follow_rows(
    spark: SparkSession,
    path: str,
    initial_lines: int | str = FOLLOW_LINES,
    range_bytes: int | None = None,
    settle_seconds: float | None = None,
    on_loss: str = "fail",
    index: bool = True,
) -> DataFrame:
    """Stream of all rows of the ``log_follow`` source; with ``index`` also those of kind
    ``head`` and ``count``, from which formats and line numbers are told."""
    configure(spark)
    spark.dataSource.register(LogFollowSource)
    options = {"path": path, "initialLines": initial_lines, "onLoss": on_loss, "index": str(index).lower()}
    options |= {"tasks": spark.sparkContext.defaultParallelism}
    options |= {"rangeBytes": range_bytes} if range_bytes else {}
    options |= {"settleSeconds": settle_seconds} if settle_seconds is not None else {}
    return spark.readStream.format("log_follow").options(**options).load()


def stream_folder(spark: SparkSession, path: str) -> DataFrame:
    """Stream of the non-blank lines of text files that are dropped into a folder whole, on any
    file system Spark reads. A file is read once; for files that grow there is :func:`follow_lines`."""
    configure(spark)
    rows = spark.readStream.option("lineSep", "\n").text(path).where(strip(F.col("value")) != "")
    return rows.select(F.col("_metadata.file_path").alias("file"), F.lit(None).cast("bigint").alias("line_number"), "value")


def follow_lines(spark: SparkSession, path: str, initial_lines: int | str = FOLLOW_LINES, **options) -> DataFrame:
    """Stream of non-blank lines: first the last ``initial_lines`` of each file, then what is
    appended. Lines carry ``file_id``, ``byte_offset``, ``range_start`` and ``ordinal``;
    ``line_number`` is NULL, see :func:`number_batches`. Options are those of :func:`follow_rows`."""
    rows = follow_rows(spark, path, initial_lines, **{"index": False} | options)
    return rows.where(F.col("kind").isin(*LINE_KINDS)).select(
        "file", F.lit(None).cast("bigint").alias("line_number"), "value", "byte_offset", "range_start",
        "file_id", "kind", "ordinal",
    )


def tail_view(
    lines: DataFrame,
    format: str = "custom",
    levels: Sequence[str] = (),
    highlight: str | None = None,
    with_file: bool = False,
    **options,
) -> DataFrame:
    """Display rows of followed lines, with an optional level filter and marked matches."""
    rows = preview(filter_logs(parse_logs(lines, format, **options), levels=levels), with_file)
    if not highlight:
        return rows
    marked = {
        name: mark(lines.sparkSession, F.col(name), highlight)
        for name in ("timestamp", "level", "method", "detail")
    }
    return rows.withColumns(marked)


def with_lasting_format(rows: DataFrame) -> DataFrame:
    """The lines of :func:`follow_rows`, each with the ``format`` of its file.

    The format is told from the first lines that a file has when it first shows any, and
    then kept in the state of the stream: one row of three counts per file, which outlives
    restarts. A file that comes later, or is empty at first, gets its format like all others.

    The lines of a file within a batch pass one task. In the batch that brings a file's head they
    are held until the head has come; afterwards they pass as they are. For files of many
    gigabytes a batch use :func:`view_batches`, which moves no lines.
    """
    counted = votes(strip(F.col("value")))
    flags = [F.when(F.col("kind") == "head", is_kind).cast("int").alias(kind) for kind, is_kind in counted.items()]
    voted = rows.where("kind <> 'count'").select("*", *flags)
    names = [*rows.columns, *VOTES]

    def tell(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = state.get if state.exists else None
        heads, held = [], []
        for frame in frames:
            is_head = frame["kind"] == "head"
            heads.append(frame.loc[is_head, list(VOTES)])
            lines = frame[~is_head]
            if known is None:
                held.append(lines)
            else:
                yield lines.assign(**dict(zip(VOTES, known, strict=True)))
        if known is None:
            counts = pd.concat(heads)
            if len(counts):
                known = tuple(int(counts[v].sum()) for v in VOTES)
                state.update(known)
            for lines in held:
                yield lines.assign(**dict(zip(VOTES, known or (0, 0, 0), strict=True)))

    schema = ", ".join([f"{name} {kind}" for name, kind in voted.dtypes])
    told = voted.groupBy("file_id").applyInPandasWithState(
        tell, schema, ", ".join(f"{v} int" for v in VOTES), "append", "NoTimeout")
    return told.select(names).select(
        "file", F.lit(None).cast("bigint").alias("line_number"), "value", "byte_offset", "range_start", "file_id",
        elected().alias("format"),
    )


def number_batches(
    state_path: str, handle: Callable[[DataFrame, int], None], format: str | None = None
) -> Callable[[DataFrame, int], None]:
    """Function for ``foreachBatch`` that numbers followed lines per file across batches.

    ``handle`` gets ``file, line_number, value, byte_offset`` and, with ``format="auto"``, the
    ``format`` of each line's file, told once from its first lines. Rows come from
    :func:`follow_rows`; of those of :func:`follow_lines` files must be followed from their start
    (``initial_lines="all"``), since nothing tells how many lines stand before a backlog.

    Tasks count the lines of the byte range they read. Prefix sums over the ranges of a batch, and
    the number of lines that a file had before, place each range; a line's own ordinal in its
    range does the rest. So no line is shuffled or written, and a busy file is numbered by
    many tasks. The batch is read twice, by the same byte ranges.

    The only state is one row per file. A batch writes it under its own id, into one of three
    folders in turn; so a batch that is run again starts from the same state and writes the same,
    and old states go. A state that is missing is an error, not a new beginning.
    Numbers go on when a file is renamed or truncated.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _read_state(spark, state_path, batch_id)
        of_lines = F.col("kind").isin(*LINE_KINDS)
        ranges = cut_lineage(
            batch.groupBy("file_id", "range_start", "kind")
            .agg(
                F.when(F.first("kind") == "count", F.max("ordinal")).otherwise(F.count(F.lit(1))).alias("n"),
                *[F.count_if((F.col("kind") == "head") & is_kind).alias(k) for k, is_kind in votes(strip(F.col("value"))).items()],
            )
        )
        added = lambda kind, sign=1: F.sum(F.when(F.col("kind") == kind, sign * F.col("n")).otherwise(0))
        files = ranges.groupBy("file_id").agg(
            (added("count") + added("backlog", -1)).alias("earlier"),
            (added("line") + added("backlog")).alias("fresh"),
            F.max(F.col("kind") == "head").alias("has_head"),
            *[F.max(v).alias(v) for v in VOTES],
        )
        # without counts of what stands before it, a backlog begins with line 1
        files = files.withColumn("earlier", F.greatest("earlier", F.lit(0)))
        files = cut_lineage(
            files.join(before, "file_id", "full").select(
                "file_id",
                (F.coalesce("lines", F.lit(0)) + F.coalesce("earlier", F.lit(0))).alias("base"),
                F.coalesce("fresh", F.lit(0)).alias("fresh"),
                F.coalesce("format", F.when(F.col("has_head"), elected())).alias("format"),
            )
        )
        earlier = Window.partitionBy("file_id").orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1)
        offsets = (
            ranges.where(of_lines)
            .select("file_id", "range_start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_here"))
            .join(files, "file_id")
            .select("file_id", "range_start", (F.col("base") + F.col("_here")).alias("_before"),
                    F.coalesce("format", F.lit("custom")).alias("format"))
        )
        placed = attach(batch.where(of_lines), cut_lineage(offsets), ["file_id", "range_start"], bounded_groups=True)
        number = (F.col("ordinal") + F.col("_before")).cast("bigint").alias("line_number")
        kept = ["format"] if format == "auto" else []
        handle(placed.select("file", number, "value", "byte_offset", *kept), batch_id)
        after = files.select(
            F.lit(batch_id).cast("bigint").alias("batch"), "file_id",
            (F.col("base") + F.col("fresh")).alias("lines"), "format")
        mark_row = spark.createDataFrame([(batch_id, None, None, None)], STATE)
        after.unionByName(mark_row).write.mode("overwrite").parquet(_slot(state_path, batch_id))

    return run


def view_batches(
    state_path: str,
    handle: Callable[[DataFrame, int], None],
    format: str = "auto",
    levels: Sequence[str] = (),
    highlight: str | None = None,
    **options,
) -> Callable[[DataFrame, int], None]:
    """Function for ``foreachBatch`` on :func:`follow_rows`: ``handle`` gets the display rows of
    :func:`tail_view` with true line numbers, and the file of each.

    With ``auto`` a file's format is told once, from the first lines it has when it first shows any.
    """

    def show(numbered: DataFrame, batch_id: int) -> None:
        handle(tail_view(numbered, format, levels, highlight, with_file=True, **options), batch_id)

    return number_batches(state_path, show, format)


def _slot(state_path: str, batch_id: int) -> str:
    return f"{state_path}/slot={batch_id % 3}"


def _read_state(spark: SparkSession, state_path: str, batch_id: int) -> DataFrame:
    """What the batch before this one left; the first batch finds nothing."""
    if batch_id == 0:
        return spark.createDataFrame([], STATE).drop("batch")
    path = _slot(state_path, batch_id - 1)
    lost = RuntimeError(f"the state of batch {batch_id - 1} is not in {path}; line numbers cannot go on")
    try:
        rows = spark.read.schema(STATE).parquet(path)
    except AnalysisException as error:
        raise lost from error
    if not rows.where(F.col("file_id").isNull() & (F.col("batch") == batch_id - 1)).head(1):
        raise lost
    return rows.where(F.col("file_id").isNotNull()).drop("batch")
