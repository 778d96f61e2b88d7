"""Ordinals of lines within files, without putting a file into one task.

Both ways count lines per block first, turn the counts into offsets, and then number the
lines of each block on their own. A block of a text file is the split a task reads; a block
of a table is a range of its order column.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.operators.attach import attach
from logweir.session import cut_lineage


def _with_offsets(blocks: DataFrame) -> DataFrame:
    """Lines of a file that stand before each of its blocks, and the total of the file.

    The window runs over blocks, not lines: a terabyte file has some thousands.
    """
    earlier = Window.partitionBy("file").orderBy("_block")
    return blocks.select(
        "*",
        F.coalesce(
            F.sum("_count").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
        F.sum("_count").over(Window.partitionBy("file")).alias("file_lines"),
    )


def number_scanned(rows: DataFrame, with_totals: bool = False) -> DataFrame:
    """Number rows of a text scan that carry ``file``, ``_block`` (where the split starts)
    and ``_row`` (an id that grows by one from row to row of a task).

    No line is shuffled: rows of a split follow each other within a task, so the ordinal in
    the split is a difference of ids. The scan runs twice, once to count and once to number.
    If the second scan splits files or deals splits to tasks in another way, the ordinals of
    some split leave the range that was counted, and the job fails.
    """
    blocks = cut_lineage(
        _with_offsets(
            rows.groupBy("file", "_block").agg(
                F.min("_row").alias("_first"), F.count("*").alias("_count")
            )
        )
    )
    placed = attach(rows, blocks, ["file", "_block"], bounded_groups=True)
    within = F.col("_row") - F.col("_first")
    number = F.when((within >= 0) & (within < F.col("_count")), within + F.col("_before") + 1).otherwise(
        F.raise_error(F.lit("input files were split anew between counting and numbering"))
    )
    return _finish(placed.withColumn("line_number", number.cast("bigint")), with_totals)


def number_by_order(
    lines: DataFrame, order: list[str], ranges: int | None = None, with_totals: bool = False
) -> DataFrame:
    """Number rows that carry ``file`` in the order of unique columns, the first one a number.

    The first order column is cut into ranges that hold about equally many rows each, so a
    group (file, range) stays small even if one file holds most rows.
    """
    spark = lines.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    lead = F.col(order[0])
    steps = [i / ranges for i in range(1, ranges)]
    cuts = []
    if steps:
        sketch = F.percentile_approx(lead, steps, max(10_000, 10 * ranges))
        cuts = sorted(set(lines.agg(sketch).first()[0] or []))
    ranged = lines.withColumn("_block", range_of(lead, cuts))
    counts = ranged.groupBy("file", "_block").agg(F.count("*").alias("_count"))
    blocks = cut_lineage(_with_offsets(counts))
    placed = attach(ranged, blocks, ["file", "_block"], bounded_groups=True)
    within = F.row_number().over(Window.partitionBy("file", "_block").orderBy(*order))
    number = (within + F.col("_before")).cast("bigint")
    return _finish(placed.withColumn("line_number", number), with_totals)


def range_of(value: Column, cuts: list) -> Column:
    """Number of sorted ``cuts`` at or below a value, found in two short searches."""
    if not cuts:
        return F.lit(0)
    width = max(1, int(len(cuts) ** 0.5))
    chunks = [cuts[i : i + width] for i in range(0, len(cuts), width)]

    def at_or_below(items: Column) -> Column:
        return F.size(F.filter(items, lambda cut: cut <= value))

    heads = F.array(*[F.lit(chunk[0]) for chunk in chunks])
    bodies = F.array(*[F.array(*[F.lit(cut) for cut in chunk]) for chunk in chunks])
    chunk = at_or_below(heads)
    return F.when(chunk == 0, 0).otherwise(
        (chunk - 1) * width + at_or_below(F.get(bodies, chunk - 1))
    )


def _finish(numbered: DataFrame, with_totals: bool) -> DataFrame:
    totals = ["file_lines"] if with_totals else []
    return numbered.select("file", "line_number", *totals, "value")
