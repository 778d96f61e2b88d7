"""Text file scan."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.functions.text import strip
from logweir.operators.numbering import number_scanned
from logweir.session import configure


def read_lines(
    spark: SparkSession,
    paths: str | Sequence[str],
    line_numbers: bool = True,
    with_totals: bool = False,
) -> DataFrame:
    """Non-blank lines of text files, split at line feeds only.

    Large files are split over tasks. Without ``line_numbers`` the column is NULL and the
    counting scan is saved. Compressed files are read too, one task each.
    """
    configure(spark)
    scan = spark.read.option("lineSep", "\n").text(paths if isinstance(paths, str) else list(paths))
    rows = scan.where(strip(F.col("value")) != "").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        "value",
    )
    if not line_numbers:
        return rows.select("file", F.lit(None).cast("bigint").alias("line_number"), "value")
    return number_scanned(
        rows.withColumn("_row", F.monotonically_increasing_id()), with_totals=with_totals
    )
