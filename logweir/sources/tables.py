"""Lines held in a text column of any table or stream."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.functions.text import strip
from logweir.operators.numbering import number_by_order


def lines_from_table(
    df: DataFrame,
    text_col: str,
    order_col: str | None = None,
    file_col: str | None = None,
    number_col: str | None = None,
    with_totals: bool = False,
) -> DataFrame:
    """Non-blank lines of ``text_col``; a text of several lines gives several rows.

    * ``number_col``: the table knows its line numbers; they are taken as they are.
    * ``order_col``: a unique numeric or time column that orders the texts of a file; lines
      are numbered along it.
    * neither: line numbers are NULL.
    """
    file = F.col(file_col).cast("string") if file_col else F.lit("table")
    carried = [file.alias("file")]
    if number_col:
        carried.append(F.col(number_col).cast("bigint").alias("line_number"))
    elif order_col:
        carried.append(_as_number(df, order_col).alias("_order"))
    pieces = df.select(*carried, F.posexplode(F.split(F.col(text_col), "\n")).alias("_at", "value"))
    lines = pieces.where(strip(F.col("value")) != "")
    if number_col:
        return lines.select("file", "line_number", "value")
    if order_col:
        return number_by_order(lines, ["_order", "_at"], with_totals=with_totals)
    return lines.select("file", F.lit(None).cast("bigint").alias("line_number"), "value")


def _as_number(df: DataFrame, name: str):
    kind = dict(df.dtypes)[name]
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(name).cast("timestamp"))
    if kind == "date":
        return F.unix_date(F.col(name))
    return F.col(name)
