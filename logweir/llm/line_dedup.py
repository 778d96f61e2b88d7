"""Lines that many documents share, kept in one document only."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import BLANKS, ascii_lower, let, pair_hash, whole


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = 20,
    min_docs: int = 3,
) -> DataFrame:
    """Drop repeated lines, and return ``id_col, kept_text, n_lines, n_dropped, row`` per row.

    A line's key is the stripped line with A-Z in lower case. A key of at least ``min_length``
    code points found in at least ``min_docs`` documents stays in the document with the largest
    id only, there with all its lines.

    Lines are exploded to 128-bit hashes of their keys; texts are shuffled at most once, when
    the positions to drop come back to their document. A key that most documents share is
    counted by partial sums, and its lines meet it in a join that Spark may split.

    * A null or empty text is one empty line. An empty table gives no rows.
    * Rows with the same id are one document when documents are counted; each keeps its row.
    * A null id counts as one document and is never the one that keeps a line.
    * Other columns are not looked at, whatever their names; ``row`` has them all as they came.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"), F.struct(*docs.columns).alias("row"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    lines = rows.select(
        "id", "text_hash", F.posexplode(F.split(ascii_lower(F.col("text")), "\n")).alias("pos", "line")
    ).select("id", "text_hash", "pos", F.btrim("line", F.lit(BLANKS)).alias("key"))
    h1, h2 = pair_hash(F.col("key"))
    lines = lines.filter(F.length("key") >= min_length).select("id", "text_hash", "pos", h1.alias("h1"), h2.alias("h2"))
    shared = (
        lines.select("h1", "h2", "id").distinct()
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("keeper"))
        .filter(F.col("docs") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    dropped = (
        lines.join(shared, ["h1", "h2"])
        .filter(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy("id", "text_hash").agg(F.collect_set("pos").alias("drop"))
        .select(F.col("id").alias("drop_id"), F.col("text_hash").alias("drop_hash"), "drop")
    )
    joined = rows.join(
        dropped,
        F.col("id").eqNullSafe(F.col("drop_id")) & (F.col("text_hash") == F.col("drop_hash")),
        "left",
    )

    def without(split):
        stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("drop"))
        return F.array_join(F.transform(stay, lambda i: split[i]), "\n")

    kept = F.when(F.col("drop").isNull(), F.col("text")).otherwise(let(F.split("text", "\n"), without))
    return joined.select(
        F.col("id").alias(id_col),
        kept.alias("kept_text"),
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        "row",
    )
