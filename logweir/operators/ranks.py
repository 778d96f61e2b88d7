"""Exact nearest-rank percentiles of a distribution too large for one task."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweir.session import cut_lineage


def nearest_rank(counts: DataFrame, fractions: Sequence[float]) -> DataFrame:
    """One row (fraction, value) per fraction, from distinct values and their counts.

    ``counts`` has columns ``value`` and ``count``. The value at rank ceil(fraction * n) is
    found by sorting ranges of values in parallel: the counts of whole ranges say which range
    holds the rank, and only that range is walked through.
    """
    ranged = cut_lineage(
        counts.repartitionByRange("value").select(
            "value", "count", F.spark_partition_id().alias("_range")
        )
    )
    # One row per shuffle partition from here on.
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        ranged.groupBy("_range")
        .agg(F.sum("count").alias("_here"))
        .select(
            "_range",
            "_here",
            F.coalesce(F.sum("_here").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_here").over(Window.partitionBy()).alias("_total"),
        )
    )
    wanted = ranges.select(
        "*", F.explode(F.array(*[F.lit(float(p)) for p in fractions])).alias("fraction")
    ).withColumn("_rank", F.greatest(F.ceil(F.col("fraction") * F.col("_total")), F.lit(1)))
    holding = wanted.where(
        (F.col("_before") < F.col("_rank")) & (F.col("_rank") <= F.col("_before") + F.col("_here"))
    )
    # At most one row per fraction is broadcast.
    walked = ranged.join(
        F.broadcast(holding.select("_range", "fraction", "_rank", "_before")), "_range"
    )
    so_far = F.col("_before") + F.sum("count").over(
        Window.partitionBy("fraction").orderBy("value")
    )
    return (
        walked.withColumn("_so_far", so_far)
        .where(F.col("_so_far") >= F.col("_rank"))
        .groupBy("fraction")
        .agg(F.min("value").alias("value"))
    )


def rank_columns(counts: DataFrame, named: dict[str, float]) -> DataFrame:
    """The same as one row with one column per name; NULL without values."""
    ranks = nearest_rank(counts, list(named.values()))
    return ranks.agg(
        *[
            F.max(F.when(F.col("fraction") == F.lit(p), F.col("value"))).alias(name)
            for name, p in named.items()
        ]
    )

