"""Format of each file, told by its first lines."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir import patterns as P
from logweir.functions.jsonfields import is_json
from logweir.functions.regexes import to_java
from logweir.functions.text import strip
from logweir.operators.attach import attach
from logweir.session import cut_lineage


def is_apache(raw: Column) -> Column:
    return raw.rlike(to_java(P.APACHE_LINE))


def is_nginx(raw: Column) -> Column:
    return raw.rlike(to_java(P.NGINX_ACCESS_LINE)) | raw.rlike(to_java(P.NGINX_ERROR_LINE))


def is_syslog(raw: Column) -> Column:
    return raw.rlike(to_java(P.SYSLOG_LINE))


def detect_format(lines: DataFrame) -> DataFrame:
    """One row (file, format) per file of numbered lines.

    JSON needs a strict majority over both others; nginx wins ties with Apache, since every
    nginx access line looks like an Apache line as well.
    """
    sample = lines.where(F.col("line_number") <= P.DETECTION_LINES).select(
        "file", strip(F.col("value")).alias("raw")
    )
    counts = sample.groupBy("file").agg(
        *[F.count_if(is_kind).alias(kind) for kind, is_kind in votes(F.col("raw")).items()]
    )
    return counts.select("file", elected().alias("format"))


def votes(raw: Column) -> dict[str, Column]:
    """What a stripped line speaks for."""
    return {"json": is_json(raw), "apache": is_apache(raw), "nginx": is_nginx(raw)}


def elected() -> Column:
    """The format by the counts of votes, which are columns of these names."""
    json, apache, nginx = F.col("json"), F.col("apache"), F.col("nginx")
    return (
        F.when((json > apache) & (json > nginx), "json")
        .when((nginx >= apache) & (nginx > 0), "nginx")
        .when(apache > 0, "apache")
        .otherwise("custom")
    )


def with_format(lines: DataFrame, formats: DataFrame) -> DataFrame:
    """Add the ``format`` of its file to each line; files not listed get ``custom``."""
    placed = attach(lines, cut_lineage(formats), ["file"])
    return placed.withColumn("format", F.coalesce("format", F.lit("custom")))
