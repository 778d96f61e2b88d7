"""Column expressions on texts that several operators share."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters that separate words and are stripped from lines.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where the body is a lambda."""
    return F.transform(F.array(value), body)[0]


def whole(text: Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(text, F.lit(""))


def words_of(text: Column) -> Column:
    """Maximal runs of other characters than :data:`BLANKS`; an empty array for null."""
    bare = F.btrim(whole(text), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def count_words(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is. Pure ASCII takes Spark's fast path."""
    upper = "".join(map(chr, range(65, 91)))
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def pair_hash(*parts: Column) -> tuple[Column, Column]:
    """128 bits as two independently seeded 64-bit hashes."""
    return F.xxhash64(*parts), F.xxhash64(F.lit(0x5EED), *parts)


def sampled(share: float, *parts: Column) -> Column:
    """True for about ``share`` of the values, chosen by a hash of 64 bits."""
    return F.lit(True) if share >= 1 else F.xxhash64(*parts) < F.lit(int(share * 2**64) - 2**63)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
