"""Bring facts about files or blocks of files to the lines of them."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side is sent to every executor only if its measured size is below this.
BROADCAST_BYTES = 64 << 20
# Beyond it, lines of one key are spread over this many parts of the shuffle.
SPREAD = 64


def fits_broadcast(side: DataFrame, limit: int | None = None) -> bool:
    """Measure a materialised side: 64 bytes a row plus its texts."""
    limit = BROADCAST_BYTES if limit is None else limit
    texts = [F.octet_length(name) for name, kind in side.dtypes if kind == "string"]
    row = sum(texts, F.lit(64))
    measured = side.agg(F.sum(row.cast("bigint"))).first()[0] or 0
    return measured <= limit


def attach(
    lines: DataFrame,
    side: DataFrame,
    keys: Sequence[str],
    bounded_groups: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Left join of ``side``, which holds one row per key, to ``lines``.

    ``side`` must be materialised: it is measured first. A small side is broadcast and the
    lines stay where they are. A large one is joined by a shuffle; unless the caller knows
    that ``bounded_groups`` of lines share a key, each key is spread over ``SPREAD`` parts,
    so that a file with a third of all lines does not become one task.
    """
    keys = list(keys)
    if fits_broadcast(side, limit):
        return lines.join(F.broadcast(side), keys, "left")
    if bounded_groups:
        return lines.join(side.hint("shuffle_hash"), keys, "left")
    spread = side.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    part = F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("int")
    return lines.withColumn("_part", part).join(spread, [*keys, "_part"], "left").drop("_part")
