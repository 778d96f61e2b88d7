"""Mixing sources to target weights by Sainte-Laguë quotas of equal-token blocks."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.session import cut_lineage

from .text import count_words, words_of

#: So many sources at most are broadcast, one short row each; more are joined by a shuffle.
SMALL_SOURCES = 2_000


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Add ``no``, ``weight`` and ``target`` to ``source, source_size``: ``share`` of all sizes, dealt by weight.

    Weights repeat over the sources in code point order, null last. No target passes ``cap``
    times its source's size; the excess goes to the others by weight until none is above. That
    end state has one level: sources below it in ``cap * size / weight`` are full, the others
    get ``level * weight``. There is one row per source here, so one task orders them.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    fill = Window.orderBy("full_at", "no")
    rest = Window.partitionBy(F.lit(0))
    ranked = (
        sources.withColumn("no", F.row_number().over(order))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("no") - 1) % len(weights) + 1))
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("full_at", F.col("most") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(rest) * F.lit(float(share)))
        .withColumn("before", F.coalesce(F.sum("most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("weight_left"))
    )
    open_ = F.col("level") <= F.col("full_at")
    level = F.min_by(F.when(open_, F.col("level")), F.when(open_, F.struct("full_at", F.col("no")))).over(rest)
    return ranked.withColumn("level", F.coalesce(level, F.lit(float("inf")))).select(
        "no", "source", "source_size", "weight",
        F.least("most", F.col("level") * F.col("weight")).alias("target"),
    )


def sainte_lague(votes: DataFrame, group: Sequence[str], key: Sequence[str], vote: str, seats: str, most: str) -> DataFrame:
    """Give ``seats`` of each group to its keys by the highest quotients ``vote / (2k + 1)``.

    Adds ``quota``. No key gets more than ``most`` seats. Seats that the divisor method gives
    in any case are not listed; only quotients near the last seat are, two or so for each key,
    and a window ranks them. Ties go to the smaller key.
    """
    whole = Window.partitionBy(*group)
    n = F.count(F.lit(1)).over(whole)
    base = (
        votes.withColumn("_sum", F.sum(vote).over(whole))
        .withColumn("_high", F.when(F.col(seats) > n / 2, F.col("_sum") / (F.col(seats) - n / 2)))
        .withColumn("_low", F.col("_sum") / (F.col(seats) + n / 2))
    )
    sure = F.when(F.col("_high") > 0, F.floor(F.col(vote) / F.col("_high") + F.lit(0.5))).otherwise(0)
    last = F.when(F.col("_low") > 0, F.ceil(F.col(vote) / F.col("_low") + F.lit(0.5)) + 1).otherwise(0)
    base = base.withColumn("_sure", F.greatest(F.least(sure, F.col(most)) - 1, F.lit(0)).cast("long"))
    base = base.withColumn("_last", F.greatest(F.least(last, F.col(most)), F.col("_sure")).cast("long"))
    base = base.withColumn("_open", F.col(seats) - F.sum("_sure").over(whole))
    keys = [*group, *key]
    ranked = base.filter("_last > _sure").select(
        *keys, "_open", F.col(vote).alias("_vote"), F.explode(F.sequence("_sure", F.col("_last") - 1)).alias("_k")
    ).withColumn(
        "_rank",
        F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(F.col("_vote") / (2 * F.col("_k") + 1)), *key, "_k")),
    )
    won = ranked.filter("_rank <= _open").groupBy(*keys).agg(F.count(F.lit(1)).alias("_won"))
    return base.join(won, keys, "left").select(*votes.columns, (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias("quota"))


def overlap(start: Column, size: Column, first: Column, length: Column, around: Column) -> Column:
    """Words of ``[start, start + size)`` within ``length`` words from ``first`` on, in a ring."""
    end = first + length
    plain = F.greatest(F.least(start + size, end) - F.greatest(start, first), F.lit(0))
    wrapped = F.greatest(F.least(start + size, end - around) - start, F.lit(0))
    return plain + wrapped


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    cap: float = 2.0,
    block: int = 8,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How many words of each document the mix takes: ``row`` (its columns) and ``mix_*``.

    Sources get integer numbers of equal blocks of words by Sainte-Laguë. A block has ``block`` words,
    or fewer where a source's target would be under a thousand blocks, so each source is
    within half a block, 0.05 % or one word, of its target. Sources are cut into shards by a
    seeded hash, about as many as the root of their number of documents, so that neither a shard
    nor the list of shards grows with the whole source; a source's words are shared among its
    shards by Sainte-Laguë again. A shard's documents stand in seeded order, as one ring of
    words. It takes the ring as often as its quota allows, and for the remainder a run of words
    from a seeded place on; so most documents are taken whole, 0, 1 or 2 times.

    Added: ``mix_size`` (words), ``mix_source_size``, ``mix_target``, ``mix_taken`` (words,
    repeats counted), ``mix_rounds`` (times the whole document is taken) and ``mix_spans``
    (word ranges ``[from, to)`` taken once more).

    * A null text has no words; null is a source of its own, the last one.
    * Documents of no words are taken with 0 words. An empty table gives no rows.
    * Repeated rows are documents of their own. Ties in the seeded order are broken by id, size
      and text; rows equal in all may change places, which changes no number.
    * Other columns are not looked at, whatever their names; ``row`` has them as they came.
    """
    rows = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        count_words(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col).cast("string")).alias("place"),
        F.xxhash64(text_col).alias("text_hash"),
    )
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    sources = sources.withColumn("shards", F.ceil(F.sqrt("source_docs")).cast("int"))
    targets = source_targets(sources.select("source", "source_size"), weights, share, cap)
    every = Window.partitionBy(F.lit(0))
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(every)
    targets = targets.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(least / 1000))).cast("long"))
    targets = targets.withColumn("seats", F.round(F.sum("target").over(every) / F.col("block")).cast("long"))
    targets = targets.withColumn("most", F.floor(F.col("source_size") * cap / F.col("block"))).withColumn("all", F.lit(0))
    quotas = sainte_lague(targets, ["all"], ["no"], "target", "seats", "most")
    shards = sources.select(F.col("source").alias("same_source"), "shards")
    facts = cut_lineage(
        quotas.join(shards, F.col("source").eqNullSafe(F.col("same_source")))
        .select("no", "source", "source_size", "target", (F.col("quota") * F.col("block")).alias("quota"), "shards")
    )
    known = facts.withColumnRenamed("source", "same_source")
    if facts.count() <= SMALL_SOURCES:
        known = F.broadcast(known)

    rows = rows.join(known, F.col("source").eqNullSafe(F.col("same_source")))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "place"), F.col("shards")).cast("int"))
    shards = rows.groupBy("no", "shard").agg(
        F.sum("size").alias("ring"),
        F.first("source_size").alias("whole"),
        F.first("target").alias("aim"),
        F.first("quota").alias("seats"),
    )
    shards = shards.filter("ring > 0").withColumn("vote", F.col("aim") * F.col("ring") / F.col("whole"))
    shards = shards.withColumn("most", F.floor(F.col("ring") * cap))
    shards = sainte_lague(shards, ["no"], ["shard"], "vote", "seats", "most").select(
        "no", "shard", "ring",
        F.floor(F.col("quota") / F.col("ring")).alias("rounds"),
        F.pmod(F.xxhash64(F.lit(seed + 2), "no", "shard"), F.col("ring")).alias("first"),
        (F.col("quota") % F.col("ring")).alias("length"),
    )
    line = Window.partitionBy("no", "shard").orderBy("place", "id", "size", "text_hash")
    before = F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = rows.withColumn("start", before).join(shards, ["no", "shard"], "left")
    rounds, start, size = F.coalesce("rounds", F.lit(0)), F.col("start"), F.col("size")
    extra = F.coalesce(overlap(start, size, F.col("first"), F.col("length"), F.col("ring")), F.lit(0))
    end = F.col("first") + F.col("length")
    span = lambda a, b: F.struct(a.cast("long").alias("from"), b.cast("long").alias("to"))
    spans = F.filter(
        F.array(
            span(F.greatest(start, F.col("first")) - start, F.least(start + size, end) - start),
            span(F.lit(0), F.least(start + size, end - F.col("ring")) - start),
        ),
        lambda s: s["to"] > s["from"],
    )
    return placed.select(
        "row", size.alias("mix_size"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"),
        (rounds * size + extra).cast("long").alias("mix_taken"),
        rounds.cast("long").alias("mix_rounds"),
        F.when(extra > 0, spans).otherwise(F.array().cast("array<struct<from:bigint,to:bigint>>")).alias("mix_spans"),
    )


def taken_rows(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The mix as documents: a row for each time one is taken, with the columns that were mixed.

    A whole document keeps its text; a document cut by the end of a run gives the words of
    its span, joined by single spaces. Documents of no words, which no quota counts, stay.
    """
    span, size, text = F.col("mix_span"), F.col("mix_size"), F.col("row")[text_col]
    one = lambda a, b: F.struct(a.cast("long").alias("from"), b.cast("long").alias("to"))
    wholes = F.transform(
        F.when(F.col("mix_rounds") > 0, F.sequence(F.lit(1), F.col("mix_rounds"))).otherwise(F.array().cast("array<bigint>")),
        lambda _: one(F.lit(0), size),
    )
    pieces = F.when(size == 0, F.array(one(F.lit(0), F.lit(0)))).otherwise(F.concat(wholes, F.col("mix_spans")))
    out = mixed.select("row", "mix_size", F.explode(pieces).alias("mix_span"))
    cut = F.array_join(F.slice(words_of(text), (span["from"] + 1).cast("int"), (span["to"] - span["from"]).cast("int")), " ")
    taken = F.when((span["from"] == 0) & (span["to"] == size), text).otherwise(cut)
    fields = mixed.schema["row"].dataType.names
    return out.select(*[(taken if c == text_col else F.col("row")[c]).alias(c) for c in fields])
