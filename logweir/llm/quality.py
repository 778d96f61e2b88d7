"""Quality rules: a decision list of threshold conjunctions, learned by sequential covering."""

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.session import cut_lineage

from .text import BLANKS, let, sampled, whole, words_of

#: The statistics that rules may test.
FEATURES = ("n_words", "mean_word", "symbol_share", "upper_share", "mark_share", "dup_line_share", "repeat_share")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, (c.column() for c in rule), F.lit(True))


def verdict(rules: list[Rule]) -> Column:
    """The number (from 1) of the first rule that covers a row, 0 if none does."""
    out = F.lit(0)
    for number in range(len(rules), 0, -1):
        out = F.when(covers(rules[number - 1]), F.lit(number)).otherwise(out)
    return out


def repeated_positions(words: Column) -> Column:
    """How many words stand in 3-word windows that occur twice or more.

    Windows are sorted by a 64-bit hash and their place, which brings equal ones together. The
    words are bound first: a filter pushed below the split would else split the text again per window.
    """
    return let(words, _repeated)


def _repeated(words: Column) -> Column:
    def window(i: Column) -> Column:
        return F.struct(F.xxhash64(words[i], words[i + 1], words[i + 2]).alias("gram"), i.alias("place"))

    def again(keys: Column) -> Column:
        last = F.size(keys) - 1
        gram = lambda j: keys[j]["gram"]
        twin = lambda x, j: ((j > 0) & (x["gram"] == gram(F.greatest(j - 1, F.lit(0))))) | (
            (j < last) & (x["gram"] == gram(F.least(j + 1, last)))
        )
        return F.sort_array(F.transform(F.filter(keys, twin), lambda x: x["place"]))

    places = let(F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), window)), again)
    state = lambda last, n: F.struct(last.cast("long").alias("last"), n.cast("long").alias("n"))
    count = F.aggregate(
        places, state(F.lit(-3), F.lit(0)),
        lambda s, p: state(p, s["n"] + F.least(F.lit(3).cast("long"), p - s["last"])), lambda s: s["n"],
    )
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(count)


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add word and line counts of whole texts, the shares made from them, and ``base_failed``.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` as the base
    rule needs them, and :data:`FEATURES`. A null or empty text has no words and zeros in all.
    Columns of ``docs`` are kept, so those names must be free.
    """
    t, w = whole(F.col(text_col)), F.col("_words")
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    left = lambda pattern: F.length(F.regexp_replace(t, pattern, "")).cast("long")

    def dup_lines(lines: Column) -> Column:
        with_word = F.filter(lines, lambda x: F.btrim(x, F.lit(BLANKS)) != "")
        return let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")

    return (
        docs.withColumn("_words", words_of(F.col(text_col)))
        .select(
            *docs.columns,
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            left(r"[^#*$%&|<>]+").alias("n_symbols"),
            dup_lines(F.split(t, "\n")).alias("n_dup_lines"),
            repeated_positions(w).alias("n_repeat_words"),
            left(r"[^\p{Lu}]+").alias("_upper"),
            left(r"[\p{L}\p{N}\s]+").alias("_marks"),
            F.size(F.split(t, "\n")).cast("long").alias("_lines"),
        )
        .withColumns({
            "mean_word": ratio("word_chars", "n_words"),
            "symbol_share": ratio("n_symbols", "word_chars"),
            "upper_share": ratio("_upper", "word_chars"),
            "mark_share": ratio("_marks", "word_chars"),
            "dup_line_share": ratio("n_dup_lines", "_lines"),
            "repeat_share": ratio("n_repeat_words", "n_words"),
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        })
        .drop("_upper", "_marks", "_lines")
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, max_rows: int) -> DataFrame:
    """Documents that have a label, about ``max_rows`` at most, chosen by the id's hash.

    The sample's ids are few, and so are broadcast; texts are not shuffled.
    """
    labels = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    labels = labels.groupBy(id_col).agg(F.min(label_col).alias("_label"))
    share = min(1.0, max_rows / max(1, labels.count()))
    chosen = labels.filter(sampled(share, F.lit(9), F.col(id_col)))
    chosen = chosen.select(F.col(id_col).alias("_label_id"), "_label")
    return docs.join(F.broadcast(chosen), F.col(id_col) == F.col("_label_id")).drop("_label_id")


def _gain(before: tuple[int, int], after: tuple[int, int]) -> float:
    (p0, n0), (p1, n1) = before, after
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else 0.0


def learn_rules(
    stats: DataFrame,
    bad: Column,
    id_col: str,
    bins: int = 64,
    max_rules: int = 8,
    max_conditions: int = 3,
    min_support: int = 3,
    min_precision: float = 0.97,
) -> list[Rule]:
    """An ordered list of rules for ``bad`` rows of ``stats``, which hold :data:`FEATURES`.

    Two thirds of the rows (by hash of the id) grow a rule: conditions of the best
    information gain are added while rows that are not bad are covered. The last third prunes it:
    the beginning of best ``(bad - good) / (bad + good)`` stays. A rule is taken if among all rows
    that it newly covers at least ``min_precision`` are bad; then those rows go, and the
    next one is grown. The driver sees counts of feature and bin only, never rows.

    No rows, or none that is bad, gives no rules. Rows with the label null are left out.
    """
    cuts = stats.agg(*[F.percentile_approx(f, [i / bins for i in range(1, bins)], 10_000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(cuts[f] or ())) for f in FEATURES}
    if not any(cuts.values()):
        return []
    bin_of = lambda f: F.size(F.filter(F.array(*map(F.lit, cuts[f])), lambda c: c < F.col(f))) if cuts[f] else F.lit(0)
    rows = cut_lineage(
        stats.filter(bad.isNotNull()).select(
            *FEATURES, bad.cast("int").alias("_bad"),
            (F.pmod(F.xxhash64(F.lit(7), id_col), F.lit(3)) < 2).alias("_grow"),
            F.array(*[bin_of(f) for f in FEATURES]).alias("_bins"),
        )
    )

    def counts(frame: DataFrame, rules: list[Rule]) -> list[tuple[int, int]]:
        aggs = [F.sum(F.when(covers(r), y)) for r in rules for y in (F.col("_bad"), 1 - F.col("_bad"))]
        got = [int(v or 0) for v in frame.agg(*aggs).first()]
        return list(zip(got[::2], got[1::2], strict=True))

    def best_condition(frame: DataFrame, before: tuple[int, int]) -> Condition | None:
        cells = frame.select("_bad", F.posexplode("_bins").alias("f", "bin")).groupBy("f", "bin").agg(
            F.sum("_bad").alias("p"), F.sum(1 - F.col("_bad")).alias("n")).collect()
        best, found = 1e-9, None
        for i, feature in enumerate(FEATURES):
            by_bin = {c["bin"]: (c["p"], c["n"]) for c in cells if c["f"] == i}
            p = n = 0
            for b, cut in enumerate(cuts[feature]):
                p, n = p + by_bin.get(b, (0, 0))[0], n + by_bin.get(b, (0, 0))[1]
                for above, after in ((False, (p, n)), (True, (before[0] - p, before[1] - n))):
                    if after[0] >= min_support and (gain := _gain(before, after)) > best:
                        best, found = gain, Condition(feature, above, cut)
        return found

    rules: list[Rule] = []
    while len(rules) < max_rules:
        left = rows.filter(verdict(rules) == 0)
        grow, prune = left.filter("_grow"), left.filter("NOT _grow")
        rule: Rule = ()
        covered = counts(grow, [()])[0]
        while len(rule) < max_conditions and covered[0] >= min_support and covered[1]:
            condition = best_condition(grow.filter(covers(rule)), covered)
            if condition is None:
                break
            rule += (condition,)
            covered = counts(grow, [rule])[0]
        if not rule:
            break
        starts = [rule[:k] for k in range(1, len(rule) + 1)]
        worth = [((p - n) / (p + n) if p + n else -1.0, -k) for k, (p, n) in enumerate(counts(prune, starts))]
        rule = starts[-max(worth)[1]]
        p, n = counts(left, [rule])[0]
        if p < min_support or p < min_precision * (p + n):
            break
        rules.append(rule)
    return rules


def apply_rules(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``rule`` (first rule that covers the row, 0 for none) and ``kept``."""
    return stats.withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def judge_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_labelled: int = 50_000,
) -> tuple[DataFrame, list[Rule]]:
    """Statistics, ``rule`` and ``kept`` for each row of ``docs``, and the list that was learned.

    Rules are learned from at most about ``max_labelled`` rows of ``labels`` (label 0 is bad)
    that pass the base rule; without labels only the base rule judges. Judging is one narrow pass over all texts.
    Only ``id_col`` and the statistics are returned; other columns are not looked at.

    The statistics of the labelled rows are written once. A filter on them, pushed below the join
    with the labels, would else compute them for all rows.

    * A null or empty text has no words and fails the base rule.
    * Labels that are null or without an id are left out; of several for one id the smallest counts.
    * Repeated rows are judged alike, each for itself; an empty table gives no rows.
    """
    slim = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    sample = labelled_sample(slim, labels, id_col, label_col, max_labelled)
    passed = cut_lineage(text_statistics(sample, "_text").drop("_text")).filter(~F.col("base_failed"))
    rules = learn_rules(passed, F.col("_label") == 0, id_col)
    return apply_rules(text_statistics(slim, "_text").drop("_text"), rules), rules


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that base rule and learned list keep, with their columns and no others."""
    _, rules = judge_quality(docs, labels, id_col, text_col)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("_text"))
    return apply_rules(text_statistics(rows, "_text"), rules).filter("kept").select("_row.*")
