"""Near duplicates: a self-join on the Jaccard similarity of word shingles, by a MinHash LSH forest."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweir.session import cut_lineage

from .graphs import connected_components
from .text import words_of

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Words handled in one go in a task, shingles of a block, and columns of a matrix.
SLICE_WORDS, BLOCK_SHINGLES, COLUMNS = 400_000, 200_000, 4_096


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits, each of which depends on all bits of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_depth(threshold: float, trees: int, max_depth: int, recall: float) -> int:
    """The longest prefix that finds a pair at the threshold with the target recall.

    Starts from whole signatures, ``max_depth`` long, and shortens them until enough is found.
    """
    for depth in range(max_depth, 1, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    return 1


def shingle_sets(flat: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one after another, and their numbers.

    A document of fewer than ``width`` words has one shingle, all of its words.
    """
    words, out = flat.view(np.uint64), []
    seed = MULTIPLIER
    for start, size in zip(np.cumsum(sizes) - sizes, sizes, strict=True):
        own = words[start : start + size]
        span = min(width, size)
        if not span:
            out.append(own)
            continue
        total = np.full(size - span + 1, np.uint64(span))
        for k in range(span):
            total = total * seed + own[k : size - span + 1 + k]
        out.append(np.unique(mixed(total)))
    return np.concatenate(out) if out else words, np.fromiter(map(len, out), np.int64, len(out))


def set_keys(sets: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    """128 bits that name a set of shingles; None for the empty set."""
    full = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[full]
    keys: list[bytes | None] = [None] * len(sizes)
    if len(full):
        a = np.add.reduceat(mixed(sets), starts)
        b = np.add.reduceat(mixed(sets ^ MULTIPLIER), starts)
        for i, x, y in zip(full.tolist(), a.tolist(), b.tolist(), strict=True):
            keys[i] = x.to_bytes(8, "big") + y.to_bytes(8, "big")
    return keys


class Forest:
    """Prefixes of MinHash signatures, one for each tree, cut at the depth that recall needs."""

    def __init__(self, trees: int, depth: int, seed: int) -> None:
        draw = np.random.default_rng(seed)
        self.trees, self.depth = trees, depth
        self.factors = draw.integers(1, 2**63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.terms = draw.integers(0, 2**63, trees * depth, dtype=np.uint64)

    def prefixes(self, sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """An array of documents by trees; every set must have a shingle."""
        starts = np.cumsum(sizes) - sizes
        out = np.zeros((len(sizes), self.trees), np.uint64)
        for tree in range(self.trees):
            for level in range(tree * self.depth, (tree + 1) * self.depth):
                least = np.minimum.reduceat(sets * self.factors[level] + self.terms[level], starts)
                out[:, tree] = mixed(out[:, tree] * MULTIPLIER + least)
        return out.view(np.int64)


def slices(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    """Ranges of documents of about ``limit`` words, a longer document alone."""
    at = 0
    total = np.cumsum(sizes)
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, "right")))
        yield slice(at, end)
        at = end


def hashed_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.transform(words_of(F.col(text_col)), lambda w: F.xxhash64(w)).alias("words"))


def sets_of_batch(column: pa.Array, width: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Slices of a list column of word hashes, with their sets and set sizes."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for part in slices(sizes, SLICE_WORDS):
        yield part, *shingle_sets(flat[offsets[part.start] : offsets[part.stop]], sizes[part], width)


def signed_sets(docs: DataFrame, id_col: str, text_col: str, width: int, forest: Forest) -> DataFrame:
    """``id, key, n, prefixes`` of each document; key and prefixes are null without words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets, sizes in sets_of_batch(batch.column(1), width):
                keys = set_keys(sets, sizes)
                prefixes: list = [None] * len(sizes)
                full = np.flatnonzero(sizes)
                if len(full):
                    for i, row in zip(full.tolist(), forest.prefixes(sets, sizes[full]).tolist(), strict=True):
                        prefixes[i] = row
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part], pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))],
                    ["id", "key", "n", "prefixes"],
                )

    return hashed_words(docs, id_col, text_col).mapInArrow(sign, f"id {kind}, key binary, n long, prefixes array<long>")


def sets_again(docs: DataFrame, width: int) -> DataFrame:
    """``id, key, shingles`` of documents with columns ``id, words``."""
    kind = docs.schema["id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets, sizes in sets_of_batch(batch.column(1), width):
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part], pa.array(set_keys(sets, sizes), pa.binary()), lists], ["id", "key", "shingles"]
                )

    return docs.select("id", "words").mapInArrow(build, f"id {kind}, key binary, shingles array<long>")


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which sets of ``left`` and ``right`` are similar, as a matrix; exact."""
    sets = [*left, *right]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    renumber = np.cumsum(count > 1) - 1  # a shingle of one set only adds to no intersection
    keep = count[column] > 1
    owner, column = owner[keep], renumber[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        present = np.zeros((len(sets), COLUMNS), np.float32)
        present[owner[a:b], column[a:b] - first] = 1
        common += present[: len(left)] @ present[len(left) :].T
    union = sizes[: len(left), None] + sizes[None, len(left) :] - common
    return common >= threshold * union - 1e-6


def verify_block_pair(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links between two blocks of a component (or within one), by document and in sum.

    Gives a row for each set that has links: their number, copies counted, and the smallest set
    that it reaches by links of this pair of blocks.
    """
    i, j = frame["i"].iloc[0], frame["j"].iloc[0]
    left = frame[frame["block"] == i]
    right = left if i == j else frame[frame["block"] == j]
    empty = pd.DataFrame({"a": [], "b": [], "links": []})
    if not len(left) or not len(right):
        return empty
    similar = similar_pairs(left["shingles"].tolist(), right["shingles"].tolist(), threshold)
    if i == j:
        np.fill_diagonal(similar, False)
    lines = [(left, similar, right)] + ([] if i == j else [(right, similar.T, left)])
    keys = np.array([*left["key"], *([] if i == j else right["key"])], object)
    root = np.argsort(np.argsort(keys))  # ranks stand for keys
    a, b = np.nonzero(similar)
    if i != j:
        b = b + len(left)
    while True:  # smallest rank along links
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        if (new == root).all():
            break
        root = new
    links = np.concatenate([m @ other["copies"].to_numpy(np.int64) for _, m, other in lines])
    some = np.flatnonzero(np.concatenate([m.any(axis=1) for _, m, _ in lines]))
    ranked = np.sort(keys)
    return pd.DataFrame({"a": keys[some], "b": ranked[root[some]], "links": links[some]})


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    threshold: float = 0.8,
    trees: int = 24,
    max_depth: int = 8,
    recall: float = 0.99999,
    seed: int = 17,
) -> DataFrame:
    """``id_col, class_id, n_links`` for each row of ``docs``.

    Two rows are linked if the Jaccard similarity of their sets of ``width``-word shingles is at
    least ``threshold``. ``n_links`` counts a row's links, ``class_id`` is the smallest id that
    its links lead to, over any number of steps.

    1. Equal sets are one class from here on; its copies are only counted.
    2. A forest of ``trees`` tries over MinHash signatures finds candidates: classes that share a
       prefix in a tree. Prefixes are shortened from ``max_depth`` until a pair at the threshold
       is found with the target ``recall``. A prefix's classes are tied to the smallest one.
    3. Classes connected by such ties are compared exactly. Groups are cut into blocks of
       bounded size; a task takes a pair of blocks, counts links and ties what is linked to its
       smallest class, so that pairs are never listed.

    * A text without words (null, empty, blank) is linked to nothing; its class is itself.
      With fewer than ``width`` words, all words are the one shingle.
    * Equal texts are linked, repeated rows and rows with the same id included.
    * A null id takes part; ``class_id`` ignores it where another id is in the class.
    * An empty table gives no rows. Columns but the two are not looked at.
    """
    depth = prefix_depth(threshold, trees, max_depth, recall)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = cut_lineage(signed_sets(slim, "id", "text", width, Forest(trees, depth, seed)))
    classes = cut_lineage(
        signed.filter("key IS NOT NULL").groupBy("key")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.first("prefixes").alias("prefixes"))
    )
    entries = classes.select("key", F.posexplode("prefixes").alias("tree", "prefix"))
    nodes = entries.groupBy("tree", "prefix").agg(F.min("key").alias("b"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    ties = entries.join(nodes, ["tree", "prefix"]).filter("key <> b").select(F.col("key").alias("a"), "b").distinct()
    groups = connected_components(ties)

    members = groups.withColumnRenamed("node", "key").join(classes.drop("prefixes"), "key")
    sizes = members.groupBy("component").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    members = cut_lineage(members.join(sizes, "component").select(
        "key", "id", "copies", "component", "blocks", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block")))
    chosen = members.select(F.col("id").alias("member")).distinct()
    texts = slim.join(chosen, F.col("id").eqNullSafe(F.col("member"))).select("id", "text")
    sets = sets_again(hashed_words(texts, "id", "text"), width).select("key", "shingles")
    placed = members.join(sets, "key").dropDuplicates(["key"])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = placed.select("key", "copies", "component", "block", "shingles", other.alias("other")).select(
        "key", "copies", "component", "block", "shingles", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        return verify_block_pair(frame, threshold)

    linked = cut_lineage(pairs.groupBy("component", "i", "j").applyInPandas(verify, "a binary, b binary, links long"))
    counts = linked.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "key")
    united = connected_components(linked.select("a", "b"))
    united = united.withColumnRenamed("node", "key").join(classes.select("key", "id"), "key")
    least = united.groupBy("component").agg(F.min("id").alias("least"))
    facts = united.join(least, "component").join(counts, "key").select("key", "least", "links")
    facts = classes.select("key", "id", "copies").join(facts, "key", "left").select(
        F.col("key").alias("class_key"), F.coalesce("least", "id").alias("class_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    out = signed.select("id", "key").join(facts, F.col("key") == F.col("class_key"), "left")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those whose class has a row with a smaller id.

    Of rows equal in id one stays, and all rows without words stay. Columns are those of
    ``docs``, whatever their names; an empty table gives no rows.
    """
    classes = near_duplicates(docs, id_col, text_col).filter("n_links > 0")
    later = classes.select(F.col(id_col).alias("member"), F.col("class_id").alias("class")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(later, F.col("id").eqNullSafe(F.col("member")), "left")
    first = Window.partitionBy("class").orderBy(F.col("id").asc_nulls_last(), "text")
    kept = rows.filter("class IS NOT NULL").withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    return rows.filter("class IS NULL").select("row").unionByName(kept.select("row")).select("row.*")
