"""Approximate nearest neighbours by cosine, with an inverted multi-index."""

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.session import cut_lineage

from .text import pair_hash, sampled

#: Vectors and queries that one task compares at most, on average.
BLOCK_VECTORS, BLOCK_QUERIES = 8_192, 4_096


def nearest_centroid(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (points @ centroids.T * -2 + (centroids**2).sum(axis=1)).argmin(axis=1)


def learn_centroids(points: np.ndarray, count: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means from a seeded start; a centroid that gets no point stays where it is."""
    different = np.unique(points, axis=0)
    centroids = different[np.random.default_rng(seed).permutation(len(different))[:count]]
    for _ in range(rounds):
        near = nearest_centroid(points, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, points)
        sizes = np.bincount(near, minlength=len(centroids))[:, None]
        centroids = np.where(sizes > 0, sums / np.maximum(sizes, 1), centroids)
    return centroids


@dataclass
class MultiIndex:
    """Two codebooks, one for each half of unit vectors; a cell is a pair of codes."""

    first: np.ndarray
    second: np.ndarray
    half: int
    share: float = 1.0

    def cells(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return nearest_centroid(units[:, : self.half], self.first), nearest_centroid(units[:, self.half :], self.second)

    def traverse(self, unit: np.ndarray, sizes: np.ndarray, enough: float) -> list[tuple[int, int]]:
        """Cells by increasing summed distance, until they hold ``enough`` vectors.

        A heap holds the border of the visited corner of the table of centroid pairs, whose
        rows and columns are in order of distance.
        """
        d1 = ((self.first - unit[: self.half]) ** 2).sum(axis=1)
        d2 = ((self.second - unit[self.half :]) ** 2).sum(axis=1)
        o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
        heap = [(d1[o1[0]] + d2[o2[0]], 0, 0)]
        found, held = [], 0
        while heap and held < enough:
            _, r, c = heapq.heappop(heap)
            if sizes[o1[r], o2[c]]:
                found.append((int(o1[r]), int(o2[c])))
                held += sizes[o1[r], o2[c]]
            if c + 1 < len(o2):
                heapq.heappush(heap, (d1[o1[r]] + d2[o2[c + 1]], r, c + 1))
            if c == 0 and r + 1 < len(o1):
                heapq.heappush(heap, (d1[o1[r + 1]] + d2[o2[0]], r + 1, 0))
        return found


def unit_rows(vectors) -> np.ndarray:
    rows = np.stack([np.asarray(v, np.float64) for v in vectors])
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def fit_index(sample: np.ndarray, codes: int, k: int, recall: float, seed: int) -> MultiIndex:
    """Codebooks from a sample of unit vectors, and the share of vectors to visit.

    The share is the smallest step at which the index finds ``recall`` of the ``k`` nearest of
    200 sampled vectors among the sample, as brute force has them. Larger tables need less.
    """
    half = sample.shape[1] // 2
    index = MultiIndex(learn_centroids(sample[:, :half], codes, seed), learn_centroids(sample[:, half:], codes, seed), half)
    a, b = index.cells(sample)
    sizes = np.zeros((len(index.first), len(index.second)), np.int64)
    np.add.at(sizes, (a, b), 1)
    probes = np.arange(0, len(sample), max(1, len(sample) // 200))[:200]
    nearness = sample[probes] @ sample.T
    nearness[np.arange(len(probes)), probes] = -np.inf
    best = np.argsort(-nearness, axis=1)[:, : min(k, len(sample) - 1)]
    if not best.size:
        return index
    routes = [index.traverse(sample[p], sizes, np.inf) for p in probes]
    needed = []  # share of the table at which each true neighbour is met
    for route, near in zip(routes, best, strict=True):
        held = np.cumsum([sizes[c] for c in route]) / len(sample)
        at = {c: i for i, c in enumerate(route)}
        needed += [held[at[a[n], b[n]]] for n in near]
    index.share = float(np.quantile(needed, recall))
    return index


def usable(vector: Column) -> Column:
    return F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0),
        F.lit(False),
    )


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    codes: int = 32,
    sample_rows: int = 20_000,
    recall: float = 0.97,
    seed: int = 5,
) -> DataFrame:
    """``query_id, rank, id_col, score`` of the ``k`` nearest found rows of each query row.

    Equal vectors are one entry of the index with their ``k + 1`` smallest ids, which is all that
    an answer can need. The index is fitted on about ``sample_rows`` entries (a bound for fitting
    only), and holds all of them. Each half of a unit vector gets its nearest code. A query
    visits pairs of codes by summed distance, until it has met the share of entries that reached
    ``recall`` on the sample. Entries and queries meet by the first code, in blocks of bounded
    size, and are ranked by their exact cosine in double precision.

    * Null or zero vectors, vectors with null or non-finite components, of another length than
      most, or with a null id take no part; a query among them has no answer.
    * A row is no neighbour of a row with the same id. Ties go to the smaller id.
    * Fewer than ``k`` other rows give shorter answers; an empty table gives none.
    * Columns but the two, and those of ``is_query``, are not looked at.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    kind = vectors.schema[id_col].dataType.simpleString()
    out_schema = f"query_id {kind}, ids array<{kind}>, score double"
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, {id_col} {kind}, score double")
    rows = rows.filter(F.size("v") == lengths["n"])
    h1, h2 = pair_hash(F.col("v"))
    smallest = Window.partitionBy("h1", "h2").orderBy("id")
    entries = (
        rows.select("id", "v", h1.alias("h1"), h2.alias("h2"))
        .withColumn("nth", F.row_number().over(smallest)).filter(F.col("nth") <= k + 1)
        .groupBy("h1", "h2").agg(F.sort_array(F.collect_set("id")).alias("ids"), F.first("v").alias("v"))
    )
    entries = cut_lineage(entries.select("ids", "v"))
    total = entries.count()
    share = min(1.0, sample_rows / max(1, total))
    sample = unit_rows(entries.filter(sampled(share, F.lit(1), F.col("v"))).select("v").toPandas()["v"])
    index = fit_index(sample[np.lexsort(sample.T)], codes, k, recall, seed)

    def coded(frames):
        for frame in frames:
            if len(frame):
                a, b = index.cells(unit_rows(frame["v"]))
                yield frame.assign(a=a.astype(np.int32), b=b.astype(np.int32))

    placed = cut_lineage(entries.mapInPandas(coded, f"ids array<{kind}>, v array<double>, a int, b int"))
    sizes = np.zeros((len(index.first), len(index.second)), np.int64)  # bounded: codes by codes
    for cell in placed.groupBy("a", "b").count().collect():
        sizes[cell["a"], cell["b"]] = cell["count"]
    blocks = [int(x) for x in np.maximum(1, -(-sizes.sum(axis=1) // BLOCK_VECTORS))]
    asking = rows.filter(F.coalesce("asks", F.lit(False))).select("id", "v").dropDuplicates(["id", "v"])
    query_blocks = max(1, -(-asking.count() // BLOCK_QUERIES))

    def routed(frames):
        for frame in frames:
            out = []
            for query, vector in zip(frame["id"], frame["v"], strict=True):
                route: dict[int, list[int]] = {}
                for a, b in index.traverse(unit_rows([vector])[0], sizes, index.share * total):
                    route.setdefault(a, []).append(b)
                out += [(query, vector, a, sorted(bs)) for a, bs in route.items()]
            if out:
                yield pd.DataFrame(out, columns=["id", "v", "a", "bs"])

    table = F.array(*map(F.lit, blocks))
    parts = F.element_at(table, F.col("a") + 1)
    routes = asking.mapInPandas(routed, f"id {kind}, v array<double>, a int, bs array<int>")
    routes = routes.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int")).withColumn(
        "s", F.explode(F.sequence(F.lit(0), parts - 1)))
    holders = placed.withColumn("s", F.pmod(F.xxhash64("v"), parts).cast("int")).withColumn(
        "q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def compare(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(held):
            asked = np.stack(queries["v"].to_numpy())
            stored = np.stack(held["v"].to_numpy())
            norms = np.linalg.norm(asked, axis=1), np.linalg.norm(stored, axis=1)
            near = (asked / norms[0][:, None]) @ (stored / norms[1][:, None]).T
            code = held["b"].to_numpy()
            for i, bs in enumerate(queries["bs"]):
                visited = np.zeros(len(index.second), bool)
                visited[np.asarray(bs)] = True
                at = np.flatnonzero(visited[code])
                if len(at) > k + 1:
                    at = at[np.argpartition(-near[i, at], k)[: k + 1]] if not _tied(near[i, at], k) else _with_ties(near[i], at, k)
                exact = (asked[i] * stored[at]).sum(axis=1) / (norms[0][i] * norms[1][at])
                out += [(queries["id"].iloc[i], held["ids"].iloc[j], s) for j, s in zip(at.tolist(), exact.tolist(), strict=True)]
        return pd.DataFrame(out, columns=["query_id", "ids", "score"])

    met = routes.groupBy("a", "s", "q").cogroup(holders.groupBy("a", "s", "q")).applyInPandas(compare, out_schema)
    found = met.select("query_id", F.explode("ids").alias("_id"), "score").filter("_id <> query_id")
    found = found.dropDuplicates(["query_id", "_id"])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("_id").alias(id_col), "score")


def _tied(near: np.ndarray, k: int) -> bool:
    """Whether more than one vector is as near as the last that is kept, but for rounding."""
    last = np.partition(-near, k)[k]
    return int((np.abs(near + last) < 1e-12).sum()) > 1


def _with_ties(near: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    last = -np.partition(-near[at], k)[k]
    return at[near[at] >= last - 1e-12]
