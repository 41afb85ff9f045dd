"""Nearest neighbours by largest inner product, through vantage-point trees per shard.

Vectors get one more component, sqrt(M^2 - |x|^2) with M the largest norm, so that the nearest in the
Euclidean metric has the largest inner product; queries get 0. Every shard of about ``SHARD_ROWS``
vectors has one tree over its distinct vectors: a node splits by the median distance to a vantage
point and keeps the distance range of each side. A side is left out when ``factor`` times the least
distance that the triangle inequality allows exceeds the distance of the worst result so far; factor
one gives the exact result, a larger one visits less. Distances are taken between vectors scaled by a power
of two; scores are inner products of the vectors as they are, so they may be infinite. Queries search all shards in blocks, near side
first, with numpy over the whole block; in a leaf a matrix product leaves out the rows that rounding cannot lift among the best, and only the
rest are summed row by row. The best of all shards are merged by a window.

Vectors that are null, zero, of another length than most, or with null or non-finite components take
no part, nor do rows without an id. Rows with the same id count once (the greatest vector). Equal
vectors are one tree entry with their k + 1 smallest ids, which is all that can be in a result. Ties
go to the smaller id. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlake.llm.common import stage

SHARD_ROWS = 8192
BLOCK_ROWS = 1024
LEAF_ROWS = 64
FACTOR = 1.0


def build(vectors: np.ndarray, ids: np.ndarray, norm: float, k: int, seed: int = 3, exponent: int = 0) -> dict:
    """A tree over the distinct rows of ``vectors``; distances are between vectors times 2**-exponent, and so is ``norm``."""
    order = np.argsort(ids, kind="stable")
    distinct, group = np.unique(vectors[order], axis=0, return_inverse=True)
    by_group = np.argsort(group, kind="stable")
    counts = np.bincount(group, minlength=len(distinct))
    within = np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)
    few = by_group[within <= k]  # ids rise inside a group
    members, held = ids[order][few], np.minimum(counts, k + 1)
    small = np.ldexp(distinct, -exponent)
    lifted = np.column_stack([small, np.sqrt(np.maximum(norm * norm - (small**2).sum(1), 0.0))])
    rng, nodes = np.random.default_rng(seed), []

    def grow(rows: np.ndarray) -> int:
        at = len(nodes)
        nodes.append(None)
        if len(rows) <= LEAF_ROWS:
            nodes[at] = (rows,)
            return at
        point = int(rows[rng.integers(len(rows))])
        rest = rows[rows != point]
        far = np.sqrt(((lifted[rest] - lifted[point]) ** 2).sum(1))
        half = len(rest) // 2
        split = np.argpartition(far, half)
        near, away = split[:half], split[half:]
        nodes[at] = (point, far[near].min(), far[near].max(), far[away].min(), far[away].max(), grow(rest[near]), grow(rest[away]))
        return at

    grow(np.arange(len(distinct)))
    return {"vectors": distinct, "lifted": lifted, "nodes": nodes, "members": members, "starts": np.concatenate([[0], np.cumsum(held)]), "norm": norm, "exponent": exponent}


def search(tree: dict, queries: np.ndarray, own: np.ndarray, k: int, factor: float = FACTOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the k best of the tree for every query, without the query's own id."""
    vectors, lifted, nodes, members, starts = (tree[x] for x in ("vectors", "lifted", "nodes", "members", "starts"))
    smallest, single = members[starts[:-1]], np.diff(starts) == 1
    n, exponent = len(queries), tree["exponent"]
    small = np.ldexp(queries, -exponent)
    flat = np.column_stack([small, np.zeros(n)])
    base = tree["norm"] ** 2 + (small**2).sum(1)
    best, which = np.full((n, k), -np.inf), np.full((n, k), -1)

    # how far a score of a matrix product may be from the row-wise sum; without such a bound every row is summed
    sure = 2 * exponent + np.log2(vectors.shape[1]) <= 1000
    slack = 4 * vectors.shape[1] * (np.finfo(float).eps * np.ldexp(np.sqrt((small**2).sum(1)) * tree["norm"], 2 * exponent if sure else 0) + np.finfo(float).tiny)

    def promising(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``at``, place in ``rows``) of the pairs that may be among the k best, by a matrix product with room for rounding."""
        if not sure:
            return np.indices((len(at), len(rows))).reshape(2, -1)
        rough, least = queries[at] @ vectors[rows].T, best[at, k - 1] - slack[at]
        if len(rows) > k + 1 and np.isneginf(least).any():
            # k + 1 rows at or above this one, at most one of them the query itself
            least = np.maximum(least, np.partition(rough, -k - 1, axis=1)[:, -k - 1] - 2 * slack[at])
        return np.nonzero(rough >= least[:, None])

    def offer(at: np.ndarray, rows: np.ndarray) -> None:
        query, row = promising(at, rows)
        other = ~(single[rows[row]] & (smallest[rows[row]] == own[at[query]]))
        query, row = query[other], row[other]
        # row-wise sums: the same pair gives the same number wherever it is met
        sums = np.einsum("nd,nd->n", queries[at[query]], vectors[rows[row]], optimize=False)
        # most queries hold k better ones already; only a score below the worst held is out, so neither a tie nor a not-a-number
        open_ = ~(sums < best[at[query], k - 1])
        query, row, sums = query[open_], row[open_], sums[open_]
        if not len(query):
            return
        changed, line, count = np.unique(query, return_inverse=True, return_counts=True)
        at, place = at[changed], k + np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
        scores, entry = np.full((len(at), k + count.max()), -np.inf), np.full((len(at), k + count.max()), -1)
        scores[:, :k], entry[:, :k] = best[at], which[at]
        scores[line, place], entry[line, place] = sums, rows[row]
        name = np.where(entry >= 0, smallest[entry], np.iinfo(np.int64).max)
        # as Spark and SQL order doubles: not-a-number above infinity
        missing = np.isnan(scores)
        keys = (name, -scores, ~missing) if missing.any() else (name, -scores)
        top = np.lexsort(keys, axis=1)[:, :k]
        best[at], which[at] = np.take_along_axis(scores, top, 1), np.take_along_axis(entry, top, 1)

    def reach(at: np.ndarray) -> np.ndarray:
        """Distance of the worst result held, with room for rounding."""
        worst, full = best[at, k - 1], which[at, k - 1] >= 0
        small = np.ldexp(np.where(full & np.isfinite(worst), worst, 0), -2 * exponent)
        return np.sqrt(np.maximum(base[at] - 2 * small, 0)) * (1 + 1e-9) + 1e-7 + np.where(full & np.isfinite(worst), 0, np.inf)

    def apart(node: int, at: np.ndarray) -> np.ndarray:
        return np.sqrt(((flat[at] - lifted[nodes[node][0]]) ** 2).sum(1))

    home = np.full(n, -1)

    def settle(node: int, at: np.ndarray) -> None:
        """Every query takes the leaf on its own side of all splits first, so that the walk begins with near bounds."""
        if not len(at):
            return
        entry = nodes[node]
        if len(entry) == 1:
            home[at] = node
            if len(entry[0]):
                offer(at, entry[0])
            return
        inside = apart(node, at) <= (entry[2] + entry[3]) / 2
        settle(entry[5], at[inside])
        settle(entry[6], at[~inside])

    def visit(node: int, at: np.ndarray) -> None:
        """All queries that a node may serve meet it at once."""
        entry = nodes[node]
        if len(entry) == 1:
            at = at[home[at] != node]
            if len(at) and len(entry[0]):
                offer(at, entry[0])
            return
        if not len(at):
            return
        point, near_low, near_high, far_low, far_high, near, far = entry
        offer(at, np.array([point]))
        d = apart(node, at)
        for child, low, high in ((near, near_low, near_high), (far, far_low, far_high)):
            visit(child, at[np.maximum(np.maximum(low - d, d - high), 0) * factor <= reach(at)])

    settle(0, np.arange(n))
    visit(0, np.arange(n))
    row, slot = np.nonzero(which >= 0)
    entry = which[row, slot]
    size = np.diff(starts)[entry]
    take = np.repeat(starts[entry] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    row, ids, scores = np.repeat(row, size), members[take], np.repeat(best[row, slot], size)
    keep = ids != own[row]
    return row[keep], ids[keep], scores[keep]


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part, one per id."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0")
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)
    return rows.where(sound).groupBy("vec_id").agg(F.max("vector").alias("vector"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, factor: float = FACTOR, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of every query; ``is_query`` is over vec_id."""
    spark = vectors.sparkSession
    rows = stage(usable(vectors, vec_id, vector), "neighbours-vectors")
    shape = "query_id long, vec_id long, score double"
    lengths = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("vector", F.abs))).alias("greatest"), F.sum(is_query.cast("int")).alias("queries"))
    most = lengths.orderBy(F.desc("n"), "d").first()
    if most is None or not most["queries"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("vector") == most["d"])
    shards, blocks = -(-most["n"] // SHARD_ROWS), -(-most["queries"] // BLOCK_ROWS)
    # distances are taken between vectors scaled by a power of two to components below 1, so squares neither overflow nor vanish
    exponent = int(np.frexp(most["greatest"])[1])
    halves = F.lit(2.0 ** (-exponent // 2)), F.lit(2.0 ** (-exponent - -exponent // 2))
    norm = float(rows.agg(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * halves[0] * halves[1] * (x * halves[0] * halves[1]))))).first()[0])
    if 2 * exponent + np.log2(most["d"]) > 1000:
        factor = 0.0  # products may be infinite, and bound nothing: every node is visited

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        tree = build(np.stack(part["vector"].to_numpy()), part["vec_id"].to_numpy(), norm, k, exponent=exponent)
        return pd.DataFrame({"shard": [int(part["shard"].iloc[0])], "tree": [pickle.dumps(tree)]})

    def look(queries: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(trees):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        own = queries["vec_id"].to_numpy()
        row, ids, scores = search(pickle.loads(trees["tree"].iloc[0]), np.stack(queries["vector"].to_numpy()), own, k, factor)
        found = pd.DataFrame({"query_id": own[row], "vec_id": ids, "score": scores}).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return found.groupby("query_id", sort=False).head(k)

    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard")
    trees = stage(rows.select("*", shard).groupBy("shard").applyInPandas(grow, "shard int, tree binary"), "neighbours-trees")
    asked = rows.where(is_query).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    trees = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = asked.groupBy("shard", "block").cogroup(trees.groupBy("shard", "block")).applyInPandas(look, shape)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
