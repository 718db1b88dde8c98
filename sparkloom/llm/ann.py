"""Approximate nearest neighbours by vantage-point trees, one a shard."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage
from .vectors import matrix, usable


class VPTree:
    """Vantage-point tree for the largest inner product.

    A row x is lifted to (x, sqrt(most^2 - |x|^2)) and a query q to (q, 0); then the nearest in Euclid's
    metric has the largest inner product. A node keeps its vantage point and, of either half, the range of distances
    to it. By the triangle inequality, a half has nothing nearer than max(d - high, low - d); it is passed over if
    that exceeds factor times the distance of the query's k-th best so far. With factor 1 the search is exact.
    """

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, most: float, leaf: int = 128):
        self.x, self.ids, self.rows, self.most = x, ids, rows, most
        self.lifted = np.hstack([x, np.sqrt(np.maximum(0, most * most - (x * x).sum(1)))[:, None]])
        self.leaf = leaf
        self.root = self._build(np.arange(len(x)))

    def _build(self, members: np.ndarray):
        if len(members) <= self.leaf:
            return members
        at = members[len(members) // 2]
        d = self._distance(self.lifted[members], self.lifted[at])
        order = np.argsort(d, kind="stable")
        if d[order[0]] == d[order[-1]]:
            return members
        half = len(members) // 2
        inner, outer = order[:half], order[half:]
        sides = [(d[s].min(), d[s].max(), self._build(members[s])) for s in (inner, outer)]
        return at, sides

    @staticmethod
    def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, ((a - b) ** 2).sum(-1)))

    def search(self, q: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best of each query but the row numbered own, best first, ties by id; -1 and -inf fill up."""
        self.q, self.own, self.k, self.factor = q, own, k, factor
        self.norm = (q * q).sum(1)
        self.lift = np.hstack([q, np.zeros((len(q), 1))])
        self.score = np.full((len(q), k), -np.inf)
        self.best = np.full((len(q), k), -1, np.int64)
        if len(self.x):
            self._visit(self.root, np.arange(len(q)))
        return self.best, self.score

    def _reach(self, who: np.ndarray) -> np.ndarray:
        worst = self.score[who, -1]
        return np.where(np.isinf(worst), np.inf, np.sqrt(np.maximum(0, self.norm[who] + self.most**2 - 2 * worst)))

    def _visit(self, node, who: np.ndarray) -> None:
        if not len(who):
            return
        if isinstance(node, np.ndarray):
            for at in range(0, len(node), 1024):
                self._leaf(node[at : at + 1024], who)
            return
        at, sides = node
        d = self._distance(self.lift[who], self.lifted[at])
        bounds = [np.maximum(0, np.maximum(d - high, low - d)) for low, high, _ in sides]
        middle = (sides[0][1] + sides[1][0]) / 2
        first = d <= middle
        for side, mine in ((0, first), (1, ~first), (1, first), (0, ~first)):
            now, bound = who[mine], bounds[side][mine]
            self._visit(sides[side][2], now[bound <= self.factor * self._reach(now) + 1e-9])

    def _leaf(self, members: np.ndarray, who: np.ndarray) -> None:
        # One fixed order of summing, so that equal vectors score equally.
        scores = np.einsum("qd,ld->ql", self.q[who], self.x[members])
        scores[self.own[who, None] == self.rows[members]] = -np.inf
        some = (scores >= self.score[who, -1:]).any(1)
        who, scores = who[some], scores[some]
        if len(who):
            ids = np.hstack([self.best[who], np.broadcast_to(self.ids[members], scores.shape)])
            scores = np.hstack([self.score[who], scores])
            ids = np.where(np.isinf(scores), np.iinfo(np.int64).max, ids)
            order = np.lexsort((ids, -scores), axis=1)[:, : self.k]
            self.score[who] = np.take_along_axis(scores, order, 1)
            self.best[who] = np.take_along_axis(ids, order, 1)


def nearest(
    df: DataFrame, queries: Column, k: int = 20, *, factor: float = 0.85, id: str = "vec_id", vector: str = "embedding", shard_rows: int = 8192, block_rows: int = 2048
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of df where queries holds, its k nearest by inner product, in double precision.

    Every usable row is in the tree of one shard, chosen by a hash; each block of queries searches each
    tree, and the k best of a tree meet in a window over a query. Trees and blocks have a set size, so memory doesn't grow; work is
    queries times shards, less what the trees prune. Below 1, factor prunes more at a loss of recall.

    Null or zero vectors, those with a null or non-finite component, and rows with a null id take no part;
    vectors of another length are of another space. Rows that repeat an id are candidates of their own. Ties go to the
    smaller id. With less than k candidates, all are returned; an empty table gives an empty one.
    """
    v = F.col(vector).cast("array<double>")
    rows = df.filter(F.col(id).isNotNull() & usable(vector)).select(F.col(id).cast("bigint").alias("vec_id"), v.alias("vec"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = stage(rows.withColumns({"row": F.monotonically_increasing_id(), "dim": F.size("vec")}), "ann-rows")
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x, F.sqrt)
    spaces = rows.groupBy("dim").agg(F.max(norm).alias("most"), F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asked"))
    spaces = spaces.select("dim", "most", F.ceil(F.col("n") / shard_rows).cast("int").alias("shards"), F.greatest(F.lit(1), F.ceil(F.col("asked") / block_rows)).cast("int").alias("blocks"))
    dealt = rows.join(F.broadcast(spaces), "dim")  # a row for each length of vector
    sharded = dealt.withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards")).cast("int"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["vec_id", "row"])
        tree = VPTree(matrix(group["vec"]), group["vec_id"].to_numpy(np.int64), group["row"].to_numpy(np.int64), float(group["most"].iloc[0]))
        state = (tree.x, tree.ids, tree.rows, tree.most, tree.lifted, tree.leaf, tree.root)
        return pd.DataFrame({"dim": group["dim"].iloc[:1], "shard": group["shard"].iloc[:1], "blocks": group["blocks"].iloc[:1], "tree": [pickle.dumps(state)]})

    trees = stage(sharded.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, blocks int, tree binary"), "ann-trees")
    left = trees.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "tree")
    asking = dealt.filter("asks").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    asking = asking.select("dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "block", "vec_id", "row", "vec")

    def search(tree_rows: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        if not len(tree_rows) or not len(group):
            return pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []})
        tree = VPTree.__new__(VPTree)
        tree.x, tree.ids, tree.rows, tree.most, tree.lifted, tree.leaf, tree.root = pickle.loads(tree_rows["tree"].iloc[0])
        best, score = tree.search(matrix(group["vec"]), group["row"].to_numpy(np.int64), k, factor)
        found = pd.DataFrame({
            "query": np.repeat(group["row"].to_numpy(np.int64), k), "query_id": np.repeat(group["vec_id"].to_numpy(np.int64), k),
            "vec_id": best.ravel(), "score": score.ravel(),
        })
        return found[~np.isinf(found["score"])]

    keys = ("dim", "shard", "block")
    found = left.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInPandas(search, "query long, query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
