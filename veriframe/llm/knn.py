"""Exact top-k inner products with KD-trees per shard.

A shard's tree splits at medians of the widest dimension and keeps a tight box for every node. A query
meets the leaves in order of the best inner product that their boxes allow and stops at the first that
cannot reach its k-th best score so far. That score is found in the query's own shard first and then sent
with the query to those other shards whose box can reach it, whose subtrees are left out in the same way.

Components are floor(64 * x) and scores exact: in doubles or 64-bit numbers where these hold every inner product of
the rows at hand, else in whole numbers of any length. A score beyond a long is given as the long next to
it, and such scores are ties. More edge cases: ``shards``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .shards import SHARD_ROWS, Measure, best_found, box_bounds, fold_leaf, no_best, top_products, usable_vectors

TOP = 20
QUERY_EVERY = 20
LEAF_ROWS = 256
MAX_LEAVES = 64


class BoxTree:
    """Median splits down to leaves; per level the boxes of its nodes, per leaf its rows."""

    def __init__(self, x: np.ndarray, leaf_rows: int = LEAF_ROWS, max_leaves: int = MAX_LEAVES):
        leaf_rows = max(leaf_rows, -(-len(x) // max_leaves))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # lo, hi of the nodes of a level
        self.parents: list[np.ndarray] = []
        nodes, parents = [np.arange(len(x))], np.zeros(1, int)
        while True:
            self.levels.append((np.array([x[n].min(0) for n in nodes]), np.array([x[n].max(0) for n in nodes])))
            self.parents.append(parents)
            if all(len(n) <= leaf_rows for n in nodes):
                break
            below, parents = [], []
            for i, n in enumerate(nodes):
                lo, hi = (side[i] for side in self.levels[-1])
                if len(n) <= leaf_rows or not x.shape[1] or (lo == hi).all():
                    parts = [n]
                else:
                    order = np.argpartition(x[n, int((hi - lo).argmax())], len(n) // 2)
                    parts = [n[order[: len(n) // 2]], n[order[len(n) // 2 :]]]
                below += parts
                parents += [i] * len(parts)
            if len(below) == len(nodes):
                break
            nodes, parents = below, np.array(parents)
        self.leaves = nodes

    def leaf_bounds(self, q: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """For each query and leaf the largest inner product in the leaf's box; -inf below a pruned node."""
        bounds = np.full((len(q), 1), np.inf)
        for (lo, hi), parent in zip(self.levels, self.parents, strict=True):
            above = bounds[:, parent]
            alive = (above >= kth[:, None]).any(0)
            bounds = np.full(above.shape, -np.inf)
            bounds[:, alive] = np.minimum(above[:, alive], box_bounds(q, lo[alive], hi[alive]))
        return bounds


def scaled(vectors: np.ndarray) -> np.ndarray:
    """floor(64 * x), whole numbers as doubles."""
    return np.floor(64.0 * vectors)


def any_length_products(q: np.ndarray, x: np.ndarray, qids: np.ndarray, ids: np.ndarray, k: int):
    """The k best of all rows for each query in whole numbers of any length."""
    rows = [[int(v) for v in r] for r in x]
    found = []
    for i, query in enumerate(q):
        own = [int(v) for v in query]
        scores = (min(max(sum(map(int.__mul__, own, r)), -(2**63)), 2**63 - 1) for r in rows)
        best = sorted((-s, v) for s, v in zip(scores, ids.tolist(), strict=True) if v != qids[i])[:k]
        found += [(i, v, -s) for s, v in best]
    return tuple(np.array(c, np.int64) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def tree_index(k: int):
    def build(ids: np.ndarray, vectors: np.ndarray):
        x = scaled(vectors)
        tree = BoxTree(x)
        largest = np.abs(x).max(initial=0)

        def search(qids, qvectors, bounds):
            q = scaled(qvectors)
            reach = largest * np.abs(q).max(initial=0) * max(1, x.shape[1])
            if reach >= 2.0**62:
                return any_length_products(q, x, qids, ids, k)
            kind = np.float64 if reach < 2.0**53 else np.int64
            best = no_best(len(q), k, kind)
            kth = bounds.copy()  # at least k scores elsewhere reach it
            limit = tree.leaf_bounds(q, kth)
            order = np.argsort(-limit, axis=1)
            whole, rows_of = q.astype(kind), x.astype(kind)
            for step in range(order.shape[1]):
                leaf = order[:, step]
                bound = limit[np.arange(len(q)), leaf]
                going = np.flatnonzero((bound >= kth) & (bound > -np.inf))
                if not len(going):
                    break
                for at in np.unique(leaf[going]):
                    rows, mine = tree.leaves[at], going[leaf[going] == at]
                    scores = whole[mine] @ rows_of[rows].T
                    allowed = (qids[mine][:, None] != ids[rows]) & (scores >= kth[mine][:, None])
                    fold_leaf(best, mine, scores, ids[rows], allowed)
                    kth[mine] = np.maximum(kth[mine], best[0][mine, -1].astype(float) - (kind is np.int64) * 2048.0)  # rounding of a long
            query, vec, score = best_found(best)
            return query, vec, score.astype(np.int64)

        return search

    return build


def exact_top_k(embeddings: DataFrame, queries: DataFrame, k: int = TOP, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``queries``, rows of the same form as ``embeddings``."""
    return top_products(usable_vectors(embeddings), usable_vectors(queries), k, Measure(scaled, tree_index(k), "long"), shard_rows)


def op9_exact_top_k(spark, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return exact_top_k(embeddings, embeddings.where(F.col("vec_id") % QUERY_EVERY == 0))


OP9_SQL = """
WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM whole q, whole c
    WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20"""
