"""Approximate nearest neighbours by multiprobe p-stable hashing.

Unit vectors (their distance falls as the cosine rises) are hashed in ``TABLES`` tables of
``FUNCTIONS`` functions floor((a.u + b) / WIDTH) with normal a. The difference between the projections of a query
and of a vector at distance d is normal with deviation d, which gives every bucket its chance to hold such a
neighbour. A query visits buckets in order of that chance, all tables merged, until it would have met a
neighbour at the distance of its k-th best so far with a probability of ``SUCCESS``; the rows of the visited
buckets are candidates, ranked by their exact cosine. Where the query comes without a k-th best from another
shard, the first buckets that name a few rows give one. Queries of one bucket choose and rank together: one product of a
group and the rows that any of it names says which of a query's own named rows are near enough to be scored exactly.

So near copies and clustered vectors, whose neighbours are close, are found in few buckets, while vectors as
unrelated as random ones, whose k-th best is hardly nearer than any other, need most of a shard for the same recall.
No bucket is cut. More edge cases: ``shards``; zero vectors take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .shards import SHARD_ROWS, Measure, top_products, usable_vectors

TOP = 5
QUERY_EVERY = 50
TABLES = 8
FUNCTIONS = 4
WIDTH = 0.8
SUCCESS = 0.998
SEED = 20
SLACK = 1e-9  # more than a cosine is off
_FIRST = 4  # times k: rows that the first buckets must name
GROUP = 64  # queries whose rows are ranked together
FIRST_BUCKETS = 256  # of the likeliest buckets, how many are put in order at first
SCORED = 65_536  # pairs whose exact score is taken at a time


def _norms(v: np.ndarray) -> np.ndarray:
    """Sums run row by row, so that equal vectors have equal norms and scores in every shard."""
    return np.sqrt((v * v).sum(1))


def unit_vectors(v: np.ndarray) -> np.ndarray:
    return v / _norms(v)[:, None]


def _normal_share(x: np.ndarray) -> np.ndarray:
    """Share of a normal distribution below x, to three digits."""
    return 0.5 * (1 + np.tanh(0.7978845608 * (x + 0.044715 * x**3)))


class HashTables:
    def __init__(self, unit: np.ndarray, tables: int = TABLES, functions: int = FUNCTIONS, width: float = WIDTH, seed: int = SEED):
        draw = np.random.default_rng(seed)  # the same functions in every shard
        self.width, self.functions, self.keys, self.bucket, sizes = width, [], [], [], []
        for _ in range(tables):
            a, b = draw.normal(size=(unit.shape[1], functions)), draw.uniform(0, width, functions)
            keys, where, counts = np.unique(np.floor((unit @ a + b) / width), axis=0, return_inverse=True, return_counts=True)
            self.functions.append((a, b))
            self.keys.append([np.unique(keys[:, f], return_inverse=True) for f in range(functions)])
            self.bucket.append(where.ravel() + sum(map(len, sizes)))
            sizes.append(counts)
        self.table = np.repeat(np.arange(tables), [len(s) for s in sizes])
        self.sizes = np.concatenate(sizes)

    def together(self, unit: np.ndarray) -> Iterator[np.ndarray]:
        """Groups of queries; those in one bucket of the first table stand next to each other."""
        a, b = self.functions[0]
        order = np.lexsort(np.floor((unit @ a + b) / self.width).T)
        return (order[i : i + GROUP] for i in range(0, len(order), GROUP))

    def chances(self, unit: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """(query, bucket): the chance that the bucket holds a neighbour at the query's ``distance`` which its table holds."""
        out, reach = [], np.maximum(distance, 1e-6)[:, None]
        for (a, b), keys in zip(self.functions, self.keys, strict=True):
            at = unit @ a + b
            least = 10.0 ** (-300 // len(keys))  # a bucket's chance stays above zero
            chance = 1.0
            for f, (cells, of_bucket) in enumerate(keys):
                low, high = (_normal_share(np.clip((edge * self.width - at[:, f, None]) / reach, -9, 9)) for edge in (cells, cells + 1))
                chance = chance * np.take(high - low + least, of_bucket, axis=1)
            out.append(chance / chance.sum(1, keepdims=True))
        return np.concatenate(out, axis=1)

    def likeliest(self, chances: np.ndarray, n: int) -> np.ndarray:
        """(query, place): each query's ``n`` buckets of the largest chance, by falling chance."""
        n = min(n, chances.shape[1])
        top = np.argpartition(chances, -n, axis=1)[:, -n:]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(chances, top, 1), axis=1), 1)

    def first(self, chances: np.ndarray, rows: int) -> np.ndarray:
        """(query, bucket): whether it is one of the likeliest, which name so many ``rows`` in all."""
        top = self.likeliest(chances, rows)
        before = np.cumsum(self.sizes[top], 1) - self.sizes[top]
        return self._marked(chances, top, (before < rows).sum(1))

    def visited(self, chances: np.ndarray, success: float) -> np.ndarray:
        """(query, bucket): whether it is one of the likeliest, by which the neighbour is met with a probability of ``success``.
        Buckets are put in order only as far as they are needed."""
        out, going, some = np.zeros(chances.shape, bool), np.arange(len(chances)), FIRST_BUCKETS
        while len(going):
            own = chances[going]
            top = self.likeliest(own, some)
            chance, of, missed = np.take_along_axis(own, top, 1), self.table[top], np.ones(top.shape)
            for t in range(int(self.table[-1]) + 1):
                missed *= 1 - np.minimum(np.cumsum(np.where(of == t, chance, 0.0), 1), 1 - 1e-12)
            enough = (1 - missed < success).sum(1) + 1
            done = (enough <= top.shape[1]) | (top.shape[1] == chances.shape[1])
            out[going[done]] = self._marked(own[done], top[done], enough[done])
            going, some = going[~done], some * 4
        return out

    @staticmethod
    def _marked(chances: np.ndarray, top: np.ndarray, enough: np.ndarray) -> np.ndarray:
        out = np.zeros(chances.shape, bool)
        i, j = np.nonzero(np.arange(top.shape[1]) < enough[:, None])
        out[i, top[i, j]] = True
        return out

    def named(self, visited: np.ndarray) -> np.ndarray:
        """(query, row): whether the row lies in a bucket that the query visits."""
        rows = np.take(visited, self.bucket[0], axis=1)
        for bucket in self.bucket[1:]:
            rows |= np.take(visited, bucket, axis=1)
        return rows


def hash_index(k: int, success: float = SUCCESS, ranked: list | None = None):
    """``ranked`` gathers for each search the rows ranked and the rows there are (for tests, in one process)."""

    def build(ids: np.ndarray, vectors: np.ndarray):
        norms = _norms(vectors)
        unit = vectors / norms[:, None]
        index = HashTables(unit)

        def best(qids, queries, qnorms, named, bounds):
            """(query, row, score) of the k best of the rows ``named`` for each query, best first; none below its bound."""
            rows = np.flatnonzero(named.any(0))
            near = (queries / qnorms[:, None]) @ unit[rows].T  # within SLACK of the scores
            near[~named[:, rows] | (qids[:, None] == ids[rows])] = -np.inf
            least = bounds if len(rows) < k else np.maximum(bounds, np.partition(near, -k, axis=1)[:, -k])
            i, j = np.nonzero((near >= least[:, None] - SLACK) & (near > -np.inf))
            j = rows[j]
            parts = [slice(p, p + SCORED) for p in range(0, len(i), SCORED)]
            s = np.concatenate([np.zeros(0), *((vectors[j[p]] * queries[i[p]]).sum(1) / (norms[j[p]] * qnorms[i[p]]) for p in parts)])
            order = np.lexsort((ids[j], -s, i))
            i, j, s = i[order], j[order], s[order]
            good = (np.arange(len(i)) - np.searchsorted(i, i) < k) & (s >= bounds[i])
            return i[good], j[good], s[good]

        def search(qids, queries, bounds):
            qnorms = _norms(queries)
            found = []
            for mine in index.together(queries / qnorms[:, None]):
                own = qids[mine], queries[mine], qnorms[mine]
                units, kth, named = own[1] / own[2][:, None], bounds[mine].copy(), np.zeros((len(mine), len(ids)), bool)
                new = np.flatnonzero(kth == -np.inf)
                if len(new):
                    named[new] = index.named(index.first(index.chances(units[new], np.ones(len(new))), _FIRST * (k + 1) * len(index.functions)))
                    i, _, s = best(*(c[new] for c in own), named[new], kth[new])
                    kth[new] = -1.0
                    last = np.flatnonzero(np.arange(len(i)) - np.searchsorted(i, i) == k - 1)
                    kth[new[i[last]]] = s[last]
                named |= index.named(index.visited(index.chances(units, np.sqrt(np.maximum(0.0, 2 - 2 * kth))), success))
                if ranked is not None:
                    ranked.extend((int(n), len(ids)) for n in named.sum(1))
                i, j, s = best(*own, named, bounds[mine])
                found.append((mine[i], ids[j], s))
            return tuple(np.concatenate(c) for c in zip(*found, strict=True))

        return search

    return build


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = TOP, success: float = SUCCESS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found by cosine."""
    some = lambda df: usable_vectors(df).where(F.exists("vec", lambda x: x != 0))
    return top_products(some(embeddings), some(queries), k, Measure(unit_vectors, hash_index(k, success), "double", SLACK), shard_rows)


def op6_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return nearest(embeddings, embeddings.where(F.col("vec_id") % QUERY_EVERY == 0))
