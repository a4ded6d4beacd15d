"""Searches of a stated query set for largest inner products, over vectors dealt to shards by place.

The upper levels of one KD-tree, fitted to a bounded sample, deal all rows to shards. A task holds the rows of one
shard and streams the queries that were sent to it past them, so that memory is bounded by the shard, not by the
number of queries. Every query meets its own shard first; the k-th score it finds there goes with it, and of the
other shards it is sent only to those whose tight box allows a score as good. Of a vector with many copies the
``k + 1`` with the smallest ids take part: the others rank behind them for every query.

Edge cases: rows with a null id, a null vector, or a null, NaN or infinite component take no part; rows
that repeat an id count once, with the smallest of its vectors; vectors are compared with vectors of
their own length only; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Vectors in a shard; more only where there would be too many shards.
SHARD_ROWS = 16_384
MAX_SHARDS = 4096
#: Components of the corners of all boxes, which every task holds: fewer shards for longer vectors.
MAX_CORNERS = 2**19
#: Rows that the shards' borders are fitted to.
SAMPLE_ROWS = 10_000
#: Queries that meet a shard at a time.
QUERY_BATCH = 512

Search = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Measure:
    """What is searched: ``space`` maps vectors to where the score is their inner product, ``build`` makes of (ids,
    vectors) a search (query ids, query vectors, bounds) -> (query row, vector id, score); ``slack`` is more
    than a score can be off."""

    space: Callable[[np.ndarray], np.ndarray]
    build: Callable[[np.ndarray, np.ndarray], Search]
    score_type: str
    slack: float = 0.0


def usable_vectors(embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, vec) of the rows that take part, one for each id."""
    vec = F.col(vector_column)
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.where(F.col(id_column).isNotNull() & vec.isNotNull() & ~odd)
    return rows.groupBy(F.col(id_column).cast("long").alias("id")).agg(F.min(vec.cast("array<double>")).alias("vec"))


def few_copies(rows: DataFrame, k: int) -> DataFrame:
    """Of each vector the rows with its ``k + 1`` smallest ids; tasks cut before the shuffle."""
    copy = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    return rows.withColumn("copy", copy).where(F.col("copy") <= k + 1).drop("copy")


def box_bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(query, box): the largest inner product in the box; infinite where doubles can't say."""
    with np.errstate(over="ignore", invalid="ignore"):
        bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        sizes = np.abs(q).max(1, initial=0)[:, None] * np.maximum(np.abs(low), np.abs(high)).max(1, initial=0) * max(1, q.shape[1])
    return np.where(sizes < 2.0**53, bound, np.inf)


def fold_leaf(best: tuple[np.ndarray, np.ndarray], mine: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
    """Merges (query, id) ``scores`` into the sorted ``best`` scores and ids of the queries ``mine``, ties to smaller ids."""
    k = best[0].shape[1]
    all_scores = np.concatenate([best[0][mine], np.where(allowed, scores, best[0].dtype.type(_lowest(best[0].dtype)))], 1)
    all_ids = np.concatenate([best[1][mine], np.broadcast_to(ids, scores.shape)], 1)
    least = np.partition(all_scores, -k, axis=1)[:, -k]
    i, j = np.nonzero(all_scores >= least[:, None])
    order = np.lexsort((all_ids[i, j], -all_scores[i, j], i))
    i, j = i[order], j[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    i, j, place = (c[place < k] for c in (i, j, place))
    best[0][mine[i], place], best[1][mine[i], place] = all_scores[i, j], all_ids[i, j]


def _lowest(kind: np.dtype):
    return -np.inf if kind.kind == "f" else -(2**63) + 1  # its negative is a number, too


def no_best(queries: int, k: int, kind) -> tuple[np.ndarray, np.ndarray]:
    return np.full((queries, k), _lowest(np.dtype(kind)), kind), np.full((queries, k), np.iinfo(np.int64).max)


def best_found(best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    q, at = np.nonzero(best[0] > _lowest(best[0].dtype))
    return q, best[1][q, at], best[0][q, at]


# ---- dealing rows to shards


@dataclass
class Borders:
    """For each vector length a complete binary tree in heap order: a node's dimension and border, values above it
    go to its right child. ``first`` is the number of a length's leftmost leaf."""

    trees: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    first: dict[int, int] = field(default_factory=dict)
    shards: int = 0

    def add(self, x: np.ndarray, leaves: int) -> None:
        depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))
        dims, borders, parts = [], [], [x]
        for _ in range(depth):
            halves = []
            for part in parts:
                wide = np.ptp(part, axis=0) if len(part) and x.shape[1] else np.zeros(1)
                d = int(wide.argmax())
                border = np.median(part[:, d]) if wide[d] > 0 else np.inf
                if wide[d] > 0 and border == part[:, d].max():
                    border = part[part[:, d] < border, d].max()
                up = part[:, d] > border if x.shape[1] else np.zeros(len(part), bool)
                dims.append(d), borders.append(border)
                halves += [part[~up], part[up]]
            parts = halves
        self.trees[x.shape[1]] = np.array(dims, int), np.array(borders, float)
        self.first[x.shape[1]] = self.shards
        self.shards += 1 << depth

    def shard(self, x: np.ndarray) -> np.ndarray:
        """Shards of vectors of one length; a length that the sample lacks is a shard of its own."""
        n = x.shape[1]
        if n not in self.trees:
            return np.full(len(x), -1 - n)
        dims, borders = self.trees[n]
        node = np.zeros(len(x), int)
        while len(dims) and len(node) and node[0] < len(dims):
            node = 2 * node + 1 + (x[np.arange(len(x)), dims[node]] > borders[node])
        return self.first[n] + node - len(dims)


def fit_borders(rows: DataFrame, measure: Measure, shard_rows: int = SHARD_ROWS) -> Borders:
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("vec").toPandas()["vec"]  # SAMPLE_ROWS vectors at most
    borders = Borders()
    if not len(sample):
        return borders
    lengths = sample.map(len)
    shards = min(MAX_SHARDS, MAX_CORNERS // max(1, int(lengths.max())), -(-rows.count() // shard_rows))
    for n in sorted(lengths.unique()):
        own = sample[lengths == n].to_list()
        x = np.stack(own).reshape(len(own), n)
        borders.add(measure.space(x), round(shards * len(x) / len(sample)))
    return borders


def _by_length(vectors: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    lengths = np.fromiter(map(len, vectors), np.int64, len(vectors))
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        yield at, np.array([vectors[i] for i in at]).reshape(len(at), n)


def _vectors(column: pa.ListArray) -> list[np.ndarray]:
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def in_shards(rows: DataFrame, borders: Borders, measure: Measure) -> DataFrame:
    """(id, vec, shard)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = np.zeros(len(batch), np.int32)
            for at, x in _by_length(_vectors(batch.column(1))):
                shard[at] = borders.shard(measure.space(x))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], ["id", "vec", "shard"])

    return rows.select("id", "vec").mapInArrow(deal, "id long, vec array<double>, shard int")


# ---- searching them


def search_shards(rows: DataFrame, queries: DataFrame, measure: Measure) -> DataFrame:
    """rows(shard, id, vec) met by queries(shard, id, vec, bound): (query_id, vec_id, score), and for each shard one
    row (shard, low, high) with its box."""
    both = rows.select("shard", F.lit(0).alias("kind"), "id", "vec", F.lit(None).cast("double").alias("bound")).unionByName(
        queries.select("shard", F.lit(1).alias("kind"), "id", "vec", "bound")
    )
    schema = f"query_id long, vec_id long, score {measure.score_type}, shard int, low array<double>, high array<double>"
    kinds = [pa.int64(), pa.int64(), pa.float64() if measure.score_type == "double" else pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())]
    names = ["query_id", "vec_id", "score", "shard", "low", "high"]

    def output(columns: list) -> pa.RecordBatch:
        n = max(len(c) for c in columns if c is not None)
        return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, search = None, [], None
        for batch in batches:
            shard, kind, ids = (batch.column(i).to_numpy() for i in range(3))
            vectors, bounds = _vectors(batch.column(3)), batch.column(4).fill_null(float("-inf")).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)], strict=True):
                if a == b:
                    continue
                if shard[a] != now:
                    if held and search is None:
                        yield output(_box(now, held, measure))
                    now, held, search = shard[a], [], None
                if kind[a] == 0:
                    held.append((ids[a:b], np.array(vectors[a:b]).reshape(b - a, -1)))
                    continue
                if search is None:
                    if not held:
                        continue  # no row of the queries' length
                    yield output(_box(now, held, measure))
                    order = np.argsort(np.concatenate([i for i, _ in held]))
                    search = measure.build(*(np.concatenate(c)[order] for c in zip(*held, strict=True)))
                for i in range(a, b, QUERY_BATCH):
                    part = slice(i, min(b, i + QUERY_BATCH))
                    q, v, s = search(ids[part], np.array(vectors[part]).reshape(part.stop - i, -1), bounds[part])
                    if len(q):
                        yield output([ids[part][q], v, s, None, None, None])
        if held and search is None:
            yield output(_box(now, held, measure))

    return both.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(run, schema)


def _box(shard: int, held: list, measure: Measure) -> list:
    sides = [(x.min(0), x.max(0)) for x in (measure.space(v) for _, v in held)]
    low, high = np.min([s[0] for s in sides], 0), np.max([s[1] for s in sides], 0)
    return [None, None, None, [int(shard)], [low.tolist()], [high.tolist()]]


def top_products(rows: DataFrame, queries: DataFrame, k: int, measure: Measure, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best rows(id, vec) found for each of queries(id, vec)."""
    few = materialize(few_copies(rows, k), "search-rows")
    borders = fit_borders(few, measure, shard_rows)
    dealt = in_shards(few, borders, measure)
    asked = materialize(in_shards(queries, borders, measure), "search-queries")
    first = materialize(search_shards(dealt, asked.withColumn("bound", F.lit(None).cast("double")), measure), "search-home")
    boxes = first.where("shard is not null").select("shard", "low", "high").toPandas()  # one row for each shard

    places: dict[int, tuple] = {}
    for n, own in boxes.groupby(boxes["low"].map(len)) if len(boxes) else ():
        places[int(n)] = own["shard"].to_numpy(), *(np.stack(own[c].to_list()).reshape(len(own), -1) for c in ("low", "high"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, home, bound = _vectors(batch.column(1)), batch.column(2).to_numpy(), batch.column(3).fill_null(float("-inf")).to_numpy(zero_copy_only=False)
            for at, x in _by_length(vectors):
                if x.shape[1] not in places:
                    continue
                shards, low, high = places[x.shape[1]]
                for i in range(0, len(at), QUERY_BATCH):
                    mine = at[i : i + QUERY_BATCH]
                    best = box_bounds(measure.space(x[i : i + QUERY_BATCH]), low, high)
                    q, s = np.nonzero((best >= bound[mine][:, None]) & (shards != home[mine][:, None]))
                    if len(q):
                        sent = batch.take(pa.array(mine[q]))
                        yield pa.RecordBatch.from_arrays([sent.column(0), sent.column(1), pa.array(shards[s], pa.int32()), sent.column(3)], ["id", "vec", "shard", "bound"])

    found = first.where("query_id is not null").select("query_id", "vec_id", "score")
    reached = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("low"))
    rounding = F.when(F.abs("low") < 2.0**53, 0.0).otherwise(2048.0)  # of a long to a double
    bound = reached.select(F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("low") - rounding - measure.slack).alias("bound"))
    sent = asked.join(bound, "id", "left").select("id", "vec", "shard", "bound").mapInArrow(route, "id long, vec array<double>, shard int, bound double")
    others = search_shards(dealt, sent, measure).where("query_id is not null").select("query_id", "vec_id", "score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.unionByName(others).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
