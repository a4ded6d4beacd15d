"""SimHash near-duplicates over a Gray-order hierarchical index.

The distinct fingerprints are sorted by Gray rank and cut by it into groups, an eighth as many as the square root of
their number, so that groups and upper levels grow alike. A node keeps
the bits its members share, as a mask and a pattern; bits that the node above shares already are left to
it. The groups' nodes and the levels over them are the upper part of the hierarchy, two longs for each node (half a
megabyte for fifty billion fingerprints), which every task holds; below, each group is a hierarchy of its own in one task. A search adds up the
differences from the root down and leaves out a node, with all that is under it, once they exceed ``distance``: a
fingerprint is sent only to the groups it reaches, and there only to the members it reaches. Links are symmetric,
so groups of lower rank than a fingerprint's own are left to their members' searches.

At most 2080 others lie within two bits of a fingerprint, so links don't grow with the square of a cluster. Each task
returns a spanning forest of its links, not the links; components come from rounds of large- and small-star
steps on stored tables.

Edge cases: a null or wordless text has fingerprint zero and is linked like any other; a text of one or
two words is one shingle; repeated ids keep one row each per row of the input; null ids have components
of their own kind only if nothing smaller is reachable (the smallest non-null id wins); no rows give no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, spread_join, table

BITS = 64
DISTANCE = 2
SHINGLE = 3
SEED = 42
_NODE = 16  # nodes or members under a node
_TOGETHER = 512  # searches at a time


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of the whole ASCII-lower-cased text, repeats included."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.append(0, ends[:-1])[: len(words) - shingle + 1]
    spans = zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, len(starts))


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    return simhash_of(shingle_hashes(text, shingle))


def simhash_of(h: np.ndarray) -> int:
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 8192):  # a little at a time: very long texts need no more memory
        counts += np.unpackbits(h[i : i + 8192].astype(">u8").view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h)).tobytes(), "big")


def fingerprints(documents: DataFrame, text_column: str = "text", *more: str, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, ...): fp holds the 64 bits as a signed long; one pass, no shuffle."""

    @F.pandas_udf("long")
    def hashed(texts):
        import pandas as pd

        return pd.Series(np.array([simhash(t, shingle) for t in texts], np.uint64).view(np.int64))

    return documents.select("doc_id", hashed(F.col(text_column)).alias("fp"), *more)


# ---- the hierarchy


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of a number in the Gray sequence."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def gray_order(fp: Column) -> Column:
    """The same of a signed long, as a long that sorts like the unsigned rank."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(2**63)))


class GrayIndex:
    """Levels from the root down: mask and pattern of the bits that a node shares beyond its parent's. The lowest
    level is given, in Gray order, by the AND and the OR of what is under each of its nodes; for members both are
    the member."""

    def __init__(self, low: np.ndarray, high: np.ndarray | None = None):
        levels = [(low, low if high is None else high)]
        while len(levels[-1][0]) > _NODE:
            low, high = levels[-1]
            at = np.arange(0, len(low), _NODE)
            levels.append((np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)))
        self.levels, above = [], None
        for low, high in reversed(levels):
            shared = ~(low ^ high)
            new = shared if above is None else shared & ~np.repeat(above, _NODE)[: len(shared)]
            self.levels.append((new, low))
            above = shared
        self.visited = 0  # nodes looked at so far

    def search(self, queries: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """All (query, lowest node) whose shared bits are within ``distance``."""
        mask, pattern = self.levels[0]
        q = np.repeat(np.arange(len(queries)), len(mask))
        node = np.tile(np.arange(len(mask)), len(queries))
        spent = np.zeros(len(q), np.uint8)
        for depth, (mask, pattern) in enumerate(self.levels):
            if depth:
                n = len(q)
                q, spent = np.repeat(q, _NODE), np.repeat(spent, _NODE)
                node = (node[:, None] * _NODE + np.arange(_NODE)).reshape(n * _NODE)
                there = node < len(mask)
                q, node, spent = q[there], node[there], spent[there]
            self.visited += len(q)
            spent = spent + np.bitwise_count((queries[q] ^ pattern[node]) & mask[node])
            near = spent <= distance
            q, node, spent = q[near], node[near], spent[near]
        return q, node


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that keep the components of (u, v): each node with the smallest of its component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[root[other]], nodes[other]


def gray_groups(distinct: DataFrame, groups: int | None = None) -> DataFrame:
    """(grp, fp), stored: distinct fingerprints cut into groups by their Gray rank, numbered in its order."""
    groups = groups or int(np.ceil(distinct.count() ** 0.5 / 8)) or 1
    ranged = distinct.select("fp", gray_order(F.col("fp")).alias("rank")).repartitionByRange(groups, "rank")
    return materialize(ranged.select(F.spark_partition_id().alias("grp"), "fp"), "gray-groups")


def upper_nodes(grouped: DataFrame) -> tuple[np.ndarray, GrayIndex]:
    """Numbers of the groups and the hierarchy over their nodes: as many rows as there are groups."""
    nodes = grouped.groupBy("grp").agg(F.bit_and("fp").alias("low"), F.bit_or("fp").alias("high")).orderBy("grp").toPandas()
    return nodes["grp"].to_numpy(np.int32), GrayIndex(*(nodes[c].to_numpy(np.int64).view(np.uint64) for c in ("low", "high")))


def link_forest(distinct: DataFrame, distance: int = DISTANCE, groups: int | None = None) -> DataFrame:
    """(u, v): links between the distinct ``fp`` values that have the components of all pairs within ``distance``."""
    grouped = gray_groups(distinct, groups)
    numbers, upper = upper_nodes(grouped)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, fps = (batch.column(i).to_numpy() for i in (0, 1))
            for i in range(0, len(fps), _TOGETHER):
                mine, part = home[i : i + _TOGETHER], fps[i : i + _TOGETHER]
                q, node = upper.search(part.view(np.uint64), distance)
                keep = numbers[node] > mine[q]
                grp = np.concatenate([mine, numbers[node[keep]]])
                kind = np.concatenate([np.zeros(len(mine), np.int8), np.ones(keep.sum(), np.int8)])
                yield pa.RecordBatch.from_arrays([pa.array(grp), pa.array(kind), pa.array(np.concatenate([part, part[q[keep]]]))], ["grp", "kind", "fp"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = None
        for batch in batches:
            grp, kind, fps = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((np.diff(grp) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(grp)], strict=True):
                if a == b:
                    continue
                if group is None or group.number != grp[a]:
                    if group is not None:
                        yield from group.own_links()
                    group = _Group(int(grp[a]), distance)
                if kind[a] == 0:
                    group.members.append(fps[a:b].view(np.uint64))
                else:
                    yield from group.links_to(fps[a:b].view(np.uint64))
        if group is not None:
            yield from group.own_links()

    routed = grouped.mapInArrow(route, "grp int, kind byte, fp long")
    ready = routed.repartition("grp").sortWithinPartitions("grp", "kind")
    return ready.mapInArrow(links, "u long, v long").distinct()


class _Group:
    """Members of one group, indexed when the last of them has come, and the searches in it."""

    def __init__(self, number: int, distance: int):
        self.number, self.distance, self.members, self.index = number, distance, [], None

    def ready(self) -> None:
        values = np.concatenate(self.members)
        self.members = values[np.argsort(gray_rank(values))]
        self.index = GrayIndex(self.members)

    def links_to(self, visitors: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.index is None:
            self.ready()
            yield from self._found(self.members)
        yield from self._found(visitors)

    def own_links(self) -> Iterator[pa.RecordBatch]:
        if self.index is None:
            yield from self.links_to(np.zeros(0, np.uint64))

    def _found(self, queries: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(queries), _TOGETHER):
            part = queries[i : i + _TOGETHER]
            q, at = self.index.search(part, self.distance)
            u, v = _forest(part[q], self.members[at])
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (u, v)], ["u", "v"])


# ---- components


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(v, root): root is the smallest node that v reaches. Every round is one large-star and one
    small-star step and ends in a stored table; it stops when the links no longer change."""
    now = materialize(edges.select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u")).where("u != v").distinct(), "links")
    state = None
    for _ in range(rounds):
        both = now.union(now.select("u", "v")).toDF("x", "y")
        low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("v"), F.col("m").alias("u"))
        large = large.unionByName(low.where("m < x").select(F.col("x").alias("v"), F.col("m").alias("u"))).where("u != v").distinct()
        lowest = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(lowest, "v").select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u"))
        now = materialize(small.where("u != v").distinct(), "links")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == state:
            return now.select("v", F.col("u").alias("root"))
        state = mark
    raise RuntimeError(f"components still change after {rounds} rounds")


def print_components(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, root, doc_id, n), stored: for each distinct ``fp`` of prints(doc_id, fp) its component, smallest id and rows."""
    smallest = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "distinct-prints")
    roots = components(link_forest(smallest.select("fp"), distance))
    rooted = smallest.join(roots.withColumnRenamed("v", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "doc_id", "n")
    return materialize(rooted, "rooted-prints")


def near_duplicates(documents: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``documents``."""
    prints = materialize(fingerprints(documents), "fingerprints")
    rooted = print_components(prints, distance)
    ids = materialize(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("prints")), "components")
    of_print = materialize(spread_join(rooted.select("root", "fp", "n"), ids, ["root"], "prints").select("fp", "component_id", "n"), "print-components")
    return spread_join(prints, of_print, ["fp"], "n").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row of each component of ``documents``, the one with the smallest id (null ids last)."""
    key = fresh(documents, "row_key")
    marked = documents.withColumn(key, F.md5(F.concat_ws("\x01", F.col("doc_id").cast("string"), F.col("text"))))
    prints = materialize(fingerprints(marked.select("doc_id", "text", F.col(key).alias("key")), "text", "key"), "fingerprints")
    roots = print_components(prints, distance).select("fp", "root", "n")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"]
    chosen = spread_join(prints, roots, ["fp"], "n").groupBy("root").agg(first.alias(key)).select(key)
    return marked.join(chosen, key, "left_semi").dropDuplicates([key]).select(*documents.columns)


def op8_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
