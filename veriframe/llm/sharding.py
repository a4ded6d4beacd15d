"""Sharding by the smallest capacity that contiguous runs of atomic groups allow.

Rows of one group (here: equal texts) are never parted. Groups stand in the order of their smallest id, and a shard is a
run of that order. A group that is larger than an even share of what is left has a shard to itself (of the largest,
one after the other), for nothing else should go there. Of the others, the smallest capacity under which greedy filling needs no more
than the shards left is found by binary search; the runs are then cut there, each as near to an even share as the
capacity allows.

Greedy filling needs only the running sums of sizes (``ends``). The driver holds the first and the last end of each of
``BLOCKS`` blocks and says from them what the capacity and the cuts are at least and at most; only blocks that a cut can
lie in are looked at again, in finer blocks, until nothing is open. The result is exact: blocks decide how much is
read, not where is cut.

Edge cases: null texts are empty ones and share their group; a text of any length is one group's size; rows given
twice are rows of their own with slots of their own; null ids come last; with fewer groups than shards some shards are
empty; no rows give no rows; other columns are kept by ``sharded`` whatever their names and are not read by the query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, spread_join, table

SHARDS = 24
ROW_BYTES = 8
BLOCKS = 16384

#: Takes gaps between ends, each (low, high, step), and returns the first and the last end and the number of ends for each
#: step that has ends strictly between low and high.
Look = Callable[[list[tuple[int, int, int]]], Iterable[tuple[int, int, int]]]


# ---- the search, on what is known of the ends


class Ends:
    """Known running sums of ordered sizes; between two of them there may be more (an open gap)."""

    def __init__(self, total: int, look: Look, blocks: int = BLOCKS):
        self.known, self.open = np.array([0, total]), np.array([total > 0])
        self.look, self.blocks = look, blocks
        self.seen = 0  # blocks read so far

    def at(self, x: int) -> int:
        return int(np.searchsorted(self.known, x, "right")) - 1

    def floor(self, x: int, touched: set[int] | None = None) -> int:
        """The last known end up to ``x``; the gap that may hold a later one is added to ``touched``."""
        i = self.at(x)
        if touched is not None and self.known[i] < x and self.open[min(i, len(self.open) - 1)] and i < len(self.open):
            touched.add(i)
        return int(self.known[i])

    def ceil(self, x: int, touched: set[int]) -> int:
        """The first known end from ``x`` on."""
        i = int(np.searchsorted(self.known, x, "left"))
        if self.known[i] > x and self.open[i - 1]:
            touched.add(i - 1)
        return int(self.known[i])

    def most(self, x: int) -> int:
        """The last end up to ``x`` if every open gap had an end everywhere."""
        i = self.at(x)
        return x if i < len(self.open) and self.open[i] else int(self.known[i])

    def chain(self, capacity: int, shards: int, step: Callable[[int], int]) -> list[int]:
        at, out = 0, []
        for _ in range(shards):
            at = step(at + capacity)
            out.append(at)
        return out

    def smallest(self, shards: int, step: Callable[[int], int]) -> int:
        """The smallest capacity whose greedy chain of ``shards`` steps ends at the total."""
        total = int(self.known[-1])
        low, high = -(-total // shards), total
        while low < high:
            middle = (low + high) // 2
            if self.chain(middle, shards, step)[-1] >= total:
                high = middle
            else:
                low = middle + 1
        return low

    def refine(self, gaps: set[int]) -> None:
        """Look again between the ends of these gaps."""
        asked = []
        for i in sorted(gaps):
            low, high = int(self.known[i]), int(self.known[i + 1])
            asked.append((low, high, max(1, min((high - low + 1) // 2, -(-(high - low) * len(gaps) // self.blocks)))))
        first, last, count = np.array(list(self.look(asked)), np.int64).reshape(-1, 3).T
        self.seen += len(first)
        self.open[sorted(gaps)] = False
        known = np.unique(np.concatenate([self.known, first, last]))
        still = set(first[count > 2].tolist())
        opened = {int(x) for x, o in zip(self.known[:-1], self.open, strict=True) if o} | still
        self.known, self.open = known, np.array([int(x) in opened for x in known[:-1]], bool)

    def cuts(self, shards: int) -> tuple[int, list[int]]:
        """The smallest capacity of ``shards`` runs, and where they end."""
        total = int(self.known[-1])
        while True:
            touched: set[int] = set()
            least, most = self.smallest(shards, self.most), self.smallest(shards, self.floor)
            if least < most:
                for a, b in zip(self.chain(least, shards, self.floor), self.chain(most, shards, self.most), strict=True):
                    inside = range(self.at(a), min(self.at(b) + 1, len(self.open)))
                    touched |= {i for i in inside if self.open[i]}
            else:
                needed = [total]  # where shard j must have come to, for the others to hold the rest
                for _ in range(shards - 1):
                    needed.append(self.ceil(max(0, needed[-1] - least), touched))
                ends = [0]
                for j, need in zip(range(1, shards), reversed(needed[:-1]), strict=False):
                    reach = min(ends[-1] + least, max(need, round(total * j / shards)))
                    ends.append(self.floor(reach, touched))
                if not touched:
                    return least, [*ends[1:], total]
            self.refine(touched)


def own_shards(sizes: list[int], total: int, shards: int) -> int:
    """How many of the largest ``sizes``, given in falling order, get a shard of their own."""
    n = 0
    while n < len(sizes) and shards - n > 1 and sizes[n] * (shards - n) > total:
        total -= sizes[n]
        n += 1
    return n


# ---- ordered tables


def running(rows: DataFrame, order: list[Column], amount: str, within: str | None, name: str) -> DataFrame:
    """``rows`` as a stored table in ``order`` with ``part``, the number of a range partition, and ``before``: the sum of
    ``amount`` over the earlier rows of that partition, of those with the same ``within`` (the first column of the order)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, key = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            a = batch.column(batch.schema.get_field_index(amount)).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = batch.column(batch.schema.get_field_index(within)).to_numpy(zero_copy_only=False) if within else np.zeros(n, np.int8)
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            before = np.cumsum(a) - a
            base = before[starts].copy()
            if key is not None and keys[0] == key:
                base[0] -= held
            before = before - np.repeat(base, np.diff(np.append(starts, n)))
            held, key = int(before[-1] + a[-1]), keys[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(before)], [*batch.schema.names, "part", "before"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(sums, f"{schema}, part int, before long"), name)


def with_offsets(rows: DataFrame, amount: str, within: str | None) -> DataFrame:
    """``before`` over all partitions: each adds what earlier ones hold, one row for each partition and ``within``, of
    which there are as many as partitions and values of it together."""
    keys = ["part", within] if within else ["part"]
    held: dict[object, int] = {}
    offsets = []
    for row in rows.groupBy(*keys).agg(F.sum(amount).alias("amount")).orderBy("part").collect():
        key = row[within] if within else None
        offsets.append((*(row[k] for k in keys), held.get(key, 0)))
        held[key] = held.get(key, 0) + row["amount"]
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    facts = rows.sparkSession.createDataFrame(offsets, ", ".join(f"{k} {types[k]}" for k in keys) + ", offset long")
    return rows.join(F.broadcast(facts), keys).withColumn("before", F.col("before") + F.col("offset")).drop("part", "offset")


# ---- sharding


def _look(ends: DataFrame, total: int, blocks: int) -> Look:
    """Blocks are read by an equality join with the few that are asked for: each gap lies in one block of the first width
    or is made of whole ones."""
    width = max(1, -(-total // blocks))

    def look(asked: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        if len(asked) == 1 and asked[0][:2] == (0, total):
            found = ends.where(F.col("end") < total).groupBy(F.expr(f"`end` div {width}").alias("b"))
        else:
            rows = [(b, *gap) for gap in asked for b in range(gap[0] // width, gap[1] // width + 1)]
            gaps = F.broadcast(ends.sparkSession.createDataFrame(rows, "base long, low long, high long, step long"))
            inside = ends.withColumn("base", F.expr(f"`end` div {width}")).join(gaps, "base").where("`end` > low and `end` < high")
            found = inside.groupBy("low", F.expr("(`end` - low) div step").alias("b"))
        return [tuple(r) for r in found.agg(F.min("end").alias("a"), F.max("end").alias("z"), F.count("*").alias("n")).select("a", "z", "n").collect()]

    return look


def placed_groups(rows: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS) -> DataFrame:
    """(group, n, first, shard), stored: the shard of every ``group`` of rows(id, size, group)."""
    groups = materialize(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("id").alias("first")), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    largest = groups.orderBy(F.desc("bytes"), "group").limit(shards - 1).select("group", "bytes").collect() if shards > 1 else []
    alone = largest[: own_shards([r["bytes"] for r in largest], total, shards)]
    own = groups.sparkSession.createDataFrame([(bytes(r["group"]), i) for i, r in enumerate(alone)], "group binary, shard int")
    rest = groups.join(F.broadcast(own), "group", "left_anti")
    total -= sum(r["bytes"] for r in alone)
    order = [F.col("first").isNull(), F.col("first"), F.col("group")]
    ends = with_offsets(running(rest, order, "bytes", None, "shard-order"), "bytes", None).withColumn("end", F.col("before") + F.col("bytes"))
    shard = F.lit(len(alone))
    if total:
        _, cuts = Ends(total, _look(ends, total, blocks), blocks).cuts(shards - len(alone))
        for cut in cuts[:-1]:
            shard = shard + F.when(F.col("end") > cut, 1).otherwise(0)
    columns = ["group", "n", "first"]
    return materialize(ends.select(*columns, shard.cast("int").alias("shard")).unionByName(groups.join(F.broadcast(own), "group").select(*columns, "shard")), "shard-of-group")


def place(rows: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS) -> DataFrame:
    """rows(id, size, group, ...) with ``shard`` and ``slot``, the row's place in its shard from 0 in order of group and id.
    A group may hold any share of the rows: neither its shard nor its slots need it in one task."""
    homes = spread_join(rows, placed_groups(rows, shards, blocks), ["group"], "n")
    order = [F.col("shard"), F.col("first").isNull(), F.col("first"), F.col("group"), F.col("id").isNull(), F.col("id")]
    numbered = with_offsets(running(homes.withColumn("one", F.lit(1)), order, "one", "shard", "shard-slots"), "one", "shard")
    return numbered.withColumnRenamed("before", "slot").drop("first", "one")


def text_size(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + ROW_BYTES).cast("long")


def text_group(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def sharded(documents: DataFrame, shards: int = SHARDS) -> tuple[DataFrame, str]:
    """Whole rows of ``documents`` with their shard, and the name of that column (``shard``, if it is free)."""
    group, name = fresh(documents, "text_group"), fresh(documents, "shard")
    rows = materialize(documents.select(F.col("doc_id").alias("id"), text_size(F.col("text")).alias("size"), text_group(F.col("text")).alias("group")), "shard-rows")
    homes = placed_groups(rows, shards).select(F.col("group").alias(group), F.col("shard").alias(name), F.col("n").alias("shard_rows_of_group"))
    return spread_join(documents.withColumn(group, text_group(F.col("text"))), homes, [group], "shard_rows_of_group").drop(group), name


def write_shards(documents: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Parquet files of ``documents``, a folder for each shard."""
    rows, name = sharded(documents, shards)
    rows.write.partitionBy(name).parquet(path)


def op13_sharding(spark, sf_dir: str) -> DataFrame:
    text = F.col("text")
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), text_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), text_group(text).alias("group")
    )
    out = place(materialize(rows, "shard-rows"))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
