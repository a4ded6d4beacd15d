"""Near duplicates by Jaccard similarity: one document of each group.

Documents are linked if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more.
Candidates come from two kinds of fingerprints: SimHashes within a few bits (the index of ``simhash``)
and ``BANDS`` fingerprints, each made of the smallest ``ROWS`` hashes of the set under as many orders. Two sets of
similarity s share one of these with probability 1 - (1 - s**ROWS)**BANDS: all but 5 of a million at 0.8,
and more above. Candidates are gathered to groups, and in a group all links are found by exact
similarity, so a group falls into the components of its true links. A group of more than ``GROUP_SETS`` sets
is dealt to slices, and each two slices of it are a task's; the components of what they find are put together.

Edge cases: documents with equal sets (all wordless and null texts, too) are one; a text of under five
words is one shingle; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialize, spread_join
from .simhash import DISTANCE, components, link_forest, shingle_hashes, simhash_of

SHINGLE = 5
SIMILARITY = 0.8
ROWS = 6
BANDS = 40
#: Sets of a group that a task may get in one slice.
GROUP_SETS = 4096
_random = np.random.default_rng(8)
_XOR = _random.integers(0, 2**32, ROWS * BANDS, dtype=np.uint32)[:, None]
_TIMES = (_random.integers(0, 2**32, ROWS * BANDS, dtype=np.uint32) | np.uint32(1))[:, None]
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def set_id(s: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(s.tobytes())


def band_keys(s: np.ndarray) -> np.ndarray:
    """BANDS fingerprints of a set; none of an empty one."""
    if not len(s):
        return np.zeros(0, np.uint64)
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(ROWS * BANDS, 2**32 - 1, np.uint32)
    for i in range(0, len(x), 512):  # a little at a time: very long texts need no more memory
        y = (x[None, i : i + 512] ^ _XOR) * _TIMES
        y ^= y >> np.uint32(16)
        low = np.minimum(low, (y * _TIMES[::-1]).min(1))
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T.astype(np.uint64):
        keys = (keys ^ column) * _MIX
        keys ^= keys >> np.uint64(29)
    return keys


def similar_components(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """For each of several sets the number of its component under all links of ``similarity`` or more.
    A search goes out from each set met to those not met yet, so copies of one text take one pass."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    kinds, items = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    parts = [items[e - n : e] for e, n in zip(ends.tolist(), size.tolist(), strict=True)]
    out = np.full(len(sets), -1, np.int64)
    mark = np.zeros(len(kinds), bool)
    left = np.argsort(size, kind="stable")
    flat, starts = np.concatenate([parts[i] for i in left]), np.append(0, np.cumsum(size[left])[:-1])
    while len(left):
        queue = [int(left[0])]
        out[queue[0]] = queue[0]
        while queue and len(left):
            at = queue.pop()
            keep = out[left] < 0
            a = int(np.searchsorted(size[left], int(similarity * size[at]), "left"))
            b = int(np.searchsorted(size[left], int(size[at] / similarity) + 1, "right"))
            if a < b:
                mark[parts[at]] = True
                stop = starts[b] if b < len(starts) else len(flat)
                both = np.add.reduceat(mark[flat[starts[a] : stop]], starts[a:b] - starts[a], dtype=np.int64)
                mark[parts[at]] = False
                near = keep[a:b] & (both >= similarity * (size[at] + size[left[a:b]] - both) - 1e-9)
                found = left[a:b][near]
                out[found] = out[at]
                queue += found.tolist()
                keep[a:b] &= ~near
            if 4 * keep.sum() < 3 * len(keep) or not queue:
                left = left[keep]
                flat = np.concatenate([parts[i] for i in left]) if len(left) else flat[:0]
                starts = np.append(0, np.cumsum(size[left])[:-1])
    return out


def _groups(shingle: int, similarity: float):
    """Rows (key, set_id, text) in order of key to (u, v): sets with the smallest of their component under a key."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets = None, [], []

        def done() -> pa.RecordBatch:
            of = similar_components(sets, similarity)
            all_ids = np.array(ids, np.int64)
            least = np.full(len(of), np.iinfo(np.int64).max)
            np.minimum.at(least, of, all_ids)
            other = least[of] != all_ids
            return pa.RecordBatch.from_arrays([pa.array(all_ids[other]), pa.array(least[of][other])], ["u", "v"])

        for batch in batches:
            for key, i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if key != now and ids:
                    yield done()
                    ids, sets = [], []
                now = key
                ids.append(i)
                sets.append(shingle_set(text.as_py(), shingle))
        if ids:
            yield done()

    return groups


def keep_one(documents: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, distance: int = DISTANCE, group_sets: int = GROUP_SETS) -> DataFrame:
    """One row of each group of ``documents``, the one with the smallest id (null ids last)."""
    kind = T.StructType([T.StructField("set_id", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    @F.pandas_udf(kind)
    def printed(texts):
        import pandas as pd

        rows = []
        for text in texts:
            h = shingle_hashes(text, shingle)
            s = np.unique(h)
            pair = np.array([set_id(s), simhash_of(h)], np.uint64).view(np.int64)
            rows.append((int(pair[0]), int(pair[1]), band_keys(s).view(np.int64)))
        return pd.DataFrame(rows, columns=["set_id", "fp", "bands"])

    key = fresh(documents, "row_key")
    marked = documents.withColumn(key, F.md5(F.concat_ws("\x01", F.col("doc_id").cast("string"), F.col("text"))))
    prints = materialize(marked.select("doc_id", F.col(key).alias("key"), printed("text").alias("p")).select("doc_id", "key", "p.*"), "near-prints")

    banded = prints.select("set_id", F.explode("bands").alias("band"))
    least = banded.groupBy("band").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high")).where("low != high").select("band", "low")
    by_band = banded.join(least, "band").where("set_id != low").select(F.col("set_id").alias("u"), F.col("low").alias("v")).distinct()
    by_print = prints.where("size(bands) > 0").groupBy("fp").agg(F.min("set_id").alias("set_id"))
    links = link_forest(by_print.select("fp"), distance)
    u, v = by_print.toDF("u", "set_u"), by_print.toDF("v", "set_v")
    by_bits = links.join(u, "u").join(v, "v").select(F.col("set_u").alias("u"), F.col("set_v").alias("v"))
    same_print = prints.where("size(bands) > 0").join(by_print.withColumnRenamed("set_id", "low"), "fp").where("set_id != low").select(F.col("set_id").alias("u"), F.col("low").alias("v"))
    rooted = components(by_band.unionByName(by_bits).unionByName(same_print))

    named = rooted.select(F.col("v").alias("set_id"), "root").unionByName(rooted.select(F.col("root").alias("set_id"), "root").distinct())
    sizes = materialize(named.groupBy("root").agg(F.count("*").alias("n")), "near-sizes")
    named = spread_join(named, sizes.withColumn("slices", F.ceil(F.col("n") / group_sets)), ["root"], "n")
    one = prints.groupBy("set_id").agg(F.min("key").alias(key)).join(named, "set_id")
    texts = marked.select(key, "text").join(one, key).dropDuplicates(["set_id"])
    own, other = F.pmod(F.xxhash64("set_id"), F.col("slices")), F.col("other")
    texts = texts.select("root", "set_id", "text", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other"))
    keyed = texts.select(F.xxhash64("root", F.least("own", other), F.greatest("own", other)).alias("task"), "set_id", "text")
    ready = keyed.repartition("task").sortWithinPartitions("task")
    groups = components(ready.mapInArrow(_groups(shingle, similarity), "u long, v long")).toDF("set_id", "group")

    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"]
    copies = materialize(prints.groupBy("set_id").agg(F.count("*").alias("n")).join(groups, "set_id", "left"), "near-groups")
    grouped = spread_join(prints.select("doc_id", "key", "set_id"), copies, ["set_id"], "n").withColumn("group", F.coalesce("group", "set_id"))
    chosen = grouped.groupBy("group").agg(first.alias(key)).select(key)
    return marked.join(chosen, key, "left_semi").dropDuplicates([key]).select(*documents.columns)
