import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veriframe.llm import sharding

from . import data


def smallest_capacity(sizes, shards):
    """By dynamic programming over all contiguous partitions."""
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        new = [0] * (len(sizes) + 1)
        for i in range(1, len(sizes) + 1):
            total, low = 0, best[i]
            for j in range(i, 0, -1):
                total += sizes[j - 1]
                low = min(low, max(best[j - 1], total))
            new[i] = low
        best = new
    return best[-1]


def look_in(ends):
    def look(asked):
        for low, high, step in asked:
            found = defaultdict(list)
            for e in ends:
                if low < e < high:
                    found[(e - low) // step].append(e)
            yield from ((min(x), max(x), len(x)) for x in found.values())

    return look


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 9), st.integers(1, 400)), min_size=1, max_size=40), st.integers(1, 7), st.sampled_from([2, 3, 8, 64]))
def test_capacity_is_the_smallest_and_cuts_keep_it(sizes, shards, blocks):
    ends = np.cumsum(sizes).tolist()
    capacity, cuts = sharding.Ends(ends[-1], look_in(ends), blocks).cuts(shards)
    assert capacity == smallest_capacity(sizes, shards)
    assert len(cuts) == shards and cuts == sorted(cuts) and cuts[-1] == ends[-1] and set(cuts) <= {0, *ends}
    assert max(b - a for a, b in zip([0, *cuts], cuts, strict=False)) == capacity
    assert (capacity, cuts) == sharding.Ends(ends[-1], look_in(ends), 10_000).cuts(shards)  # blocks change nothing


def test_the_search_reads_few_of_many_ends():
    rng = random.Random(3)
    ends = np.cumsum([rng.randrange(9, 5000) for _ in range(200_000)])

    def look(asked):
        for low, high, step in asked:
            inside = ends[(ends > low) & (ends < high)]
            _, at, n = np.unique((inside - low) // step, return_index=True, return_counts=True)
            yield from zip(inside[at].tolist(), inside[at + n - 1].tolist(), n.tolist(), strict=True)

    search = sharding.Ends(int(ends[-1]), look, 1024)
    capacity, cuts = search.cuts(24)
    assert search.seen < 10_000
    assert capacity - int(ends[-1]) / 24 < 5000 and max(np.diff([0, *cuts])) == capacity


def test_large_groups_stand_alone():
    assert sharding.own_shards([900, 50, 40], 1000, 4) == 3  # 900 of 1000 over 4, 50 of 100 over 3, 40 of 50 over 2
    assert sharding.own_shards([25, 25], 100, 4) == 0
    assert sharding.own_shards([1000], 1000, 1) == 0


def check(rows, shards):
    """What holds of every result; returns the bytes of each shard."""
    texts, slots, sizes = defaultdict(set), defaultdict(list), [0] * shards
    for r in rows:
        texts[r["group"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(len(x) == 1 for x in texts.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return sizes


@pytest.mark.parametrize("shards", [1, 2, 5, 24])
def test_edges(spark, shards):
    docs = data.documents(spark)
    rows = docs.select(F.col("doc_id").alias("id"), sharding.text_size(F.col("text")).alias("size"), sharding.text_group(F.col("text")).alias("group"), "text", "lang")
    got = sharding.place(rows, shards).collect()
    assert sorted((r["id"] is None, r["id"] or 0, r["text"] or "", r["lang"] or "") for r in got) == sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", r["lang"] or "") for r in docs.collect())
    assert all(r["size"] == len((r["text"] or "").encode()) + 8 for r in got)
    sizes = check(got, shards)
    groups, first = defaultdict(int), {}
    for r in docs.collect():
        t = r["text"] or ""
        groups[t] += len(t.encode()) + 8
        first[t] = min(first.get(t, (True, 0)), (r["doc_id"] is None, r["doc_id"] or 0))
    order = sorted(groups, key=lambda t: -groups[t])
    alone = sharding.own_shards([groups[t] for t in order], sum(groups.values()), shards)
    rest = [groups[t] for t in sorted(order[alone:], key=lambda t: first[t])]
    assert max(sizes[alone:], default=0) == (smallest_capacity(rest, shards - alone) if rest else 0)


def test_one_group_may_hold_a_third_and_sizes_are_near_equal(spark):
    rng = random.Random(7)
    docs = data.documents(spark, [(i, data.words(rng, rng.randrange(1, 120)) if i % 3 else "the same " * 40) for i in range(3000)])
    rows = docs.select(F.col("doc_id").alias("id"), sharding.text_size(F.col("text")).alias("size"), sharding.text_group(F.col("text")).alias("group"))
    sizes = check(sharding.place(rows, 8, blocks=64).collect(), 8)
    assert sizes[0] == 1000 * 368  # the large group alone
    assert max(sizes[1:]) - min(sizes[1:]) < 1000


def test_query_and_files(spark, tmp_path):
    docs = data.documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sharding.op13_sharding(spark, str(tmp_path)).collect()
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)} and all(0 <= r["shard"] < 24 for r in got)
    sharding.write_shards(docs.withColumn("shard", F.lit("taken")), str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {*docs.columns, "shard", "_shard"} and back.count() == docs.count()


def test_nothing(spark):
    none = data.empty(spark).select(F.col("doc_id").alias("id"), sharding.text_size(F.col("text")).alias("size"), sharding.text_group(F.col("text")).alias("group"))
    assert sharding.place(none).collect() == []
