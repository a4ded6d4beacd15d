"""Best-fit packing of tokenised documents by patterns fitted with non-negative least squares.

Only the histogram of piece lengths (at most ``max_tokens`` numbers) reaches the driver. There, length
patterns of up to three pieces that fill a sequence exactly are enumerated, their repeat counts are
fitted to the histogram by non-negative least squares and rounded, and what is left is packed best fit
first. Pieces then find their pattern, repeat and offset by their rank among the pieces of their length;
ranks come from windows over (length, bucket), where a length has as many buckets as its count needs.

Edge cases: a null text is empty and packs as the end token alone; repeated rows are packed as separate
documents; null ids pass through; no rows give no sequences; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, table
from .tokens import byte_bpe, default_vocabulary

MAX_TOKENS = 1024
END_ID = 2
#: Pieces of one length that are ranked in one task.
BUCKET_ROWS = 65_536

Pattern = tuple[int, ...]


def cut(n: int, max_tokens: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids; all but the first are full."""
    first = n % max_tokens or min(n, max_tokens)
    return [(0, first)] + [(s, max_tokens) for s in range(first, n, max_tokens)]


def tokenized_pieces(documents: DataFrame, max_tokens: int = MAX_TOKENS, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece of every whole text; ``with_ids`` adds the ids themselves."""
    path = vocabulary or default_vocabulary()
    schema = T.StructType([documents.schema["doc_id"], *T.StructType.fromJson({"type": "struct", "fields": [
        {"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in (("piece", "integer"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"))]})])
    if with_ids:
        schema.add("ids", T.ArrayType(T.IntegerType()))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(path)
        for batch in batches:
            at, number, starts, lengths, crcs, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                own = np.append(encode(text.as_py()), np.uint32(END_ID)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(own), max_tokens)):
                    part = own[start : start + length]
                    at.append(row), number.append(k), starts.append(start), lengths.append(length)
                    crcs.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        ids.append(part.astype(np.int32))
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return documents.select("doc_id", "text").mapInArrow(pieces, schema)


def enumerate_patterns(histogram: np.ndarray) -> np.ndarray:
    """All (a, b, c), a >= b >= c, of lengths that occur and fill a sequence exactly; 0 is no piece."""
    full = len(histogram) - 1
    there = np.flatnonzero(histogram > 0)
    there = np.append(0, there[there > 0])
    b, c = (x.ravel() for x in np.meshgrid(there, there, indexing="ij"))
    a = full - b - c
    keep = (b >= c) & (a >= b) & (a > 0)
    a, b, c = a[keep], b[keep], c[keep]
    keep = histogram[a] > 0
    return np.stack([a[keep], b[keep], c[keep]], 1)


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """min |A x - histogram| over x >= 0 by accelerated projected gradient steps; a column of A has at
    most three entries, so A is never stored."""
    target = histogram.astype(float)
    target[0] = 0
    uses = np.bincount(patterns.ravel(), minlength=len(target)).astype(float)
    step = 1 / (3 * max(1.0, uses[1:].max()))
    weight = np.ones(len(target))
    weight[0] = 0
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        made = sum(np.bincount(patterns[:, i], y, len(target)) for i in range(3))
        left = (made - target) * weight
        new = np.maximum(0, y - step * left[patterns].sum(1))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def rounded(patterns: np.ndarray, repeats: np.ndarray, histogram: np.ndarray) -> tuple[Counter[Pattern], np.ndarray]:
    """Whole repeat counts whose running sum follows that of ``repeats``, within what the histogram has."""
    left = histogram.astype(np.int64).copy()
    order = np.lexsort(patterns.T[::-1])[::-1]
    whole = np.diff(np.floor(np.cumsum(repeats[order]) + 0.5), prepend=0).astype(np.int64)
    plan: Counter[Pattern] = Counter()
    for p, n in zip(patterns[order][whole > 0].tolist(), whole[whole > 0].tolist(), strict=True):
        own = Counter(v for v in p if v)
        n = min(n, *(int(left[v]) // k for v, k in own.items()))
        if n > 0:
            plan[tuple(v for v in p if v)] += n
            for v, k in own.items():
                left[v] -= n * k
    return plan, left


def best_fit(left: np.ndarray) -> Counter[Pattern]:
    """Longest pieces first, each into the fullest open sequence that has room; equal ones at a time."""
    full = len(left) - 1
    open_: list[dict[Pattern, int]] = [{} for _ in range(full + 1)]  # by room
    for length in range(full, 0, -1):
        n, room = int(left[length]), length
        while n:
            while room <= full and not open_[room]:
                room += 1
            if room > full:  # new sequences, then go on filling those
                per = full // length
                k, rest = divmod(n, per)
                for count, many in ((k, per), (1, rest)):
                    if count and many:
                        own = open_[full - many * length]
                        own[(length,) * many] = own.get((length,) * many, 0) + count
                break
            pattern, count = open_[room].popitem()
            k = min(n, count)
            if count > k:
                open_[room][pattern] = count - k
            own = open_[room - length]
            own[(*pattern, length)] = own.get((*pattern, length), 0) + k
            n -= k
            room = max(length, room - length) if room - length >= length else room
    plan: Counter[Pattern] = Counter()
    for own in open_:
        plan.update(own)
    return plan


@dataclass(frozen=True)
class PackingPlan:
    """Slots sorted by (length, first rank): the pieces of a length with ranks from ``first`` on go to the
    sequences from ``sequence`` on, at ``offset``."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide = np.int64(1) << 40
        at = np.searchsorted(self.length * wide + self.first, length * wide + rank, side="right") - 1
        return self.sequence[at] + rank - self.first[at], self.offset[at]


def make_plan(histogram: np.ndarray) -> PackingPlan:
    """histogram[v]: pieces of length v, for v up to a full sequence. Works on lengths only."""
    patterns = enumerate_patterns(histogram)
    plan: Counter[Pattern] = Counter()
    left = histogram.astype(np.int64)
    if len(patterns):
        plan, left = rounded(patterns, fit_repeats(patterns, histogram), histogram)
    plan.update(best_fit(left))
    slots, used, sequence = [], Counter(), 0
    for pattern, n in sorted(plan.items(), reverse=True):
        offset = 0
        for v in pattern:
            slots.append((v, used[v], sequence, offset))
            used[v] += n
            offset += v
        sequence += n
    columns = np.array(sorted(slots), np.int64).reshape(-1, 4).T
    return PackingPlan(*columns, sequences=sequence)


def pack_pieces(pieces: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``pieces`` (a stored table with length) with ``sequence_id`` and ``offset``."""
    histogram = np.zeros(max_tokens + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # max_tokens rows at most
        histogram[r["length"]] = r["count"]
    plan = make_plan(histogram)
    buckets = F.array(*(F.lit(int(-(-n // BUCKET_ROWS) or 1)) for n in histogram.tolist()))
    spread = F.xxhash64("doc_id", "piece", "ids_crc32")
    keyed = pieces.withColumn("bucket", F.pmod(spread, F.element_at(buckets, (F.col("length") + 1).cast("int"))))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("inside", F.row_number().over(inside) - 1).join(starts, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("inside"))

    @F.pandas_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def placed(length, rank):
        import pandas as pd

        sequence, offset = plan.place(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return ranked.withColumn("place", placed("length", "rank")).select(*pieces.columns, "place.sequence_id", "place.offset")


def pack(documents: DataFrame, max_tokens: int = MAX_TOKENS, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    return pack_pieces(materialize(tokenized_pieces(documents, max_tokens, vocabulary, with_ids), "pieces"), max_tokens)


def packed_sequences(documents: DataFrame, max_tokens: int = MAX_TOKENS, vocabulary: str | None = None) -> DataFrame:
    """(sequence_id, ids, doc_ids, lengths): a group has at most ``max_tokens`` ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    rows = pack(documents, max_tokens, vocabulary, True).groupBy("sequence_id").agg(parts.alias("parts"))
    return rows.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.length").alias("lengths"))


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
