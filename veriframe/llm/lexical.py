"""Ranked lexical search by Fagin's threshold algorithm in shards of documents.

The items searched for are taken in blocks of at most ``MAX_ITEMS`` items and, unless one item alone has more,
``MAX_TERMS`` distinct terms, so what the driver sends to every task is bounded; each block is one pass over all whole texts.
A pass keeps of each document its length and how often it holds the block's terms (the forward index, a stored table),
counts from that how many documents hold a term, and searches shard by shard where the rows lie. A shard is as many
documents as ``SHARD_CELLS`` allows; its lists, one for each term, are sorted by impact, which is what the term adds to a
document's score. They are read in turn, some entries of each at a time; the full score of a document that comes up is
looked up in the forward index; reading stops once what an unread document can have at most, the sum of the impacts
read last, is below the k-th best score the task has found in this shard or earlier ones (strictly below: an equal score may have a smaller
id). Every task returns its best k for each item, and a rank over these, cut to k before they are shuffled, ends it.

Scores are whole numbers, so no order of addition changes them.

Edge cases: null and termless texts have no terms, count nowhere and are never found; an item without terms or
whose terms no document holds finds nothing; items are ranked one by one, also with equal or null ids; of equal scores
the smaller id comes first, null ids last, and repeated rows are documents of their own; texts of any length are read
whole; no documents or no items give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

K = 20
MAX_ITEMS = 1024
MAX_TERMS = 8192
SHARD_CELLS = 8_000_000  # documents times terms of a shard, eight bytes each
_STEP = 16  # entries of each list in the first turn; each turn reads twice as many as the one before

#: ASCII letters in lower case, digits and all bytes of other characters stay, the rest parts terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def blocks(items: Iterable[tuple[int, str | None]], max_items: int = MAX_ITEMS, max_terms: int = MAX_TERMS) -> Iterator[tuple[dict[bytes, int], list[tuple[int, dict[int, int]]]]]:
    """(number of each term, [(item, times of each term)]) of the items with terms, a block at a time."""
    numbers, held = {}, []
    for item, text in items:
        counts = Counter(terms_of(text))
        if held and (len(held) >= max_items or len(numbers) + sum(t not in numbers for t in counts) > max_terms):
            yield numbers, held
            numbers, held = {}, []
        if counts:
            held.append((item, {numbers.setdefault(t, len(numbers)): n for t, n in counts.items()}))
    if held:
        yield numbers, held


def forward_index(documents: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, times), stored, of every document with a term: its length, and which terms of ``numbers`` it holds
    how often. No shuffle."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths, terms, times = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = terms_of(text.as_py())
                if words:
                    found = [(numbers[t], n) for t, n in Counter(words).items() if t in numbers]
                    ids.append(i)
                    lengths.append(len(words))
                    terms.append([t for t, _ in found])
                    times.append([n for _, n in found])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "times"])

    return materialize(documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(index, "doc_id long, n long, terms array<int>, times array<long>"), "forward-index")


class Shard:
    """Documents' impacts by document (``forward``) and by term, largest first (``docs`` and ``impacts`` from ``start`` on)."""

    def __init__(self, rows: np.ndarray, terms: np.ndarray, impacts: np.ndarray, documents: int, vocabulary: int):
        self.forward = np.zeros((documents, vocabulary), np.int64)
        self.forward[rows, terms] = impacts
        some = impacts > 0
        rows, terms, impacts = rows[some], terms[some], impacts[some]
        order = np.lexsort((rows, -impacts, terms))
        self.docs, self.impacts = rows[order], impacts[order]
        self.start = np.searchsorted(terms[order], np.arange(vocabulary + 1))
        self.lookups = 0

    def search(self, terms: np.ndarray, times: np.ndarray, best: Best) -> None:
        begin, end = self.start[terms], self.start[terms + 1]
        some = end > begin
        terms, times, begin, end = terms[some], times[some], begin[some], end[some]
        if not len(terms):
            return
        seen, depth, step = np.zeros(len(self.forward), bool), 0, _STEP
        while True:
            at = begin[:, None] + np.arange(depth, depth + step)
            docs = np.unique(self.docs[at[at < end[:, None]]])
            docs = docs[~seen[docs]]
            seen[docs] = True
            self.lookups += len(docs)
            best.add(docs, self.forward[docs[:, None], terms] @ times)
            depth += step
            last = begin + depth - 1
            left = last < end - 1
            most = int((times * np.where(left, self.impacts[np.minimum(last, end - 1)], 0)).sum())
            if most == 0 or most < best.kth():
                return
            step *= 2


class Best:
    """The k best (score, id) of one item so far, equal scores by id, null ids last."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.missing = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.of = None  # ids and their nulls in the shard at hand

    def kth(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 0

    def add(self, docs: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= max(1, self.kth())
        if not good.any():
            return
        ids, missing = self.of
        scores, ids, missing = (np.concatenate(x) for x in ((self.scores, scores[good]), (self.ids, ids[docs[good]]), (self.missing, missing[docs[good]])))
        order = np.lexsort((ids, missing, -scores))[: self.k]
        self.scores, self.ids, self.missing = scores[order], ids[order], missing[order]


def best_of(index: DataFrame, numbers: dict[bytes, int], items: list[tuple[int, dict[int, int]]], k: int, cells: int = SHARD_CELLS) -> DataFrame:
    """(item, doc_id, score): each task's best ``k`` documents for each item."""
    total = index.agg(F.count("*").alias("n"), F.sum("n").alias("length")).first()
    documents, length = total["n"], total["length"]
    weights = np.array([weight(documents, 0)] * len(numbers), np.int64)
    for row in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most one row a term of the block
        weights[row["term"]] = weight(documents, row["count"])
    asked = [(item, np.array(list(t), np.int64), np.array(list(t.values()), np.int64)) for item, t in items]
    size = max(1, cells // len(numbers))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in asked]
        for part in _shards(batches, size):
            ids, n, terms, times = (part.column(c).combine_chunks() for c in range(4))
            sizes = np.diff(terms.offsets.to_numpy())
            rows = np.repeat(np.arange(len(ids)), sizes)
            m = np.array([75 + 25 * x * documents // length for x in n.to_pylist()], np.int64)[rows]
            term, tf = terms.flatten().to_numpy(), times.flatten().to_numpy()
            shard = Shard(rows, term, weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m)), len(ids), len(weights))
            of = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
            for (_, t, times_), found in zip(asked, best, strict=True):
                found.of = of
                shard.search(t, times_, found)
        for (item, _, _), found in zip(asked, best, strict=True):
            if len(found.scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found.ids), item)), pa.array(found.ids, mask=found.missing), pa.array(found.scores)], ["item", "doc_id", "score"])

    return index.mapInArrow(search, "item long, doc_id long, score long")


def _shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - rows)
            batch = batch.slice(part.num_rows)
            held.append(part)
            rows += part.num_rows
            if rows == size:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held)


def ranked(documents: DataFrame, items: Iterable[tuple[int, str | None]], k: int = K, max_items: int = MAX_ITEMS, max_terms: int = MAX_TERMS, cells: int = SHARD_CELLS) -> DataFrame:
    """(item, rank, doc_id, score): the ``k`` best documents for each of items (number, text)."""
    found = None
    for numbers, held in blocks(items, max_items, max_terms):
        part = materialize(best_of(forward_index(documents, numbers), numbers, held, k, cells), "lexical-best")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = documents.sparkSession.createDataFrame([], "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").isNull(), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def op12_ranked_lexical_search(spark, sf_dir: str) -> DataFrame:
    items = materialize(table(spark, sf_dir, "benchmark").select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text"), "lexical-items")
    found = ranked(table(spark, sf_dir, "documents"), ((r["item"], r["text"]) for r in items.toLocalIterator()))
    return found.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


OP12_SQL = r"""
WITH words AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
docs AS (SELECT doc_id, r, len(w) AS n, w FROM words WHERE len(w) > 0),
sums AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM docs),
held AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM docs) GROUP BY r, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(s.docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM held, sums s GROUP BY term),
items AS (SELECT i, item_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark)),
asked AS (SELECT i, item_id, term, count(*)::BIGINT AS times FROM items GROUP BY ALL),
scores AS (SELECT i, item_id, d.r, d.doc_id, CAST(sum(times * w.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * d.n * s.docs) // s.length)))) AS BIGINT) AS score
    FROM asked JOIN held USING (term) JOIN weights w USING (term) JOIN docs d USING (r), sums s GROUP BY i, item_id, d.r, d.doc_id),
best AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM best WHERE rank <= 20"""
