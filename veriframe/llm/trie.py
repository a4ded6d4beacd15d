"""Prefix trie of conversations as a Cartesian tree over sorted conversations.

A turn is known by a digest of its role and text, a conversation by the digests of its turns one after the other, so bytes
sort conversations in such an order that those with the same first turns stand together. Between two
neighbours stands the number of first turns they share (LCP). The sequence of lengths and LCPs,
length, LCP, length, LCP, ..., length, holds the trie: a node is a value of it with the run up to the nearest smaller
values on either side, equal values of one run being one node.

Nearest smaller values are found in parallel. Each block of the sorted conversations (a range partition) closes with a
stack the nodes that have both of theirs in the block. What stays open are the block's minima from the left and from the right, at most
as many as the block's first and last conversation have turns. Neighbouring blocks are joined by the LCP between them, which closes more,
``FAN`` blocks at a time until one is left. A node takes the counts of its subtree along when it is
closed. At the end the depths between a node and its parent, where nothing branches or ends, are put in.

Texts leave a turn's row as digest and number of words. One conversation's digests and word counts are one row (24 bytes a
turn, so of some tens of millions of turns at most); equal conversations, or those with the same first turns, may be any share of all.
The digest of the ids that end at a node is taken over the ids in order: within a block as they come, over
blocks from strings of up to ``CHUNK`` ids, so that a task holds one such string at a time.

Edge cases: turns with equal numbers (null first) stand in order of role and then of digest, repeated ones are turns of
their own; null roles and texts are empty; rows without conv_id belong to no conversation; conversations without turns
end at the root; a conversation whose base is absent has its own later turns only; long texts are read whole; an empty
table has no nodes, not even a root; other columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, spread_join, table

WORD = r"[^\x20\x09-\x0D]+"
DIGEST = 16  # bytes of a turn's
FAN = 64
CHUNK = 65536
NOTHING = hashlib.sha256(b"").hexdigest()

_FIELDS = "kind string, id binary, parent binary, conv_id long, depth long, parent_depth long, n_convs long, n_children long, n_leaves long, below long, block int, first long, data binary"
_NAMES = [x.split()[0] for x in _FIELDS.split(", ")]
_TYPES = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32()}
_SCHEMA = pa.schema([(n, _TYPES[k]) for n, k in (x.split() for x in _FIELDS.split(", "))])


# ---- conversations


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as structs with ``digest`` (hexadecimal) and ``words``."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    turn = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def rebuilt(own: DataFrame, every: int = 20, kinds: int = 4) -> DataFrame:
    """``own`` with each conversation's first h turns replaced by those of the conversation that the ``every`` ids from
    one of its multiples on share; h is a hash of the id modulo ``kinds``."""
    heads = own.select(F.col("conv_id").alias("base"), F.slice("turns", 1, max(1, kinds - 1)).alias("head"))
    rows = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(heads, "base", "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % kinds).cast("int")
    head = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), h))
    return rows.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def paths(whole: DataFrame) -> DataFrame:
    """(conv_id, path, words): all digests as one binary, words of each turn."""
    return whole.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"), F.transform("turns", lambda t: t["words"]).alias("words"))


# ---- the tree


class Node:
    """An open node: ``words`` up to its depth, and of its subtree so far the members (``n``, smallest ``low``), children, leaves and
    the tokens saved below it."""

    __slots__ = ("depth", "id", "words", "n", "low", "children", "leaves", "below")

    def __init__(self, depth: int, id: bytes, words: int, n: int = 0, low: int | None = None):
        self.depth, self.id, self.words, self.n, self.low = depth, id, words, n, low
        self.children = self.leaves = self.below = 0

    def take(self, n: int, low: int | None, leaves: int, below: int, children: int) -> None:
        self.n, self.leaves, self.below, self.children = self.n + n, self.leaves + leaves, self.below + below, self.children + children
        if low is not None:
            self.low = low if self.low is None else min(self.low, low)


def shared(a: bytes, b: bytes) -> int:
    """How many first turns two paths share."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * DIGEST : middle * DIGEST] == b[low * DIGEST : middle * DIGEST]:
            low = middle
        else:
            high = middle - 1
    return low


class Run:
    """A run of conversations: ``left`` are the open nodes whose run ends inside (falling minima from the left), ``stack``
    those that may go on to the right (rising, its bottom is the smallest of all)."""

    def __init__(self):
        self.left, self.stack, self.closed = [], [], []
        self.first = self.last = None  # paths
        self.first_words = []

    def put(self, node: Node) -> None:
        while self.stack and self.stack[-1].depth > node.depth:
            done = self.stack.pop()
            if not self.stack:
                self.left.append(done)
                break
            below = self.stack[-1]
            self.close(done, below if below.depth >= node.depth else node)
        if self.stack and self.stack[-1].depth == node.depth:
            self.stack[-1].take(node.n, node.low, node.leaves, node.below, node.children)
        else:
            self.stack.append(node)

    def close(self, node: Node, parent: Node) -> None:
        leaves = node.leaves or 1
        self.closed.append(("node", node.id, parent.id, node.low, node.depth, parent.depth, node.n, node.children, leaves, node.below, None, None, None))
        parent.take(node.n, node.low, leaves, node.below + (node.n - 1) * (node.words - parent.words), 1)

    def add(self, conv: int, path: bytes, words: list[int]) -> None:
        sums = [0, *accumulate(words)]
        if self.last is None:
            self.first, self.first_words = path, sums
        else:
            self._boundary(path, sums)
        self.put(Node(len(sums) - 1, hashlib.md5(path).digest(), sums[-1], 1, conv))
        self.last = path

    def _boundary(self, path: bytes, sums: list[int]) -> None:
        n = shared(self.last, path)
        if not (self.stack and self.stack[-1].depth == n):
            self.put(Node(n, hashlib.md5(path[: n * DIGEST]).digest(), sums[n]))

    def join(self, later: Run) -> None:
        """Go on with the run that follows."""
        if self.last is None:
            self.first, self.first_words = later.first, later.first_words
        else:
            self._boundary(later.first, later.first_words)
        for node in (*later.left, *later.stack):
            self.put(node)
        self.last = later.last

    def finish(self) -> None:
        root = lambda: Node(0, hashlib.md5(b"").digest(), 0)
        whole = Run()
        whole.put(root())
        for node in (*self.left, *self.stack, root()):
            whole.put(node)
        top = whole.stack[0]
        self.closed += [*whole.closed, ("node", top.id, None, top.low, 0, -1, top.n, top.children, top.leaves or 1, top.below, None, None, None)]

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.closed:
            yield _batch(self.closed)
            self.closed = []

    def row(self, block: int) -> tuple:
        self.closed = []
        return ("open", *[None] * 9, block, None, pickle.dumps(self))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)


class _Ends:
    """Ids of equal conversations that follow each other: a digest where a block has them all, else strings."""

    def __init__(self):
        self.id, self.ids, self.whole, self.rows = None, [], False, []

    def add(self, id: bytes, conv: int) -> None:
        if id != self.id:
            self.flush(last=False)
            self.whole, self.id = self.id is not None, id  # the block's first may have begun in an earlier one
        elif len(self.ids) == CHUNK:
            self._part()
        self.ids.append(conv)

    def _part(self) -> None:
        self.whole = False
        self.rows.append(("part", self.id, *[None] * 9, self.ids[0], ",".join(map(str, self.ids)).encode()))
        self.ids = []

    def flush(self, last: bool) -> None:
        if not self.ids:
            return
        if last or not self.whole:
            self._part()
        else:
            digest = hashlib.sha256(",".join(map(str, self.ids)).encode()).hexdigest().encode()
            self.rows.append(("ends", self.id, *[None] * 10, digest))
            self.ids = []


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    run, ends, block = Run(), _Ends(), TaskContext.get().partitionId()
    for batch in batches:
        for conv, path, words in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            run.add(conv, path, words)
            ends.add(hashlib.md5(path).digest(), conv)
        yield from run.rows()
        if ends.rows:
            yield _batch(ends.rows)
            ends.rows = []
    if run.last is not None:
        ends.flush(last=True)
        yield _batch([*ends.rows, run.row(block)])


def _joined(last: bool):
    def join(rows: pa.Table) -> pa.Table:
        run = Run()
        order = sorted(zip(rows["block"].to_pylist(), rows["data"].to_pylist(), strict=True))
        for _, data in order:
            run.join(pickle.loads(data))
        if last:
            run.finish()
        out = [*run.rows()]
        return pa.Table.from_batches(out if last else [*out, _batch([run.row(rows["later"][0].as_py())])], _SCHEMA)

    return join


def tree(known: DataFrame, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Nodes where the trie of (conv_id, path, words) branches or conversations end, and (id, ends_sha256) of the latter."""
    order = ["path", "conv_id"]
    blocks = materialize(known.select("conv_id", "path", "words").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_block, _FIELDS), "trie-blocks")
    nodes, still = blocks.where("kind = 'node'"), blocks.where("kind = 'open'")
    left = still.count()
    while True:
        last = left <= fan
        grouped = still.select(F.expr("0" if last else f"block div {fan}").cast("int").alias("later"), "block", "data").groupBy("later")
        joined = materialize(grouped.applyInArrow(_joined(last), _FIELDS), "trie-joined")
        nodes = nodes.unionByName(joined.where("kind = 'node'"))
        if last:
            return nodes, _ends(blocks)
        still = joined.where("kind = 'open'")
        left = still.count()


def _ends(blocks: DataFrame) -> DataFrame:
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for id, data in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if id != key:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = id, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(data.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in ((0, pa.binary()), (1, pa.string()))], ["id", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["id", "ends_sha256"])

    parts = blocks.where("kind = 'part'").select("id", "first", "data").repartition("id").sortWithinPartitions("id", "first")
    return blocks.where("kind = 'ends'").select("id", F.col("data").cast("string").alias("ends_sha256")).unionByName(parts.mapInArrow(digests, "id binary, ends_sha256 string"))


# ---- all depths


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    types = [pa.int64()] * 7 + [pa.string()]
    for batch in batches:
        out = []
        columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "below", "ends_sha256", "words")
        for conv, depth, parent, n, children, leaves, saved, ends, words in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns), strict=True):
            top = depth - len(words) + 1  # the first depth below the parent
            for d in range(depth, min(top, depth) - 1, -1):
                saved += (n - 1) * (words[d - top] if words else 0)
                out.append((conv, d, parent if d == top or not words else conv, n, children if d == depth else 1, leaves, saved, (ends or NOTHING) if d == depth else NOTHING))
                if len(out) == 65536:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def prefix_trie(whole: DataFrame, fan: int = FAN) -> DataFrame:
    """A row for each distinct sequence of first turns of ``whole`` (conv_id, turns), as ``conversations`` or ``rebuilt`` give it."""
    known = materialize(paths(whole), "trie-paths")
    nodes, ends = tree(known, fan)
    nodes = materialize(nodes, "trie-nodes")
    parents = nodes.where("n_children > 0").select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    columns = ["id", "conv_id", "depth", "parent_depth", "parent_conv_id", "n_convs", "children", "n_leaves", "below"]
    below = spread_join(nodes.withColumnRenamed("n_children", "children"), parents, ["parent"], "n_children").select(columns)
    root = nodes.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long")).withColumnRenamed("n_children", "children").select(columns)
    rows = below.unionByName(root).withColumnRenamed("children", "n_children").join(ends, "id", "left").join(known.select("conv_id", "words"), "conv_id")
    from_, length = F.greatest("parent_depth", F.lit(0)) + 1, F.col("depth") - F.greatest("parent_depth", F.lit(0))
    rows = rows.withColumn("words", F.slice("words", from_.cast("int"), length.cast("int"))).drop("id", "parent_depth")
    return rows.mapInArrow(_expand, "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")


def op11_conversation_trie(spark, sf_dir: str) -> DataFrame:
    own = materialize(conversations(table(spark, sf_dir, "conversations")), "trie-turns")
    return prefix_trie(rebuilt(own))


OP11_SQL = r"""
WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
        ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda s, c: list_reduce(list_prepend(xor(s, c), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))) AS crc FROM turns),
whole AS (SELECT c.conv_id, t.p, t.role, t.text FROM (SELECT conv_id, base, xor(crc, 4294967295) % 4 AS h FROM convs) c JOIN turns t ON t.conv_id = c.base AND t.p <= c.h
    UNION ALL SELECT c.conv_id, t.p, t.role, t.text FROM (SELECT conv_id, xor(crc, 4294967295) % 4 AS h FROM convs) c JOIN turns t ON t.conv_id = c.conv_id AND t.p > c.h),
placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY p) AS d, md5(strlen(role) || ':' || role || text) AS digest, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM whole),
path AS (SELECT conv_id, d, md5(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY d)) AS node, words FROM placed
    UNION ALL SELECT conv_id, 0, 'root', 0 FROM convs),
ends AS (SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, arg_max(node, d) AS node FROM path GROUP BY conv_id) GROUP BY node),
nodes AS (SELECT node, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words FROM path GROUP BY node),
linked AS (SELECT n.*, p.node AS parent FROM nodes n LEFT JOIN path p ON p.conv_id = n.conv_id AND p.d = n.d - 1),
kids AS (SELECT parent, count(*) AS kids FROM linked WHERE parent IS NOT NULL GROUP BY parent),
below AS (SELECT p.node, sum((n.n - 1) * n.words) AS saved, count(*) FILTER (WHERE k.kids IS NULL) AS leaves
    FROM linked n JOIN path p ON p.conv_id = n.conv_id AND p.d <= n.d LEFT JOIN kids k ON k.parent = n.node GROUP BY p.node)
SELECT l.conv_id, l.d::BIGINT AS depth, q.conv_id AS parent_conv_id, l.n::BIGINT AS n_convs, coalesce(k.kids, 0)::BIGINT AS n_children, b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM linked l LEFT JOIN nodes q ON q.node = l.parent LEFT JOIN kids k ON k.parent = l.node JOIN below b ON b.node = l.node LEFT JOIN ends e ON e.node = l.node"""
