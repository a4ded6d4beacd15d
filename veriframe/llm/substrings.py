"""Substring deduplication over a log-structured fingerprint index.

Of every ``WINDOW`` words in a row the smallest hash of ``ANCHOR`` words in a row is the window's
fingerprint; equal windows have equal fingerprints, and neighbours mostly share theirs, so that about
one in fourteen positions is kept. Windows in a row that share a fingerprint h are a unit, named by a 128-bit
BLAKE2 digest of its words.

The index is a list of immutable runs: bucketed tables sorted by h, with one row for each fingerprint (how often
it stands in the batch, the smallest and largest content under it). A new batch becomes a run and is merge-joined,
bucket by bucket and without a shuffle, with the runs before it; when runs outnumber ``MAX_RUNS`` they are compacted
into one. An index has a name in the session's catalog and may be opened again for the next batch.

Fingerprints met twice are suspects, and suspects are verified: a unit whose digest stands elsewhere repeats as a
whole; where a fingerprint has units of different contents, as at the ends of a shared passage, single windows
are compared by 128-bit digests of their words, a content that many documents share in one of them. Only digests
of words decide on a removal; fingerprints, which are cheap polynomials, only say what to compare.

Results are sets of digests of repeated windows, so they don't depend on the order of rows or on unique ids.

Edge cases: a null or wordless text has 0 words and the hash of nothing; texts shorter than a window are
kept whole; repeated rows (and null ids) are documents of their own, so their windows repeat; no rows
give no rows; other columns are not read (``remove_repeats`` passes them through). A very long text is held by
one task, with some thirty bytes of memory for each of its own.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialize, packed, spread_join, table, unpacker

WINDOW = 35
ANCHOR = 8
#: Runs that an index may have before they are compacted into one.
MAX_RUNS = 2
#: Batches in which a whole corpus is put through the index: the third compacts it, the fourth meets the compacted run.
BATCHES = 4

_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


@lru_cache(maxsize=8)
def _powers(base: int, bits: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2**64."""
    out = np.ones(1 << bits, np.uint64)
    step = base
    for i in range(bits):
        out[1 << i : 2 << i] = out[: 1 << i] * np.uint64(step)
        step = step * step % (1 << 64)
    return out


def _stretch_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of values[s:e], all from one running sum."""
    bits = max(12, int(len(values)).bit_length())
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, bits)[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * _powers(pow(base, -1, 1 << 64), bits)[starts]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def word_hashes(joined: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    h = _stretch_hashes(np.frombuffer(joined, np.uint8).astype(np.uint64) + np.uint64(1), starts, ends, _BYTE_BASE)
    return _mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` values in a row."""
    done = 1
    while done < width:
        step = min(done, width - done)
        a = np.minimum(a[:-step], a[step:])
        done += step
    return a


class Units:
    """A text's words and its windows by units: runs of windows with the same fingerprint (``h``). ``first`` and
    ``last`` are a unit's windows, ``content`` its digest (two longs). ``places`` is 2 where the fingerprint has
    more places in the text than units, so that windows may repeat within one."""

    def __init__(self, raw: bytes, window: int = WINDOW, anchor: int = ANCHOR):
        self.window = window
        self.joined = b" ".join(raw.split())
        gaps = np.flatnonzero(np.frombuffer(self.joined, np.uint8) == 32)
        none = np.zeros(0, np.int64)
        self.starts, self.ends = (np.append(0, gaps + 1), np.append(gaps, len(self.joined))) if self.joined else (none, none)
        self.h, self.first, self.last, self.places = np.zeros(0, np.uint64), none, none, none
        self.content = np.zeros((0, 2), np.int64)
        if len(self.starts) < window:
            return
        words = word_hashes(self.joined, self.starts, self.ends)
        at = np.arange(len(words) - anchor + 1)
        anchors = _mixed(_stretch_hashes(words, at, at + anchor, _WORD_BASE))
        low = sliding_min(anchors, window - anchor + 1)
        cuts = np.flatnonzero(low[1:] != low[:-1]) + 1
        self.first, self.last = np.append(0, cuts), np.append(cuts, len(low)) - 1
        self.h = low[self.first]
        self.content = self.digests(self.first, self.last)
        own, places = np.unique(anchors, return_counts=True)
        kept, units = np.unique(self.h, return_counts=True)
        more = kept[places[np.searchsorted(own, kept)] > units]
        self.places = 1 + np.isin(self.h, more)

    def digests(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Two longs for the words from each first window's to the end of the last one's."""
        spans = zip(self.starts[first].tolist(), self.ends[last + self.window - 1].tolist(), strict=True)
        found = b"".join([hashlib.blake2b(self.joined[a:b], digest_size=16).digest() for a, b in spans])
        return np.frombuffer(found, np.int64).reshape(-1, 2)

    def inside(self, contents: set[tuple[int, int]]) -> np.ndarray:
        """For every window whether its unit's content is one of ``contents``."""
        which = np.fromiter((tuple(c) in contents for c in self.content.tolist()), bool, len(self.content))
        return np.repeat(which, self.last - self.first + 1)


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _rows(parts: list[tuple], names: list[str]) -> pa.RecordBatch:
    """parts: (doc, count, *columns of that many values)."""
    docs = np.repeat(np.array([p[0] for p in parts], np.int64), [p[1] for p in parts])
    rest = [np.concatenate([p[i] for p in parts]) for i in range(2, len(parts[0]))]
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (docs, *rest)], names)


def document_key():
    """A hash of id and text, never null: only rows equal in both share it, and so they share all their windows."""
    return F.xxhash64("doc_id", "text")


def document_fingerprints(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc, h, u, v, n): each document's units, by fingerprint and content, and the fingerprint's places; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                units = Units(_raw(text.as_py()), window, anchor)
                if len(units.h):
                    parts.append((doc, len(units.h), units.h, *units.content.T.copy(), units.places))
            if parts:
                yield _rows(parts, ["doc", "h", "u", "v", "n"])

    return documents.select(document_key().alias("doc"), "text").mapInArrow(run, "doc long, h long, u long, v long, n long")


class FingerprintIndex:
    """Sorted immutable runs of window fingerprints, kept as bucketed tables of the session's catalog. A row is
    (h, n, low, high): places of the fingerprint, smallest and largest content under it. Aggregated before the
    shuffle and once more in it, a fingerprint that all documents share is one row of a run.

    An index of the same ``name`` is the same index, in this session or a later one with the same catalog."""

    def __init__(self, spark: SparkSession, name: str | None = None, max_runs: int = MAX_RUNS):
        self.spark, self.max_runs = spark, max_runs
        self.name = name or f"fingerprints_{uuid.uuid4().hex}"
        self.runs = sorted(r.tableName for r in spark.sql(f"SHOW TABLES LIKE '{self.name}_run_*'").collect())
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, rows: DataFrame) -> str:
        number = 1 + max((int(r.rsplit("_", 1)[1]) for r in self.runs), default=0)
        name = f"{self.name}_run_{number:06}"
        rows.write.bucketBy(self.buckets, "h").sortBy("h").format("parquet").saveAsTable(name)
        return name

    def append(self, fingerprints: DataFrame) -> DataFrame:
        """Adds a batch (h, u, n) as a new run and merge-joins it with the runs before. Returns (h, n, low, high) over
        history and batch of the batch's fingerprints that have a second place by now."""
        earlier = list(self.runs)
        batch = fingerprints.groupBy("h").agg(F.sum("n").alias("n"), F.min("u").alias("low"), F.max("u").alias("high"))
        self.runs.append(self._write(batch))
        met = self.spark.table(self.runs[-1])
        for i, run in enumerate(earlier):
            past = self.spark.table(run).toDF("h", f"n{i}", f"low{i}", f"high{i}")
            met = met.join(past, "h", "left")
        names = [f"{i}" for i in range(len(earlier))]
        total = reduce(lambda a, i: a + F.coalesce(f"n{i}", F.lit(0)), names, F.col("n"))
        least = F.least("low", *(f"low{i}" for i in names)) if names else F.col("low")
        most = F.greatest("high", *(f"high{i}" for i in names)) if names else F.col("high")
        return met.select("h", total.alias("n"), least.alias("low"), most.alias("high")).where("n > 1")

    def compact(self, force: bool = False) -> None:
        """Merges all runs into one when they are too many; call it when no plan reads them any more."""
        if len(self.runs) > (1 if force else self.max_runs):
            # by merge joins: Spark 4.1 takes a union of bucketed tables for bucketed, but reads it table after table
            merged = self.spark.table(self.runs[0])
            for run in self.runs[1:]:
                past = self.spark.table(run).toDF("h", "m", "least", "most")
                n = F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))
                merged = merged.join(past, "h", "full").select("h", n.alias("n"), F.least("low", "least").alias("low"), F.greatest("high", "most").alias("high"))
            new = self._write(merged)
            for run in self.runs:
                self.spark.sql(f"DROP TABLE {run}")
            self.runs = [new]

    def drop(self) -> None:
        for run in self.runs:
            self.spark.sql(f"DROP TABLE {run}")
        self.runs = []


def suspects(units: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(h, n, mixed) of fingerprints with several places, after all of ``units`` (a stored table) went through an
    index; ``mixed``: there are different contents under it."""
    index = FingerprintIndex(units.sparkSession)
    met = []
    for b in range(batches):
        met.append(materialize(index.append(units.where(F.pmod("doc", F.lit(batches)) == b)), "met"))
        index.compact()
    index.drop()
    # the last batch that has a fingerprint knows all its places
    known = reduce(DataFrame.unionByName, met).groupBy("h").agg(F.max("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return materialize(known.select("h", "n", (F.col("low") < F.col("high")).alias("mixed")), "suspects")


def suspect_units(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, batches: int = BATCHES) -> DataFrame:
    """(doc, same, open) for each document with suspects: contents of units that stand elsewhere as a whole,
    and of units whose windows must be looked at one by one. A unit that stands elsewhere is looked at in one
    document only, and only if its fingerprint has other contents too."""
    units = materialize(document_fingerprints(documents, window, anchor), "fingerprints")
    found = materialize(spread_join(units.select("doc", "h", "u", "v"), suspects(units, batches), ["h"], "n"), "suspect-units")
    contents = found.groupBy("h", "u", "v").agg(F.count("*").alias("count"), F.min("doc").alias("first"))
    twice = materialize(contents.where("count > 1").withColumn("same", F.lit(True)), "contents")
    rows = spread_join(found, twice, ["h", "u", "v"], "count", "left")
    content = F.struct("u", "v")
    look = F.col("same").isNull() | (F.col("mixed") & (F.col("first") == F.col("doc")))
    return rows.groupBy("doc").agg(F.collect_set(F.when(F.col("same"), content)).alias("same"), F.collect_set(F.when(look, content)).alias("open"))


def repeated_windows(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, batches: int = BATCHES) -> DataFrame:
    """(doc, same, open, windows) for each document with repeats: contents of its units that stand elsewhere as a
    whole, of those looked at one by one, and the digests of the repeated windows in the latter."""
    units = materialize(suspect_units(documents, window, anchor, batches), "units")

    def verify(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = unpacker()
        for batch in groups:
            parts = []
            for doc, text, same, look in zip(*(batch.column(i) for i in range(4)), strict=True):
                own = Units(unpack(text.as_py()), window, anchor)
                sure = own.inside(_pairs(same))
                at = np.flatnonzero(own.inside(_pairs(look)))
                if len(at):
                    digests = own.digests(at, at)
                    kinds, first, n = np.unique(digests, axis=0, return_index=True, return_counts=True)
                    parts.append((doc.as_py(), len(kinds), *kinds.T.copy(), np.where(sure[at[first]], 2, n)))
            if parts:
                yield _rows(parts, ["doc", "u", "v", "n"])

    texts = documents.select(document_key().alias("doc"), packed("text").alias("text"))
    opened = texts.join(units.where(F.size("open") > 0), "doc").select("doc", "text", "same", "open")
    windows = materialize(opened.mapInArrow(verify, "doc long, u long, v long, n long"), "windows")
    counted = windows.groupBy("u", "v").agg(F.sum("n").alias("places"), F.count("*").alias("n"))
    twice = materialize(counted.where("places > 1").select("u", "v", "n"), "repeated")
    back = spread_join(windows.drop("n"), twice, ["u", "v"], "n").groupBy("doc").agg(F.collect_set(F.struct("u", "v")).alias("windows"))
    return units.join(back, "doc", "left")


def _pairs(scalar: pa.ListScalar) -> set[tuple[int, int]]:
    if not scalar.is_valid:
        return set()
    return set(zip(*(scalar.values.field(i).to_pylist() for i in (0, 1)), strict=True))


def covered(units: Units, same: set, look: set, windows: set) -> np.ndarray:
    """For each word of a text whether a repeated window covers it."""
    hit = np.zeros(len(units.starts) + 1, np.int64)
    if same or windows:
        again = units.inside(same)
        if windows:
            at = np.flatnonzero(units.inside(look) & ~again)
            again[at] = np.fromiter((tuple(d) in windows for d in units.digests(at, at).tolist()), bool, len(at))
        at = np.flatnonzero(again)
        hit[at] += 1  # starts are distinct, and so are ends
        hit[at + units.window] -= 1
    return np.cumsum(hit[:-1]) > 0


def kept_text(raw: bytes, same: set, look: set, windows: set, window: int = WINDOW) -> tuple[int, int, bytes]:
    """(words, removed words, kept words joined by one space)."""
    if not (same or windows):
        words = raw.split()
        return len(words), 0, b" ".join(words)
    units = Units(raw, window)
    gone = covered(units, same, look, windows)
    kept = zip(units.starts[~gone].tolist(), units.ends[~gone].tolist(), strict=True)
    return len(gone), int(gone.sum()), b" ".join([units.joined[a:b] for a, b in kept])


def _joined(documents: DataFrame, window: int, batches: int) -> tuple[DataFrame, list[str]]:
    """``documents`` with packed texts and their repeats, and the names of the columns of these."""
    key, *names = (fresh(documents, n) for n in ("doc", "same", "open", "windows"))
    found = repeated_windows(documents, window, batches=batches).toDF(key, *names)
    return documents.withColumn(key, document_key()).withColumn("text", packed("text")).join(found, key, "left"), names


def substring_dedup(documents: DataFrame, window: int = WINDOW, with_text: bool = False, batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per row of ``documents``, or with the kept text itself."""
    joined, names = _joined(documents.select("doc_id", "text"), window, batches)
    schema = T.StructType([documents.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    if with_text:
        schema.add("kept", T.StringType())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = unpacker()
        for batch in batches:
            columns: list[list] = [[] for _ in schema.names[1:]]
            for text, *sets in zip(*(batch.column(i) for i in (1, 2, 3, 4)), strict=True):
                words, removed, kept = kept_text(unpack(text.as_py()), *map(_pairs, sets), window)
                row = (words, removed, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None)
                for column, value in zip(columns, row, strict=False):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=False))], schema.names)

    return joined.select("doc_id", "text", *names).mapInArrow(cut, schema)


def remove_repeats(documents: DataFrame, window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """``documents`` with the repeated words taken out of the texts that have some (their kept words joined by
    one space); other texts, columns and the number of rows stay. Where there is n_chars it follows."""
    joined, names = _joined(documents, window, batches)
    left, changed = fresh(documents, "left"), fresh(documents, "changed")
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("changed", T.BooleanType())])

    @F.pandas_udf(kind)
    def kept(texts, same, look, single):
        import pandas as pd

        unpack, rows = unpacker(), []
        pairs = lambda x: set() if x is None else {(d["u"], d["v"]) for d in x}
        for t, *sets in zip(texts, same, look, single, strict=True):
            raw = unpack(t)
            _, removed, short = kept_text(raw, *map(pairs, sets), window) if sets[0] is not None else (0, 0, b"")
            rows.append((None if t is None else (short if removed else raw).decode("utf-8", "replace"), bool(removed)))
        return pd.DataFrame(rows, columns=["text", "changed"])

    out = joined.withColumn(left, kept("text", *names))
    out = out.withColumn(changed, F.col(f"{left}.changed")).withColumn("text", F.col(f"{left}.text"))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col(changed), F.length("text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*documents.columns)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


#: Every window of 35 words as its words themselves; for tables that a window function over all words can hold.
OP1_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
windows AS (SELECT row, pos, md5(array_to_string(list_slice(words, pos, pos + 34), ' ')) AS content
    FROM (SELECT row, words, unnest(range(1, len(words) - 33)) AS pos FROM texts WHERE len(words) >= 35)),
again AS (SELECT row, pos FROM (SELECT row, pos, count(*) OVER (PARTITION BY content) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT row, pos + step AS pos FROM again, range(35) AS r(step)),
single AS (SELECT row, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM texts),
kept AS (SELECT row, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM single ANTI JOIN gone USING (row, pos) GROUP BY row)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (row)"""
