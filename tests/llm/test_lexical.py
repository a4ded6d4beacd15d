import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veriframe.llm import lexical

from . import data

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(documents, items, k):
    docs = [(i, Counter(t), len(t)) for i, text in documents if (t := terms(text))]
    n, length = len(docs), sum(d[2] for d in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, size in docs:
            m = 100 - 25 + (25 * size * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("item", "rank", "doc_id", "score").collect()), key=str)


def corpus(rng, n):
    """Texts of words whose frequencies fall, with copies, so that scores tie."""
    word = lambda: f"w{int(200 * rng.random() ** 3)}"
    rows = [(i, " ".join(word() for _ in range(rng.randrange(1, 60)))) for i in range(n)]
    return rows + [(n + i, rows[i % 7][1]) for i in range(n // 2)]


def test_terms_are_the_pattern_s():
    for text in ("A-b_C9é Über\x00x\x7fy  日本語\xa0z", "", None, "___", "ÀÉ İI", "a" * 1000, "1,5 x@y.z"):
        assert [t.decode() for t in lexical.terms_of(text)] == terms(text)


@pytest.mark.parametrize(("k", "cells", "max_items", "max_terms"), [(20, 8_000_000, 1024, 8192), (3, 900, 2, 12), (7, 5000, 1024, 30)])
def test_equals_brute_force_with_ties(spark, k, cells, max_items, max_terms):
    rng = random.Random(k)
    rows = corpus(rng, 240) + [(None, "w1 w2 w3"), (None, None), (5000, ""), (5001, "w150 W150 w151")]
    items = [(i, text) for i, (_, text) in enumerate(corpus(rng, 12))] + [(90, "w150 w151 w151 unheard"), (91, "unheard"), (92, None), (93, "--"), (94, "w0")]
    got = found(lexical.ranked(data.documents(spark, rows).repartition(3), items, k, max_items, max_terms, cells))
    assert got == brute(rows, items, k)


def test_edges(spark):
    rows = data.edge_texts()
    items = [(1, "One two"), (2, "the"), (3, "naïve 日本語"), (4, rows[0][1])]
    assert found(lexical.ranked(data.documents(spark), items)) == brute(rows, items, 20)
    assert lexical.ranked(data.empty(spark), items).collect() == []
    assert lexical.ranked(data.documents(spark), []).collect() == []


def test_reading_stops_early():
    """A document that holds a rare phrase is found without a look at most others."""
    import numpy as np

    rng = np.random.default_rng(1)
    docs, vocabulary = 5000, 12
    rows, terms_ = np.repeat(np.arange(docs), vocabulary), np.tile(np.arange(vocabulary), docs)
    impacts = rng.integers(1, 1000, docs * vocabulary) ** 2
    impacts[rows < 25] = 1_000_000
    shard, best = lexical.Shard(rows, terms_, impacts, docs, vocabulary), lexical.Best(20)
    best.of = np.arange(docs), np.zeros(docs, bool)
    shard.search(np.arange(vocabulary), np.ones(vocabulary, np.int64), best)
    assert best.ids.tolist() == list(range(20)) and shard.lookups < docs / 2


def test_query(spark, tmp_path):
    rng = random.Random(2)
    rows = corpus(rng, 60)
    data.documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    items = [(3, "w1 w5"), (3, "w2 w9 w9"), (None, "w7"), (4, None)]
    spark.createDataFrame(items, "item_id int, text string").withColumn("doc_id", F.lit(1)).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((tuple(r) for r in lexical.op12_ranked_lexical_search(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rows, items, 20)
