import hashlib
import re
import uuid
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veriframe.llm import simhash, substrings

from . import data

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute_substrings(rows, window):
    split = [WORD.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def result(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("window", [35, 12])
def test_substrings_match_brute_force_on_edges(spark, window):
    rows = data.edge_texts()
    got = result(substrings.substring_dedup(data.documents(spark), window), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_substrings(rows, window)


def test_substrings_within_one_document_and_across_batches(spark):
    a = "a b c d e f g h i j k l m n o p q r s t u v w x y z 1 2 3 4 5 6 7 8 9"
    rows = [(1, a + " mid " + a), (2, "p " * 200), (3, " ".join(str(i) for i in range(300))), (4, "z z " + " ".join(str(i) for i in range(100, 200)))]
    got = result(substrings.substring_dedup(data.documents(spark, rows)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_substrings(rows, 35)


def test_substrings_of_nothing(spark):
    assert substrings.substring_dedup(data.empty(spark)).collect() == []
    assert substrings.remove_repeats(data.empty(spark)).collect() == []


def test_remove_repeats_keeps_rows_and_columns(spark):
    docs = data.documents(spark)
    out = substrings.remove_repeats(docs)
    assert out.columns == docs.columns
    got = result(out, "doc_id", "text", "windows", "n_chars")
    texts = {t for _, t, _, _ in got}
    assert sum(got.values()) == docs.count() and None in texts and "one two" in texts
    passage = data.edge_texts()[-3][1]
    assert not any(t and passage in t for t in texts)


def test_more_batches_than_runs_compact_and_agree(spark, monkeypatch):
    rows = data.edge_texts()
    compacted = []
    plain = substrings.FingerprintIndex.compact
    monkeypatch.setattr(substrings.FingerprintIndex, "compact", lambda self, force=False: (compacted.append(len(self.runs)), plain(self, force)))
    for batches in (1, 4, 7):
        compacted.clear()
        got = result(substrings.substring_dedup(data.documents(spark, rows), batches=batches), "doc_id", "n_words", "n_removed", "kept_sha256")
        assert got == brute_substrings(rows, 35)
        assert len(compacted) == batches and (batches == 1 or max(compacted) > substrings.MAX_RUNS)
    assert not spark.sql("SHOW TABLES LIKE 'fingerprints_*'").count()


def units(spark, *texts):
    return substrings.document_fingerprints(data.documents(spark, list(enumerate(texts))))


def test_index_is_reopened_by_name_and_meets_its_history(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(80)) for x in "vx")
    name = f"reopened_{uuid.uuid4().hex}"
    index = substrings.FingerprintIndex(spark, name)
    assert index.append(units(spark, a)).count() == 0
    again = substrings.FingerprintIndex(spark, name, max_runs=1)
    assert len(again.runs) == 1
    met = again.append(units(spark, a, b)).collect()
    assert met and all(r.n == 2 and r.low == r.high for r in met)
    again.compact()
    assert len(again.runs) == 1 and spark.table(again.runs[0]).groupBy("h").count().where("count > 1").count() == 0
    last = substrings.FingerprintIndex(spark, name)
    assert {r.h for r in met} < {r.h for r in last.append(units(spark, a, b)).collect()}
    last.drop()
    assert substrings.FingerprintIndex(spark, name).runs == []


def test_words_with_equal_polynomial_hashes_stay(spark):
    word = "".join("ab"[i.bit_count() % 2] for i in range(2048))  # Thue-Morse: its complement has the same hash modulo 2**64
    other = word.translate({97: "b", 98: "a"})
    rest = [f"r{i}" for i in range(34)]
    rows = [(1, " ".join([word, *rest])), (2, " ".join([other, *rest])), (3, " ".join([word] * 2 + [other] * 33)), (4, " ".join([other] * 2 + [word] * 33))]
    got = result(substrings.substring_dedup(data.documents(spark, rows)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_substrings(rows, 35) and all(r[2] == 0 for r in got)


def test_hot_passages_lines_and_null_ids(spark):
    rng = __import__("random").Random(2)
    line = data.words(rng, 12, 10_000)
    passage = data.words(rng, 60, 10_000)
    rows = [(None if i % 3 else i, f"{data.words(rng, 40, 9999)} {line} {data.words(rng, 40, 9999)} {passage if i % 2 else ''} {data.words(rng, 9, 9999)}") for i in range(150)]
    rows += [(None, rows[1][1]), (None, rows[1][1])]
    got = result(substrings.substring_dedup(data.documents(spark, rows)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_substrings(rows, 35)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60))
def test_equal_windows_have_equal_fingerprints(letters):
    own = substrings.Units(" ".join(letters).encode(), 9, 4)
    low = np.repeat(own.h, own.last - own.first + 1)
    windows = [tuple(letters[i : i + 9]) for i in range(len(letters) - 8)]
    assert len(low) == max(0, len(windows))
    by = {}
    for w, f in zip(windows, low.tolist(), strict=True):
        assert by.setdefault(w, f) == f


def brute_fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    ids = list(range(len(prints)))
    group = ids[:]
    for i in ids:
        for j in ids[:i]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return group


def test_simhash_matches_brute_force_on_edges(spark):
    rows = data.edge_texts()
    prints = [brute_fingerprint(t) for _, t in rows]
    group = brute_components(prints)
    smallest = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    want = Counter((rows[i][0], f"{prints[i]:016x}", smallest[group[i]]) for i in range(len(rows)))
    assert result(simhash.near_duplicates(data.documents(spark)), "doc_id", "fingerprint", "component_id") == want


def test_keep_one_leaves_one_row_of_each_component(spark):
    rows = data.edge_texts()
    out = simhash.keep_one(data.documents(spark))
    assert out.columns == data.documents(spark).columns
    kept = [r.doc_id for r in out.collect()]
    assert len(kept) == len(set(brute_components([brute_fingerprint(t) for _, t in rows])))
    assert 0 in kept and 1 not in kept and kept.count(5) == 1


def test_simhash_of_nothing(spark):
    assert simhash.near_duplicates(data.empty(spark)).collect() == []
    assert simhash.keep_one(data.empty(spark)).collect() == []


def test_gray_index_finds_all_and_prunes():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 30, 2)).astype(np.uint64)
    values = np.unique(np.concatenate([base, (base[:, None] ^ flips[..., 0]).ravel(), (base[:, None] ^ flips[..., 0] ^ flips[..., 1]).ravel(), rng.integers(0, 2**63, 20_000, dtype=np.uint64)]))
    values = values[np.argsort(simhash.gray_rank(values))]
    index = simhash.GrayIndex(values)
    q, at = index.search(values[::9], 2)
    want = {(i, j) for i, x in enumerate(values[::9]) for j in np.flatnonzero(np.bitwise_count(values ^ x) <= 2).tolist()}
    assert set(zip(q.tolist(), at.tolist(), strict=True)) == want
    assert index.visited < 0.1 * len(values) * len(values[::9])


@pytest.mark.parametrize("groups", [None, 5, 30])
def test_links_of_groups_have_all_components(spark, groups):
    rng = np.random.default_rng(8)
    center = 0x0123456789ABCDEF
    near = {center ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 20, (150, 2))}
    values = sorted(near | {int(x) for x in rng.integers(0, 2**62, 60)} | {0, 1, 7})
    df = spark.createDataFrame([(v,) for v in values] + [(-1,), (-2,), (-8,)], "fp long")
    values = [v % 2**64 for v in [*values, -1, -2, -8]]
    grouped = simhash.gray_groups(df, groups)
    assert grouped.select("grp").distinct().count() >= (groups or 1) / 2
    root = {r.v % 2**64: r.root % 2**64 for r in simhash.components(simhash.link_forest(df, groups=groups)).collect()}
    group = brute_components(values)
    classes = {}
    for v, g in zip(values, group, strict=True):
        classes.setdefault(g, set()).add(root.get(v, v))
    assert all(len(c) == 1 for c in classes.values()) and len(set().union(*classes.values())) == len(classes)


def test_gray_order_sorts_like_the_rank(spark):
    values = np.random.default_rng(1).integers(-(2**63), 2**63, 500)
    rows = spark.createDataFrame([(int(v),) for v in values], "fp long").orderBy(simhash.gray_order(F.col("fp"))).collect()
    assert [r.fp for r in rows] == values[np.argsort(simhash.gray_rank(values.view(np.uint64)))].tolist()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "u long, v long")
    got = {r.v: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500}
