import numpy as np
import pytest

from veriframe.llm import near, simhash

from . import data


def edited(rng, words, edits):
    out = list(words)
    for i in rng.choice(len(out), edits, replace=False):
        out[i] = f"edit{rng.integers(10**9)}"
    return out


def jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def copies(n=60):
    """Pairs of texts of 300 words, edited in 1 to 20 places."""
    rng = np.random.default_rng(4)
    out = []
    for k in range(n):
        a = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        b = edited(rng, a, 1 + k % 20)
        out.append((a, b, jaccard(a, b)))
    return out


def test_pipeline_links_all_copies_at_a_similarity_of_four_fifths(spark):
    import corpus_pipeline

    pairs = copies()
    rows = [(2 * i + j, " ".join(p[j]), "aa", "s", 1) for i, p in enumerate(pairs) for j in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, docs, "").collect()}
    assert {2 * i for i in range(len(pairs))} <= kept
    assert {i: 2 * i + 1 in kept for i in range(len(pairs))} == {i: s < 0.8 for i, (_, _, s) in enumerate(pairs)}
    old = {r.doc_id for r in simhash.keep_one(docs).collect()}  # the settings of operator 8
    assert any(s >= 0.8 and 2 * i + 1 in old for i, (_, _, s) in enumerate(pairs))


def test_candidates_below_the_similarity_stay(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(0, " ".join(words)), (1, " ".join(words[:70])), (2, " ".join(words[:86])), (3, " ".join(words).upper()), (4, None), (5, " "), (6, "a b"), (7, "A  b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near.keep_one(docs).collect()) == [0, 4, 6]  # 1 is linked to 2, 2 to 0
    assert sorted(r.doc_id for r in near.keep_one(docs.where("doc_id != 2")).collect()) == [0, 1, 4, 6]
    assert near.keep_one(data.empty(spark)).collect() == []


@pytest.mark.parametrize("group_sets", [4096, 5])
def test_large_groups_are_sliced_without_losing_links(spark, group_sets):
    rng = np.random.default_rng(9)
    chain = [[f"w{x}" for x in rng.integers(0, 5000, 200)]]
    for _ in range(40):  # each linked to the one before, the first and the last far apart
        chain.append(edited(rng, chain[-1], 2))
    alone = [f"v{x}" for x in rng.integers(0, 5000, 200)]
    rows = [(i, " ".join(w)) for i, w in enumerate([*chain, alone])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near.keep_one(docs, group_sets=group_sets).collect()) == [0, 41]


@pytest.mark.parametrize("seed", [0, 1])
def test_components_are_those_of_all_pairs(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, (4, 60), dtype=np.uint64)
    sets = [np.unique(np.append(rng.choice(base[i % 4], 60 - i % 9, replace=False), rng.integers(0, 2**63, i % 7, dtype=np.uint64))) for i in range(80)]
    root = list(range(80))
    for i in range(80):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    got = near.similar_components(sets)
    assert len(set(zip(got.tolist(), root, strict=True))) == len(set(root)) == len(set(got.tolist()))


def test_bands_meet_at_four_fifths():
    rng = np.random.default_rng(7)
    met = 0
    for _ in range(2000):
        x = rng.integers(0, 2**64, 100, dtype=np.uint64)
        a, b = x[:90], x[10:]  # 80 of 100
        met += bool((near.band_keys(a) == near.band_keys(b)).any())
    assert met == 2000
