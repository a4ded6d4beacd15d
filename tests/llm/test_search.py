import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from veriframe.llm import ann, knn, shards

SCHEMA = "vec_id long, embedding array<float>, label int, score double, shard int"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, 0.0, 9) for i, v in vectors], SCHEMA)


def edge_vectors(n=400, dim=8):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=dim)]) for i in range(n)]
    same = rows[3][1]
    rows += [(n + i, same) for i in range(60)]  # copies: ties
    rows += [(2000, None), (2001, [None] + [1.0] * (dim - 1)), (2002, [math.nan] * dim), (2003, [math.inf] + [0.0] * (dim - 1)), (2004, [0.0] * dim), (None, same), (2005, []), (2006, [1.0, 2.0]), (2007, [2.0, 1.0])]
    rows += [(7, rows[7][1]), (20, rows[20][1])]  # repeated rows, a candidate and a query
    return rows


def usable(vectors, zero):
    out = {}
    for i, v in vectors:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or (not zero and not any(v)):
            continue
        out[i] = min(out.get(i, v), v)
    return out


def brute_inner(vectors, every, k):
    rows = {i: [math.floor(64 * x) for x in v] for i, v in usable(vectors, True).items()}
    want = []
    for q in rows:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(rows[q], v, strict=True)), i) for i, v in rows.items() if i != q and len(v) == len(rows[q]))
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return Counter(want)


def test_exact_top_k_matches_brute_force_on_edges(spark):
    vectors = edge_vectors()
    e = table(spark, vectors)
    for k, shard_rows in ((20, 10_000), (20, 30), (3, 100)):
        got = Counter(tuple(r) for r in knn.exact_top_k(e, e.where("vec_id % 20 = 0"), k, shard_rows).collect())
        assert got == brute_inner(vectors, 20, k)


def test_exact_top_k_of_few_and_of_nothing(spark):
    e = table(spark, [(0, [1.0, 0.5]), (20, [0.5, -1.0]), (3, [0.25, 0.25])])
    got = Counter(tuple(r) for r in knn.exact_top_k(e, e.where("vec_id % 20 = 0")).collect())
    assert got == brute_inner([(0, [1.0, 0.5]), (20, [0.5, -1.0]), (3, [0.25, 0.25])], 20, 20)
    none = e.where(F.lit(False))
    assert knn.exact_top_k(none, none).collect() == []


def test_box_tree_prunes_and_keeps_large_values(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.05, (600, 3)) for c in (-4, 0, 4)])
    tree = knn.BoxTree(np.floor(64 * x), leaf_rows=64)
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(len(x)))
    q = np.floor(64 * x[-5:])
    kth = np.partition(q @ np.floor(64 * x).T, -20, axis=1)[:, -20]
    bounds = tree.leaf_bounds(q, kth)
    assert (bounds < kth[:, None]).mean() > 0.5


def test_scores_are_exact_whatever_the_size(spark):
    rng = np.random.default_rng(6)
    small = [(i, rng.normal(size=3).tolist()) for i in range(1, 40)]
    for size in (1e3, 1e7, 3e7, 1e8, 1e12):  # whole numbers in doubles, in 64 bits, beyond them
        rows = small + [(40 + i, (size * rng.normal(size=3)).tolist()) for i in range(30)]
        rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
        e = table(spark, rows)
        want = Counter({(q, r, v, min(max(s, -(2**63)), 2**63 - 1)): n for (q, r, v, s), n in brute_inner(rows, 20, 20).items()})
        got = Counter(tuple(r) for r in knn.exact_top_k(e, e.where("vec_id % 20 = 0"), 20, 20).collect())
        assert {(q, r, s) for q, r, _, s in got} == {(q, r, s) for q, r, _, s in want}
        assert got == want or any(abs(s) >= 2**63 - 1 for *_, s in want)  # scores beyond a long are ties
        assert size >= 3e7 or max(abs(s) for *_, s in want) < 2**63 - 1


def test_queries_go_only_to_shards_that_can_reach_their_bound(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [(i, (np.array([i % 2, i // 2 % 2, i // 4 % 2]) * 6 - 3 + rng.normal(0, 0.05, 3)).tolist()) for i in range(1600)]
    sent = []
    plain = shards.search_shards
    monkeypatch.setattr(shards, "search_shards", lambda r, q, m: (sent.append(q.count()), plain(r, q, m))[1])
    e = table(spark, rows)
    got = Counter(tuple(r) for r in knn.exact_top_k(e, e.where("vec_id % 20 = 0"), 20, 200).collect())
    assert got == brute_inner([(i, [float(np.float32(x)) for x in v]) for i, v in rows], 20, 20)
    assert sent[0] == 80 and sent[1] < 80  # of 7 other shards each


def test_the_whole_table_and_its_query(spark):
    folder = "/root/testdata/sf0.01"
    e = spark.read.parquet(f"{folder}/embeddings.parquet")
    vectors = [(r.vec_id, r.embedding) for r in e.collect()]
    assert Counter(tuple(r) for r in knn.op9_exact_top_k(spark, folder).select("query_id", "rank", "vec_id", "score").collect()) == brute_inner(vectors, 20, 20)
    want = brute_cosine(vectors, 50, 5)
    got = ann.op6_nearest_neighbours(spark, folder).collect()
    hits = sum(r.vec_id in {v for v, _ in want[r.query_id]} for r in got)
    assert hits >= 0.9 * sum(map(len, want.values())) and len(got) == sum(map(len, want.values()))


def test_few_rows_are_ranked_where_vectors_are_clustered():
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(40, 64))
    x = np.repeat(centers, 100, 0) + rng.normal(0, 0.15, (4000, 64))
    unit, ranked = ann.unit_vectors(x), []
    search = ann.hash_index(5, ranked=ranked)(np.arange(4000), x)
    q, v, _ = search(np.arange(0, 4000, 50), x[::50], np.full(80, -np.inf))
    near = unit[::50] @ unit.T
    near[np.arange(80), np.arange(0, 4000, 50)] = -2
    want = [set(np.argsort(-near[i])[:5].tolist()) for i in range(80)]
    assert np.mean([j in want[i] for i, j in zip(q.tolist(), v.tolist(), strict=True)]) >= 0.9 and len(q) == 400
    assert sum(a for a, _ in ranked) < 0.3 * sum(b for _, b in ranked)


def test_queries_are_ranked_in_groups_and_as_if_alone(monkeypatch):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(2000, 24)), np.repeat(rng.normal(size=(20, 24)), 30, 0) + rng.normal(0, 0.1, (600, 24))])
    ids, at, calls = np.arange(len(x)) * 3, rng.permutation(len(x))[:300], []
    plain = ann.HashTables.chances
    monkeypatch.setattr(ann.HashTables, "chances", lambda *a: (calls.append(1), plain(*a))[1])
    search, bounds = ann.hash_index(5)(ids, x), np.where(np.arange(300) % 3, -np.inf, 0.3)
    together = Counter(zip(*(c.tolist() for c in search(ids[at], x[at], bounds)), strict=True))
    assert len(calls) <= 2 * -(-300 // 64)  # not twice for each query
    alone = Counter()
    for i in range(300):
        q, v, s = search(ids[at[i : i + 1]], x[at[i : i + 1]], bounds[i : i + 1])
        alone.update(zip((q + i).tolist(), v.tolist(), s.tolist(), strict=True))
    assert together == alone and all(v != ids[at[q]] for q, v, _ in together)
    assert all(bounds[q] <= s for q, _, s in together) and max(Counter(q for q, *_ in together).values()) == 5


def test_a_query_far_from_every_bucket_and_a_near_bound():
    rng = np.random.default_rng(8)
    x = np.ones((50, 16)) + rng.normal(0, 0.001, (50, 16))
    queries = rng.normal(size=(20, 16))
    with np.errstate(invalid="raise"):  # no bucket's chance is lost to underflow
        q, _, _ = ann.hash_index(5)(np.arange(50), x)(np.arange(100, 120), queries, np.full(20, 1 - 1e-13))
    assert not len(q)


def test_multiples_of_a_vector_are_ties_by_id():
    x = np.arange(1, 301)[:, None] * np.array([3.0, 4.0, 0.0])  # other vectors, the same cosine
    ids = np.arange(300)[::-1].copy()
    order = np.argsort(ids)
    q, v, s = ann.hash_index(5)(ids[order], x[order])(np.array([0, 2]), x[order][[0, 2]], np.full(2, -np.inf))
    assert v.tolist() == [1, 2, 3, 4, 5, 0, 1, 3, 4, 5] and set(s.tolist()) == {1.0} and q.tolist() == [0] * 5 + [1] * 5


def brute_cosine(vectors, every, k):
    rows = usable(vectors, False)
    want = {}
    for q in rows:
        if q % every == 0:
            a = np.array(rows[q])
            scores = sorted((-float(a @ np.array(v) / (np.linalg.norm(a) * np.linalg.norm(v))), i) for i, v in rows.items() if i != q and len(v) == len(a))
            want[q] = [(i, -s) for s, i in scores[:k]]
    return want


def test_nearest_recall_scores_and_ties(spark):
    vectors = edge_vectors(1500, 16)
    e = table(spark, vectors)
    got = {}
    for r in ann.nearest(e, e.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute_cosine(vectors, 50, 5)
    assert set(got) == set(want)
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    units = usable(vectors, False)
    for q, rows in got.items():
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, len(rows) + 1))
        assert all(s > t or (s == t and v < w) for (_, v, s), (_, w, t) in zip(rows, rows[1:], strict=False))
        for _, v, s in rows:
            a, b = np.array(units[q]), np.array(units[v])
            assert abs(s - a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) < 1e-12


def test_nearest_of_copies_few_and_nothing(spark):
    e = table(spark, [(i, [1.0, 2.0, 3.0]) for i in range(0, 120)])
    rows = ann.nearest(e, e.where("vec_id % 50 = 0")).collect()
    assert sorted(r.vec_id for r in rows if r.query_id == 0) == [1, 2, 3, 4, 5]
    assert sorted(r.vec_id for r in rows if r.query_id == 100) == [0, 1, 2, 3, 4]
    two = table(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (50, [0.0, 0.0])])
    assert [(r.query_id, r.vec_id, r.score) for r in ann.nearest(two, two.where("vec_id % 50 = 0")).collect()] == [(0, 1, 0.0)]
    none = e.where(F.lit(False))
    assert ann.nearest(none, none).collect() == []
