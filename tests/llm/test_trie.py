import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from veriframe.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, words long, depth string"


def brute(sequences):
    """Of {conv: turns}: every node's row, straight from the definition."""
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    rows = []
    for key, convs in members.items():
        below = [k for k in members if k[: len(key)] == key]
        saved = sum((len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) for k in below if k)
        leaves = sum(not any(len(o) == len(k) + 1 and o[:-1] == k for o in members) for k in below)
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(sequences[c]) == len(key)))
        children = sum(len(k) == len(key) + 1 for k in below)
        rows.append((min(convs), len(key), min(members[key[:-1]]) if key else None, len(convs), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def rebuild(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def found(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def talk(rng, convs, longest=6, kinds=3):
    return {c: [(f"r{rng.randrange(2)}", " ".join("w" * (1 + rng.randrange(kinds)) for _ in range(rng.randrange(3)))) for _ in range(rng.randrange(longest))] for c in range(convs)}


def as_rows(own):
    return [(c, t, role, text, 1, "taken") for c, turns in own.items() for t, (role, text) in enumerate(turns)]


@pytest.mark.parametrize(("convs", "parts", "fan"), [(1, 1, 64), (40, 1, 64), (150, 7, 2), (150, 40, 3)])
def test_nodes_equal_the_definition(spark, convs, parts, fan):
    own = {c: t for c, t in talk(random.Random(convs + parts), convs).items() if t}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        whole = trie.conversations(spark.createDataFrame(as_rows(own), SCHEMA))
        assert found(trie.prefix_trie(whole, fan)) == brute(own)
        assert found(trie.prefix_trie(trie.rebuilt(whole), fan)) == brute(rebuild(own))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_many_equal_conversations_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 7)  # no effect on workers that import anew; blocks split the run anyway
    same = [("user", "hello there"), ("assistant", "hi")]
    own = {c: same if c % 3 else [*same, ("user", f"only {c}")] for c in range(1, 400)} | {400: same[:1], 401: [("user", "else")]}
    assert found(trie.prefix_trie(trie.conversations(spark.createDataFrame(as_rows(own), SCHEMA)), 2)) == brute(own)


def test_runs_join_like_one_run():
    """Cut anywhere, in any number of runs, the same nodes come out."""
    rng = random.Random(8)
    known = sorted((b"".join(hashlib.md5(repr(t).encode()).digest() for t in turns), c, [len(t[1].split()) for t in turns]) for c, turns in talk(rng, 60).items())

    def nodes(cuts):
        whole, closed = trie.Run(), []
        for a, b in zip([0, *cuts], [*cuts, len(known)], strict=True):
            run = trie.Run()
            for path, c, words in known[a:b]:
                run.add(c, path, words)
            if run.last is not None:
                closed += run.closed
                run.closed = []
                whole.join(run)
        whole.finish()
        return sorted(closed + whole.closed, key=str)

    want = nodes([])
    for _ in range(200):
        assert nodes(sorted(rng.randrange(len(known) + 1) for _ in range(rng.randrange(1, 9)))) == want


def test_edges(spark):
    rows = [
        (20, None, None, None, 1, "x"), (20, 1, "user", "a  b\tc", 1, "x"), (20, 1, "assistant", "a", 1, "x"), (20, 1, "assistant", "a", 1, "x"), (21, 5, "user", "one", 1, "x"), (22, 0, "user", "x " * 50_000, 1, "x"),
        (None, 0, "user", "nobody", 1, "x"), (-5, 0, "user", "less than none", 1, "x"), (41, 0, "user", None, 1, "x"), (43, 2, "", "", 1, "x"), (44, 1, None, None, 1, "x"),
    ]
    own = defaultdict(list)
    for c, turn, role, text in sorted((r[:4] for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own[c].append((role or "", text or ""))
    c = {k: zlib.crc32(str(k).encode()) % 4 for k in own}
    rebuilt = {k: own.get(k - (k % 20 if k > 0 else -(-k % 20)), [])[: c[k]] + t[c[k] :] for k, t in own.items()}
    assert found(trie.prefix_trie(trie.rebuilt(trie.conversations(spark.createDataFrame(rows, SCHEMA))))) == brute(rebuilt)
    assert trie.prefix_trie(trie.conversations(spark.createDataFrame([], SCHEMA))).collect() == []


def test_query_and_statement(spark, tmp_path):
    own = talk(random.Random(4), 90, 7, 2)
    spark.createDataFrame(as_rows(own), SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    got = found(trie.op11_conversation_trie(spark, str(tmp_path)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(trie.OP11_SQL)
    assert want.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert got == sorted(want.fetchall(), key=str) == brute(rebuild({c: t for c, t in own.items() if t}))
