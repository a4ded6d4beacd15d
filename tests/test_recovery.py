from veriframe.operators import recovery

EXPECTED = "course string, source_id string, kind string, key string, name string, sha256 string, reference_only boolean, present boolean"
CARRIED = "course string, item_id string, kind string, key string, name string, sha256 string"
LINK = "course string, source_id string, item_id string"


def test_payload_recovery(spark):
    asset = lambda s, key, sha=None, ref=None, there=None: ("c", s, "asset", key, key, sha, ref, there)
    expected = spark.createDataFrame(
        [asset("s1", "a.pdf", "H1"), asset("s1", "b.pdf"), ("c", "s1", "link", "x.org/1", "x", None, None, None), asset("s1", "ref.pdf", ref=True), asset("s1", "gone.pdf", there=False),
         asset("s2", "a.pdf", "H9"), asset("s3", "only-here.pdf"), asset("s4", "far.pdf"), asset("s5", "z.pdf")], EXPECTED
    )
    carried = spark.createDataFrame(
        [("c", "i1", "asset", "a.pdf", "a.pdf", "h1"), ("c", "i2", "asset", "a.pdf", "a.pdf", "h1"), ("c", "i3", "asset", "b.pdf", "b.pdf", None), ("c", "i1", "link", "x.org/1", "x", None), ("c", "m3", "asset", "only-here.pdf", "only-here.pdf", None),
         ("d", "i9", "asset", "far.pdf", "far.pdf", None), ("c", "i7", "asset", "ref.pdf", "ref.pdf", None)], CARRIED
    )
    matched = spark.createDataFrame([("c", "s1", "i1"), ("c", "s3", "m3")], LINK)
    inferred = spark.createDataFrame([("c", s, "guess") for s in ("s1", "s2", "s4", "s6")], LINK)
    got = {r["source_id"]: tuple(r)[2:] for r in recovery.payload_recovery(expected, carried, matched, inferred).collect()}
    assert got == {
        "s1": (3, 2, round(2 / 3, 9), 2, "i2", False, False, False),  # its matched item is not elsewhere: the link stays open
        "s2": (1, 0, 0.0, 0, None, True, False, False),  # another hash forbids the guess
        "s3": (1, 0, 0.0, 0, None, False, False, False),
        "s4": (1, 1, 1.0, 1, "guess", False, True, False),
        "s5": (1, 0, 0.0, 0, None, False, False, False),
        "s6": (1, 1, 1.0, 1, "guess", False, True, False),
    }


def test_texts_and_the_chain(spark):
    rows = [
        ("c", "a", "i1", True, True, 0.7, "VERIFIED", 0.90, 0.1), ("c", "a", "i0", True, True, 0.7, "VERIFIED", 0.90, 0.9), ("c", "a", "i2", False, True, 0.9, "VERIFIED", 0.99, 0.1), ("c", "b", "i1", True, True, 0.5, "VERIFIED", 0.99, 0.90),
        ("c", "d", "i1", True, True, None, None, None, 0.90), ("c", "d", "i2", True, True, None, None, None, 0.95), ("c", "e", "i1", True, False, 0.9, "DRIFT", 0.99, 0.99),
    ]
    pairs = spark.createDataFrame(rows, "course string, source_id string, item_id string, same_type boolean, reading boolean, path_score double, status string, score double, coverage double")
    texts = recovery.repackaged_texts(pairs)
    assert {tuple(r)[1:] for r in texts.collect()} == {("a", "i0", 0.9, "TEXT"), ("b", "i1", 0.9, "ONLY_READING")}
    sources = spark.createDataFrame([("c", x) for x in "abdez"], "course string, source_id string")
    payload = spark.createDataFrame([("c", "b", 1, "p", True), ("c", "d", 2, "q", False), ("c", "e", 0, None, False)], "course string, source_id string, recovered long, first_carrier string, inferred boolean")
    chain = recovery.recovered_by(sources, payload, texts, spark.createDataFrame([("c", "e", "st"), ("c", "a", "st")], LINK))
    assert {tuple(r)[1:] for r in chain.collect()} == {("a", "i0", "TEXT"), ("b", "p", "TITLE"), ("d", "q", "PAYLOAD"), ("e", "st", "STRUCTURE"), ("z", None, "NONE")}
