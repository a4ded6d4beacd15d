from veriframe.operators import proofs


def test_comparison_set(spark):
    rows = [
        ("i", "A.pdf", "x\\A.pdf", "AB", 1, "PDF", None, None), ("i", "b.pdf", "x/b.pdf", "ab", 2, "pdf", False, True), ("i", "c.pdf", "X\\C.pdf", None, 3, "pdf", None, None), ("i", "other.pdf", "x/c.pdf", "", 3, "pdf", None, None),
        ("i", "d.pdf", None, None, None, "pdf", None, None), ("i", "D.PDF", "", None, 0, "pdf", None, None), ("i", "e.pdf", None, None, 5, "pdf", True, None), ("i", "f.pdf", None, None, 5, "pdf", None, False), ("i", "g.docx", None, None, 5, "docx", None, None),
    ]
    df = spark.createDataFrame(rows, "item_id string, name string, path string, sha256 string, size long, extension string, reference_only boolean, present boolean")
    got = sorted((r["key"].split(":")[0], r["copies"], r["ignored"]) for r in proofs.comparison_set(df).collect())
    assert got == [("name", 1, True), ("name", 1, True), ("name", 2, False), ("path", 2, False), ("sha", 2, False)]


def test_rubric_anchors(spark):
    text = "The essay states a clear thesis. Evidence is well-chosen, and the style is “plain”. Grades run from Excellent to Poor for every part of it."
    documents = spark.createDataFrame([("d", text), ("short", "a clear thesis"), ("none", None)], "doc_id string, text string")
    rubrics = spark.createDataFrame(
        [("t", "A clear thesis", ["Excellent", "poor", " "]), ("t", "Evidence is: well chosen", ["Excellent", "Superb"]), ("t", "Rubric 3", None), ("t", None, None), ("one", "clear thesis", []), ("part", "clear thesis", []), ("part", "no such thing", []), ("quoted", 'is "plain"', []), ("quoted", "thesis", [])],
        "target_id string, criterion string, labels array<string>",
    )
    pairs = spark.createDataFrame([("d", t) for t in ("t", "one", "part", "quoted")] + [("short", "t"), ("none", "t")], "doc_id string, target_id string")
    got = {(r["doc_id"], r["target_id"]): tuple(r)[2:] for r in proofs.rubric_anchors(pairs, documents, rubrics).collect()}
    assert got == {
        ("d", "t"): (2, 2, 3, 2, 0.94, True), ("d", "one"): (1, 1, 0, 0, 0.82, False), ("d", "part"): (2, 1, 0, 0, 0.41, False), ("d", "quoted"): (2, 2, 0, 0, 0.82, True),
        ("short", "t"): (2, 0, 3, 0, 0.0, False), ("none", "t"): (2, 0, 3, 0, 0.0, False),
    }
