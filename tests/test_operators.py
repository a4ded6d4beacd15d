import datetime
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from veriframe.functions import text
from veriframe.operators import advisory, duplicates, history, matching, similarity, summaries, trees, work_queue
from veriframe.sources import archives
from veriframe.streaming import ledger


def brute_plan(edges):
    """Greedy assignment in order of rank after equal ranks have been set aside."""
    key = lambda e: e[2:]
    bad_s, bad_t = set(), set()
    for i, a in enumerate(edges):
        for b in edges[:i]:
            if key(a) == key(b) and (a[0] == b[0] or a[1] == b[1]):
                bad_s |= {a[0], b[0]}
                bad_t |= {a[1], b[1]}
    plan, s, t = set(), set(), set()
    for e in sorted(edges, key=lambda e: (not e[2], not e[3], -e[4], -e[5], e[0], e[1])):
        if e[0] in bad_s or e[1] in bad_t or e[0] in s or e[1] in t:
            continue
        s.add(e[0]), t.add(e[1]), plan.add(e[:2])
    return plan


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_match_plan_is_the_greedy_assignment(spark, seed):
    rng = random.Random(seed)
    edges = [(s, t, rng.random() < 0.2, rng.random() < 0.6, round(0.78 + rng.random() / 5, 3), round(rng.random(), 3)) for s in range(14) for t in range(14) if rng.random() < 0.4]
    edges += [(90, 91, True, True, 0.9, 0.5), (90, 92, True, True, 0.9, 0.5), (93, 91, False, True, 0.8, 0.1), (94, 95, False, False, 0.8, -1.0)]
    df = spark.createDataFrame(edges, "source_id int, target_id int, exact_title boolean, compatible boolean, score_9 double, path_9 double")
    assert {(r.source_id, r.target_id) for r in matching.match_plan(df).collect()} == brute_plan(edges)
    assert matching.match_plan(df.where("false")).collect() == []


def test_match_plan_follows_a_long_chain(spark):
    chain = [(i // 2, (i + 1) // 2, False, True, 0.99 - i / 1000, -1.0) for i in range(50)]
    df = spark.createDataFrame(chain, "source_id int, target_id int, exact_title boolean, compatible boolean, score_9 double, path_9 double")
    assert {(r.source_id, r.target_id) for r in matching.match_plan(df).collect()} == {(i, i) for i in range(25)}


def test_unique_binding(spark):
    s = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, " "), (5, None), (6, "z"), (7, "c")], "source_id int, k string")
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "c"), (5, None)], "target_id int, k string")
    got = {r.source_id: (r.status, r.target_id) for r in matching.unique_binding(s, t, "k").collect()}
    assert got == {1: ("BOUND", 1), 2: ("AMBIGUOUS", None), 3: ("AMBIGUOUS", None), 4: ("NO_KEY", None), 5: ("NO_KEY", None), 6: ("NO_TARGET", None), 7: ("AMBIGUOUS", None)}


def test_duplicates_conflicts_and_blank_values(spark):
    rows = [
        (1, "P", "Course (2).zip", 1, None, "ann", None), (2, "p", "course.zip", 5, 9, " ", "open"), (3, "P", "COURSE (1) (2).imscc", 0, 3, "Ann", "open"),
        (4, "P", "Other.zip", 1, 1, "x", "a"), (5, "P", "other (1).zip", 2, 2, "y", "a"), (6, None, "course.zip", 1, 1, "z", "a"), (7, "P", "", 1, 1, "z", "a"), (8, "Q", "single.zip", 1, 1, "z", "a"),
    ]
    df = spark.createDataFrame(rows, "id int, partner string, file_name string, updated_at int, scanned_at int, owner string, status string")
    plan = {r.semantic_key: r for r in duplicates.duplicate_plan(df, ["owner", "status"]).collect()}
    assert set(plan) == {"course", "other"}
    assert (plan["course"].survivor, plan["course"].latest_scan, plan["course"].conflicts, plan["course"].safe_to_merge) == (2, 2, "", True)
    assert (plan["other"].conflicts, plan["other"].safe_to_merge) == ("owner", False)
    merged = duplicates.merged_survivors(df, ["owner", "status"]).collect()
    assert [(r.survivor, r.owner, r.status, r.archived) for r in merged] == [(2, "Ann", "open", 2)]


def test_snapshot_diff_does_not_take_unseen_for_changed(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "x", 1), (3, "x", None)], "k int, s string, n int")
    b = spark.createDataFrame([(1, "y", None), (3, "x", 5), (4, "q", 1)], "k int, s string, n int")
    got = {r.k: (r.kind, r.fields) for r in history.snapshot_diff(a, b, "k", ["s", "n"]).collect()}
    assert got == {1: ("CHANGED", "s"), 2: ("BEFORE_ONLY", None), 3: ("STABLE", ""), 4: ("AFTER_ONLY", None)}


def test_interval_union_of_nested_touching_and_apart(spark):
    spans = [("a", 0, 10), ("a", 2, 5), ("a", 10, 12), ("a", 20, 21), ("b", 5, 5), ("a", 0, 10)]
    got = {r.k: (r.calls, r.summed, r.covered, r.slowest) for r in history.interval_union(spark.createDataFrame(spans, "k string, start long, stop long"), "k").collect()}
    assert got == {"a": (5, 26, 13, 10), "b": (1, 0, 0, 0)}


def test_ledger_islands_budget_chunks_freshness(spark):
    e = spark.createDataFrame([("i", 1, "stage", "s1", "f"), ("i", 3, "decision", "yes", "old"), ("i", 2, "decision", "no", "f"), ("j", 1, "note", "x", "old")], "item_id string, sequence int, kind string, value string, fingerprint string")
    now = spark.createDataFrame([("i", "f"), ("j", "f"), ("k", "f")], "item_id string, fingerprint string")
    got = {r.item_id: (r.stage, r.decision, r.freshness) for r in history.ledger_state(e, now).collect()}
    assert got == {"i": ("s1", "no", "current"), "j": ("inventory", "open", "changed"), "k": ("inventory", "open", "current")}
    runs = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, "a"), (1, 4, None)], "g int, o int, v string")
    assert sorted((r.island, r.v, r.first, r.last) for r in history.islands(runs, ["g"], ["o"], "v").collect()) == [(1, None, 1, 2), (2, "a", 3, 3), (3, None, 4, 4)]
    costs = spark.createDataFrame([(1, 1, 6), (1, 2, 5), (1, 3, 4)], "g int, o int, c int")
    assert [r.kept for r in history.within_budget(costs, ["g"], ["o"], "c", 10).orderBy("o").collect()] == [True, False, False]
    chunks = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 2), ("c", 0), ("c", 0), ("d", 1)], "k string, i int")
    assert {r.k: r.state for r in history.chunk_contiguity(chunks, "k", "i").collect()} == {"a": "COMPLETE", "b": "NOT_CONTIGUOUS", "c": "DUPLICATE_INDEX", "d": "NOT_CONTIGUOUS"}
    edits = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5), ("d", 5)], "k string, edited_at int")
    reports = spark.createDataFrame([("a", 3, "h1"), ("a", 7, "h2"), ("b", 3, "h1"), ("b", 7, "h1"), ("c", None, "h2")], "k string, captured_at int, input_hash string")
    assert {r.k: r.state for r in history.freshness(edits, reports, "k").collect()} == {"a": "CURRENT", "b": "PENDING", "c": "PENDING", "d": "PENDING"}


def test_trees_inherit_and_stop_at_cycles(spark):
    nodes = spark.createDataFrame([("r", None, "Root"), ("a", "r", "Archive"), ("b", "a", "Leaf"), ("x", "y", "Lost"), ("y", "x", "Lost")], "node_id string, parent_id string, title string")
    got = {r.node_id: (r.depth, r.administrative, r.path) for r in trees.paths(nodes).collect()}
    assert got == {"r": (0, False, "Root"), "a": (1, True, "Root > Archive"), "b": (2, True, "Root > Archive > Leaf")}
    deep = spark.createDataFrame([(str(i), str(i - 1) if i else None, "n") for i in range(1000)], "node_id string, parent_id string, title string")
    assert trees.paths(deep).agg(F.max("depth"), F.count("*")).first()[:] == (999, 1000)
    twice = nodes.unionByName(nodes)
    assert trees.paths(twice).count() == 3
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "src int, dst int")
    assert trees.closure(chain).where("root = 0").agg(F.max("depth"), F.count("*")).first()[:] == (300, 301)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src int, dst int")
    layers = spark.createDataFrame([(3 * k + a, 3 * k + 3 + b) for k in range(30) for a in range(3) for b in range(3)], "src int, dst int")
    assert trees.closure(layers).where("root = 0").agg(F.max("depth"), F.count("*")).first()[:] == (30, 91)
    assert {(r.root, r.node, r.depth) for r in trees.closure(edges).where("root = 1").collect()} == {(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3)}


def test_summaries(spark):
    zero = {k: 0 for k in ("webcontent", "assessments", "discussions", "weblinks", "lti", "unknown", "empty")}
    rows = [zero, zero | {"weblinks": 3}, zero | {"webcontent": 4, "lti": 2, "empty": 1, "discussions": 1}]
    df = spark.createDataFrame(rows, ", ".join(f"{k} int" for k in zero))
    assert [(r.ifs, r.is_boilerplate, r.ifs_per_item) for r in summaries.workload_index(df).collect()] == [(100.0, False, 100.0), (100.0, True, 33.33), (28.5, False, 4.07)]
    res = spark.createDataFrame([("a", "VERIFIED", 5.0, 5.0, 1.0), ("a", "UNVERIFIED", None, None, None), ("b", "MISSING", None, None, 0.0)], "g string, verdict string, earned double, possible double, coverage double")
    got = {r.g: (r.fidelity, r.coverage, r.headline) for r in summaries.fidelity_summary(res, "g").collect()}
    assert got == {"a": (100.0, 1.0, "REVIEW"), "b": (None, 0.0, "BLOCKED")}
    cells = spark.createDataFrame([("45000",), ("2024-02-30",), ("2024-02-29",), ("n/a",), ("7.5",), (None,)], "c string")
    out = cells.select(summaries.excel_date(F.col("c")), summaries.minutes(F.col("c")), summaries.count_text(F.col("c"))).collect()
    day = datetime.date
    assert [tuple(r) for r in out] == [(day(2023, 3, 15), 45000.0, 45000), (None, None, 1), (day(2024, 2, 29), None, 1), (None, None, 0), (day(1900, 1, 6), 7.5, 7), (None, None, 0)]
    text = spark.createDataFrame([(0.4,), (90.0,), (120.0,), (None,)], "m double").select(summaries.minutes_text(F.col("m"))).collect()
    assert [r[0] for r in text] == ["0 min", "1 h 30 min", "2 h", "not observed"]


def test_work_queue_resolution(spark):
    slots = spark.createDataFrame([(1, "k1", "o"), (2, "k2", "o"), (3, "k2", "p"), (4, "k3", "q"), (5, "k4", "o"), (6, "k5", "o")], "slot_id int, key string, owner string")
    catalog = spark.createDataFrame([("k1", 10, "z", False), ("k2", 20, "o", False), ("k2", 21, "p", False), ("k2", 22, "p", True), ("k3", 30, "x", False), ("k3", 31, "y", False), ("k5", 50, "o", False), ("k5", 51, "o", True)], "key string, catalog_id int, owner string, complete boolean")
    got = {r.slot_id: (r.catalog_status, r.catalog_id) for r in work_queue.resolved_candidates(slots, catalog).collect()}
    assert got == {1: ("ONE", 10), 2: ("OWNER", 20), 3: ("COMPLETE", 22), 4: ("AMBIGUOUS", None), 5: ("NONE", None), 6: ("COMPLETE", 51)}


def test_advisory_needs_data_and_learns(spark):
    rng = random.Random(0)
    rows = [(f"g{i % 8}", i, int(i % 2), i % 2 + rng.gauss(0, 0.3), rng.random()) for i in range(160)]
    df = spark.createDataFrame(rows, "group string, id int, label int, a double, b double")
    model = advisory.train(df, ["a", "b"])
    assert len(model.held_out_groups) == 2 and model.training_rows == 120
    facts = advisory.evaluation(df, model, ["a", "b"]).first()
    assert facts.true_positive + facts.true_negative >= 36 and facts.brier < 0.2
    assert advisory.train(df.limit(20), ["a", "b"]) is None


def make_zip(path, entries):
    with zipfile.ZipFile(path, "w") as z:
        for name, content in entries.items():
            z.writestr(name, content)


MANIFEST = """<manifest xmlns="x"><organizations><organization><item identifier="m1"><title>Unit & one</title><item identifier="i1" identifierref="R1"><title>Read</title></item></item></organization></organizations>
<resources><resource identifier="R1" type="webcontent" href="a.html"><file href="a.html"/><file href="lost/b.pdf"/><dependency identifierref="R2"/></resource><resource identifier="R2" type="lti"><file href="gone.xml"/></resource>
<resource identifier="R3" type="webcontent"/></resources></manifest>"""


def test_packages(spark, tmp_path):
    make_zip(tmp_path / "one.zip", {"imsmanifest.xml": MANIFEST, "a.html": "<p>x</p>", "media/b.pdf": b"%PDF", "../evil.txt": "x"})
    (tmp_path / "bad.zip").write_bytes(b"not a zip")
    entries = archives.archive_entries(spark, str(tmp_path)).cache()
    problems = {(r.name, r.problem) for r in entries.where("problem is not null").collect()}
    assert problems == {("../evil.txt", "UNSAFE_PATH"), (None, "BAD_ARCHIVE: BadZipFile")}
    manifest = archives.manifest_rows(entries).cache()
    assert {r.mode for r in manifest.collect()} == {"repaired"}
    items = {(r.node_id, r.parent_id, r.title, r.resource) for r in manifest.where("kind = 'ITEM'").collect()}
    assert items == {("m1", None, "Unit & one", None), ("i1", "m1", "Read", "R1")}
    assert [r.node_id for r in archives.orphans(manifest).collect()] == ["R3"]
    assert {(r.name, r.elsewhere) for r in archives.missing_files(manifest, entries).collect()} == {("lost/b.pdf", True), ("gone.xml", False)}


def test_workbooks(spark, tmp_path):
    ns = 'xmlns="http://s" xmlns:r="http://r"'
    sheet = f"""<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Owner</t></is></c><c r="C1" t="s"><v>0</v></c><c r="AA1" t="inlineStr"><is><t>Count</t></is></c></row>
    <row r="2"><c r="A2"><v>1.5</v></c><c r="B2" t="b"><v>1</v></c><c r="AA2"><f>A2</f></c></row><row r="3"><c r="B3" t="inlineStr"><is><t>ann</t></is></c></row></sheetData></worksheet>"""
    buffer = io.BytesIO()
    make_zip(buffer, {
        "xl/workbook.xml": f'<workbook {ns}><sheets><sheet name="S1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {ns}><si><t>Title</t></si></sst>", "xl/worksheets/sheet1.xml": sheet,
    })
    (tmp_path / "book.xlsx").write_bytes(buffer.getvalue())
    cells = archives.workbook_cells(spark, str(tmp_path)).cache()
    assert {(r.row, r.col, r.value) for r in cells.collect()} == {(0, 0, "Title"), (0, 1, "Owner"), (0, 2, "Title"), (0, 26, "Count"), (1, 0, "1.5"), (1, 1, "TRUE"), (1, 26, None), (2, 1, "ann")}
    rows = archives.table_of(cells, {"owner": ("assignment owner",), "title": (), "count": ()}).orderBy("row").collect()
    assert [(r.owner, r.title, r.count if isinstance(r["count"], str) else None) for r in rows] == [("TRUE", None, None), ("ann", None, None)]


def test_streams(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    rows = [(i, i % 3, f"v{i}", base + datetime.timedelta(minutes=i)) for i in range(50)] + [(49, 1, "v49", base + datetime.timedelta(minutes=49))]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp").repartition(3).write.parquet(str(tmp_path / "e.parquet"))
    stream = ledger.read_stream(spark, str(tmp_path / "e.parquet"), 1)
    once = ledger.run_available(ledger.once_each(stream, "event_id", "ts"))
    assert once.count() == 50
    latest = ledger.run_available(ledger.latest_values(stream, "user_id", "event_id", "event_type"), "update")
    final = {r.user_id: r.event_type for r in latest.groupBy("user_id").agg(F.max_by("event_type", "batch").alias("event_type")).collect()}
    assert final == {0: "v48", 1: "v49", 2: "v47"}
    same = {r.user_id: r.event_type for r in ledger.latest_values(spark.read.parquet(str(tmp_path / "e.parquet")), "user_id", "event_id", "event_type").collect()}
    assert final == same


def test_asset_and_link_evidence(spark):
    sha = "ab" * 32
    other = "cd" * 32
    src = spark.createDataFrame([(1, "Rail Plan.pdf", 100, sha), (1, "Only Here.docx", 5, None), (1, "rubric.pdf", 9, None), (2, "Guide Rail.pdf", 7, sha), (2, "gone map.pdf", 1, None), (3, "lost notes.pdf", 1, None)], "id int, name string, size int, sha256 string")
    tgt = spark.createDataFrame([(11, "rail-plan.pdf", 100, sha), (11, "rubric.PDF", 9, other), (13, "only_here.docx", 6, None), (13, "x.pdf", 77, sha)], "id int, name string, size int, sha256 string")
    pairs = spark.createDataFrame([(1, 11, 0.9, 0.9), (2, 12, 0.9, None), (3, 13, None, None)], "source_id int, target_id int, asset_confidence double, link_confidence double")
    from veriframe.operators import comparison

    got = {(r.source_id, r.name): (r.state, r.method, r.carrier) for r in comparison.asset_evidence(pairs, src, tgt).collect()}
    assert got[1, "Rail Plan.pdf"] == ("PRESENT", "SHA256_EXACT", None)
    assert got[1, "Only Here.docx"][0] == "RELOCATED" and got[1, "Only Here.docx"][2] == 13
    assert got[1, "rubric.pdf"][:2] == ("PRESENT", "NAME_SIZE_EXACT")
    assert got[2, "Guide Rail.pdf"] == ("RELOCATED", None, 11) and got[2, "gone map.pdf"][0] == "MISSING"
    assert got[3, "lost notes.pdf"][0] == "UNRESOLVED"
    links = lambda rows: spark.createDataFrame(rows, "id int, link string")
    out = comparison.link_evidence(pairs, links([(1, "a"), (1, "b"), (1, "c"), (2, "c")]), links([(11, "a"), (13, "b")]))
    assert {(r.source_id, r.link): r.state for r in out.collect()} == {(1, "a"): "PRESENT", (1, "b"): "RELOCATED", (1, "c"): "MISSING", (2, "c"): "UNRESOLVED"}


def test_item_fidelity_takes_nothing_for_what_was_not_observed(spark):
    from veriframe.operators import comparison

    zero = {f"{k}_{s}": 0 for k in ("asset", "link") for s in ("expected", "present", "relocated", "missing", "unresolved")}
    rows = [
        {"source_id": 1, "compatible": True, "path_score": None, "content": None, "published": None} | zero,
        {"source_id": 2, "compatible": True, "path_score": 1.0, "content": "VERIFIED", "published": True} | zero | {"asset_expected": 2, "asset_present": 2},
        {"source_id": 3, "compatible": True, "path_score": 0.5, "content": "VERIFIED", "published": True} | zero | {"asset_expected": 2, "asset_present": 1, "asset_unresolved": 1},
        {"source_id": 4, "compatible": False, "path_score": 1.0, "content": "VERIFIED", "published": False} | zero,
    ]
    schema = "source_id int, compatible boolean, path_score double, content string, published boolean, " + ", ".join(f"{k} long" for k in zero)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    got = {r.source_id: (r.fidelity, r.coverage, r.issues, r.verdict) for r in comparison.item_fidelity(df).collect()}
    assert got == {1: (100, 45, "PAYLOAD_UNVERIFIED", "UNVERIFIED"), 2: (100, 90, "", "VERIFIED"), 3: (94, 80, "MOVED_ITEM,PAYLOAD_UNVERIFIED", "MOVED"), 4: (71, 70, "TYPE_MUTATION,UNPUBLISHED", "TYPE_MUTATION")}
    raw = {r.source_id: r.verdict for r in comparison.item_fidelity(df, raw_snapshot=True).collect()}
    assert raw[4] == "TYPE_MUTATION" and raw[2] == "VERIFIED"


QTI = """<questestinterop><assessment><section><item ident="q1"><presentation><material><mattext>Pick &amp; choose</mattext></material><response_lid ident="r" rcardinality="Single"><render_choice>
<response_label ident="a"><material><mattext>One</mattext></material></response_label><response_label ident="b"><material><mattext>Two</mattext></material></response_label></render_choice></response_lid></presentation>
<resprocessing><respcondition><conditionvar><varequal>a</varequal><not><varequal>b</varequal></not></conditionvar></respcondition></resprocessing></item>
<item ident="q2"><presentation><material><mattext>Say why</mattext></material></presentation></item>
<item ident="q3"><presentation><response_lid rcardinality="Multiple"><render_choice><response_label ident="x"/></render_choice></response_lid></presentation></item></section></assessment></questestinterop>"""


def test_question_banks(spark):
    from veriframe.sources import assessments

    df = spark.createDataFrame([(1, QTI), (2, None), (3, "<broken"), (4, "")], "id int, text string")
    got = {r.question_id: (r.prompt, r.kind, [(o.ident, o.text, o.correct) for o in r.options]) for r in assessments.qti_questions(df).collect()}
    assert got == {"q1": ("Pick & choose", "choice", [("a", "One", True), ("b", "Two", False)]), "q2": ("Say why", "text", []), "q3": ("", "multiple", [("x", "", None)])}
    bank = ["junk", "NewQuestion,MC", "QuestionText,What is it?", "Option,100,This", "Option,0,That, or so", "NewQuestion,TF", "Option,100,True", "NewQuestion,WR", "QuestionText,Why?"]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(bank)], "file string, place int, line string")
    rows = {r.question: (r.kind, r.prompt, [(o.text, o.weight) for o in r.options], r.right, r.gaps, r.state) for r in assessments.bank_questions(lines, ["file"]).collect()}
    assert rows == {
        1: ("MC", "What is it?", [("This", 100), ("That, or so", 0)], 1, "", "COMPLETE"), 2: ("TF", None, [("True", 100)], 1, "PROMPT,OPTIONS", "INCOMPLETE"), 3: ("WR", "Why?", [], 0, "OPTIONS", "INCOMPLETE"),
    }


def test_sinks_guard_formulas_and_workbooks_come_back(spark):
    from veriframe.sources import sinks

    rows = spark.createDataFrame([("a", 1, "=1", 'x,"y"\n'), ("a", 2, None, "-"), ("b", 3, "\t+z", "é\x01<&")], "k string, n int, s string, t string")
    assert [r.l for r in rows.select(sinks.csv_line([F.col("n"), F.col("s"), F.col("t")]).alias("l")).collect()] == ["1,'=1,\"x,\"\"y\"\"\n\"", "2,,'-", "3,'\t+z,é\x01<&"]
    cells = archives.cells_of(sinks.workbooks(rows, "k", ["n", "s", "t"]).unionByName(spark.createDataFrame([("bad", b"zip"), ("half", sinks.archive({"xl/workbook.xml": "<a"}))], "path string, content binary")))
    got = {(r.workbook, r.row, r.col): r.value for r in cells.where("problem is null").collect()}
    assert got[("a.xlsx", 0, 2)] == "t" and got[("a.xlsx", 1, 2)] == 'x,"y"\n' and ("a.xlsx", 2, 1) not in got and got[("b.xlsx", 1, 2)] == "é<&"
    assert {r.workbook: r.problem for r in cells.where("problem is not null").collect()} == {"bad": "BAD_WORKBOOK: BadZipFile", "half": "BAD_WORKBOOK: KeyError"}


def test_fields_options_and_answers_are_compared(spark):
    from veriframe.functions import questions as q

    pairs = [("12 cm", "12cm", 1.0), ("12 cm", "12 in", 0.0), ("\\frac{1}{2}", "\\(\\frac{1}{2}\\)", 1.0), ("Same, words", "same words!", 1.0), ("begins here", "Begins here, and goes on", 0.98), ("stands inside", "it stands inside this", 0.95), ("", "x", 0.0), (None, None, 0.0), ("abc def", "xyz", 0.0)]
    df = spark.createDataFrame(pairs, "a string, b string, want double")
    for r in df.select("*", q.field_similarity(F.col("a"), F.col("b")).alias("got")).collect():
        assert r.got == pytest.approx(r.want), r
    close = spark.createDataFrame([("the quick brown fox", "the quick red fox")], "a string, b string").select(q.field_similarity(F.col("a"), F.col("b"))).first()[0]
    grams = lambda t: [t[i : i + 3] for i in range(len(t) - 2)]
    from collections import Counter
    from math import sqrt

    x, y = Counter(grams("the quick brown fox")), Counter(grams("the quick red fox"))
    cosine = sum(n * y[g] for g, n in x.items()) / sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values()))
    assert close == pytest.approx(0.58 * 2 / 4 + 0.42 * cosine)
    option = "struct<label:string,description:string,text:string,correct:boolean>"
    sets = spark.createDataFrame([([("1 cm", None, None, True), ("2 cm", None, None, False)], [("2 cm", None, None, None), ("1 cm", None, "", None), (None, None, None, None), ("3 cm", None, None, None)])], f"a array<{option}>, b array<{option}>")
    left, right = q.normal_options(F.col("a")), q.normal_options(F.col("b"))
    assert sets.select(q.option_set_similarity(left, right)).first()[0] == pytest.approx(2 / 3)
    assert sets.select(q.option_set_similarity(F.filter(left, lambda o: F.lit(False)), right)).first()[0] is None


def test_gaps_gates_reviews_and_chains(spark):
    from veriframe.operators import evidence

    expected = spark.createDataFrame([("g", 1), ("g", 2), ("h", 3), ("h", 3)], "g string, k int")
    visited = spark.createDataFrame([(1,), (3,), (9,)], "k int")
    done = evidence.traversal(expected, visited, "k", "g")
    assert {r.g: (r.eligible, r.visited, r.complete) for r in done.collect()} == {"g": (2, 1, False), "h": (1, 1, True)}
    res = spark.createDataFrame([("g", 1, "MISSING"), ("h", 2, "MISSING"), ("x", 3, "MISSING"), ("g", 4, "MOVED")], "g string, i int, verdict string")
    assert {r.i: r.verdict for r in evidence.with_traversal_gap(res, done, "g").collect()} == {1: "UNVERIFIED", 2: "MISSING", 3: "UNVERIFIED", 4: "MOVED"}
    base = spark.createDataFrame([(1, "a", None), (2, None, None)], "k int, t string, n int")
    late = spark.createDataFrame([(1, "z", 5)], "k int, t string, n int")
    assert sorted((r.k, r.t, r.n, r.recovered) for r in evidence.recovered(base, late, "k", ["t", "n"]).collect()) == [(1, "a", 5, "n"), (2, None, None, "")]
    rev = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 2, "x"), ("b", 2, "y"), ("c", None, "x")], "k string, at int, d string")
    assert {r.k: r.d for r in evidence.merged_reviews(rev, ["k"], "at", "d").collect()} == {"a": "y", "b": "CONFLICT"}
    att = spark.createDataFrame([("a", 1, 1, None), ("a", 2, 2, 1), ("b", 3, 1, None), ("b", 4, 3, 3), ("c", 5, 1, 9)], "c string, id int, generation int, base int")
    assert {r.c: (r.generation, r.current, r.breaks) for r in evidence.attempt_chain(att, "c").collect()} == {"a": (2, 2, 0), "b": (3, 4, 1), "c": (1, 5, 0)}
    ev = spark.createDataFrame([("i", "low", None, 1), ("i", None, "b", 3), ("i", "mid", "a", 2)], "k string, x string, y string, p int")
    assert [(r.x, r.y, r.captures) for r in evidence.merged_evidence(ev, "k", ["x", "y"], "p").collect()] == [("mid", "b", 3)]
    q = lambda rows: spark.createDataFrame(rows, "id int, prompt string, options array<string>")
    got = evidence.question_identity(q([(1, "What?", ["A", "b"]), (2, "why", []), (3, "Why!", []), (4, "x", None)]), q([(10, "what", ["a", "B "]), (11, "what", ["b", "a"]), (12, "why", [])]))
    assert {r.id: (r.kind, r.target_id) for r in got.collect()} == {1: ("EXACT", 10), 2: ("AMBIGUOUS", None), 3: ("AMBIGUOUS", None), 4: ("NONE", None)}


def test_similar_names_lose_no_pair(spark):
    import random

    rng = random.Random(4)
    names = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(220)} | {"a", "xabcdefghiy", "zabcdefghiw"})
    df = spark.createDataFrame([(n,) for n in names], "name string")
    pairs = df.toDF("a").join(df.toDF("b")).where("a < b").select("a", "b", F.round(text.edit_similarity(F.col("a"), F.col("b")), 9).alias("score")).where("score >= 0.6")
    assert {tuple(r) for r in similarity.similar_names(df, 0.6).collect()} == {tuple(r) for r in pairs.collect()}


def test_a_chain_of_falling_rank_is_matched_to_its_end(spark):
    n = 60
    edges = [(f"s{i:03}", f"t{i:03}", 1 - 0.001 * (2 * i)) for i in range(n)] + [(f"s{i + 1:03}", f"t{i:03}", 1 - 0.001 * (2 * i + 1)) for i in range(n - 1)]
    df = spark.createDataFrame([(s, t, False, True, x, 0.0) for s, t, x in edges], "source_id string, target_id string, exact_title boolean, compatible boolean, score_9 double, path_9 double")
    assert {(r.source_id, r.target_id) for r in matching.match_plan(df).collect()} == {(f"s{i:03}", f"t{i:03}") for i in range(n)}


def test_a_fidelity_of_half_a_percent_goes_up(spark):
    from veriframe.operators import comparison

    counts = {"asset_expected": 6, "asset_present": 3, "asset_relocated": 2, "asset_missing": 0, "asset_unresolved": 1} | {f"link_{s}": 0 for s in ("expected", "present", "relocated", "missing", "unresolved")}
    schema = "source_id int, compatible boolean, path_score double, content string, published boolean, " + ", ".join(f"{k} long" for k in counts)
    got = comparison.item_fidelity(spark.createDataFrame([(1, True, None, None, False, *counts.values())], schema)).first()
    assert (got["earned"], got["possible"], got["fidelity"]) == (58.333333, 66.666667, 88)  # 87.5


def test_edges_of_blocks_are_those_of_their_pairs(spark, monkeypatch):
    from pyspark.sql import functions as F

    from veriframe.operators import matching

    names = ("Red lever", "Red levers", "red lever", "Blue gear", None)
    rows = [(i, names[i % 5], ("Quiz", "Assessment", None)[i % 3], ("root > A", "A > B", "")[i % 3], f"b{i % 2}", f"c{i % 4}") for i in range(40)]
    side = lambda name: spark.createDataFrame(rows, f"{name}_id int, name string, type string, path string, x string, y string")
    source, target, blocks = side("source"), side("target"), F.array("x", "y")
    want = matching.scored_edges(source, target, matching.candidate_pairs(source, target, blocks)).collect()
    scored, taken = [], matching._scored
    monkeypatch.setattr(matching, "_scored", lambda df, cutoff: scored.append(df.count()) or taken(df, cutoff))
    got = matching.blocked_edges(source, target, blocks).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 100
    assert scored[0] <= 15 * 15  # forms, not the pairs of rows
