"""Behaviour, readiness and captures: nulls, ties, repeated rows and empty tables."""

from pyspark.sql import functions as F

from veriframe.functions import behavior
from veriframe.operators import captures, readiness

SETTINGS = "struct<file_upload:boolean,text_submission:boolean,ai_graded:boolean,attempts:string,graded:boolean,passing:double,points:double,minutes:double,conflict:boolean>"
QUESTION = "struct<prompt:string,type:string,options:array<string>,answers:array<string>,keyed:boolean,feedback:string,feedback_captured:boolean,limitations:array<string>>"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_null_arguments_say_nothing(spark):
    null = F.lit(None).cast("string")
    names = F.lit(None).cast("array<string>")
    number = F.lit(None).cast("double")
    flag = F.lit(None).cast("boolean")
    row = one(
        spark, behavior.interactive_signals(null, names, null).alias("s"), behavior.runtime_review(flag, null, names, names).alias("r"), behavior.stated_behavior(null, null).alias("b"),
        behavior.quiz_behavior(null, number, flag, flag, number, number, flag).alias("q"), captures.declared_question_count(null).alias("n"), captures.asset_event(null).alias("e"),
        captures.generated_behavior(null).alias("g"), captures.is_concrete_asset(null, null, null, number, null).alias("c"), captures.item_minutes(number, null, null, null).alias("m"),
        readiness.proven_loss(names, F.lit(None).cast("struct<payload:double,text:double>"), number).alias("l"), readiness.interaction_key(null).alias("k"), captures.launch_key(null).alias("u"),
    )
    assert (row.s.detected, row.s.confidence, row.s.families) == (False, "LOW", [])
    assert (row.r.status, row.r.carrier) == ("NOT_APPLICABLE", False)
    assert (row.b.observed, row.q.observed, row.n, row.e, row.g, row.c, row.m.rule, row.l, row.k, row.u) == (False, False, None, "", False, False, "module-root", False, "", "")


def test_behavior_of_sides_that_were_not_seen(spark):
    none = F.lit(None).cast(SETTINGS)
    seen = F.from_json(F.lit('{"attempts": "007 tries", "graded": false}'), SETTINGS)
    same = F.from_json(F.lit('{"attempts": "7", "graded": false, "passing": 1}'), SETTINGS)
    got = one(
        spark, behavior.compare_behavior(F.lit("quiz"), none, seen).alias("a"), behavior.compare_behavior(F.lit(None).cast("string"), none, none).alias("b"), behavior.compare_behavior(F.lit("x"), seen, none).alias("c"),
        behavior.compare_behavior(F.lit("x"), seen, seen).alias("d"), behavior.compare_behavior(F.lit("x"), seen, same).alias("e"), behavior.compare_behavior(F.lit("x"), F.from_json(F.lit("{}"), SETTINGS), same).alias("f"),
    )
    assert [r.status for r in got] == ["UNVERIFIED", "NOT_APPLICABLE", "UNVERIFIED", "VERIFIED", "MUTATED", "UNVERIFIED"]
    assert got.e.issues == ["PASSING_THRESHOLD_ON_UNGRADED_SOURCE"]


def test_questions_with_nulls_are_not_verified(spark):
    none = F.lit(None).cast(QUESTION)
    full = F.from_json(F.lit('{"prompt": "a", "type": "essay", "options": ["x"], "answers": ["x"], "keyed": true, "feedback": "f", "feedback_captured": true}'), QUESTION)
    got = one(spark, captures.question_dimensions(none, none).alias("a"), captures.question_dimensions(full, full).alias("b"), captures.question_dimensions(full, none).alias("c"))
    assert {d.status for d in got.a.dimensions} == {d.status for d in got.c.dimensions} == {"UNVERIFIED"}
    assert [d.status for d in got.b.dimensions][:5] == ["VERIFIED"] * 5 and got.b.status == "UNVERIFIED"


def test_long_texts(spark):
    text = F.concat(F.repeat(F.lit("word "), 200_000), F.lit("14 multiple-choice questions"))
    assert one(spark, captures.declared_question_count(text).alias("n")).n == 14


def test_stage_of_courses_without_items(spark):
    courses = spark.createDataFrame([(1, None, None), (2, "LIVE", True)], "course int, requested string, report boolean")
    items = spark.createDataFrame([], "course int, published boolean")
    got = {r.course: (r.asked, r.stage, r.confidence, r.observed) for r in readiness.snapshot_stage(courses, items, "course").collect()}
    assert got == {1: ("auto", "OPS_PREPARED_UNPUBLISHED", 0.72, 0), 2: ("published", "PUBLISHED", 1.0, 0)}


def test_findings_meet_actions(spark):
    schema = "course int, code string, item string"
    findings = spark.createDataFrame([(1, "A", "x", "REVIEW", None), (1, "A", None, "CRITICAL", False), (1, "B", None, "REVIEW", None), (1, "B", "y", "INFO", None), (1, "C", "z", "CRITICAL", True), (None, "A", "x", "REVIEW", None)], schema + ", severity string, exempt boolean")
    actions = spark.createDataFrame([(1, "A", "w"), (1, "A", "w"), (1, "B", None)], schema)
    got = {tuple(r)[:3] for r in readiness.open_findings(findings, actions, "course").select("course", "code", "item").collect()}
    assert got == {(1, "A", "x"), (None, "A", "x")}
    assert readiness.open_findings(findings.limit(0), actions.limit(0), "course").count() == 0


def test_media_of_repeated_entries(spark):
    refs = spark.createDataFrame([("p", "a/q.xml", "../i/X.png#f"), ("p", "q.xml", None), ("p", "q.xml", "x.png"), ("p", "q.xml", "data:image"), (None, "q.xml", "x.png"), ("p", "q.xml", "..")], "package string, file string, ref string")
    entries = spark.createDataFrame([("p", "i/x.png"), ("p", "i/x.png"), ("p", None)], "package string, path string")
    got = sorted((r.ref or "", r.status, r.candidates) for r in readiness.media_presence(refs, entries).collect())
    assert got == [
        ("", "EXTERNAL_OR_EMBEDDED", 0), ("..", "EXTERNAL_OR_EMBEDDED", 0), ("../i/X.png#f", "PRESENT_AT_REFERENCE", 1), ("data:image", "EXTERNAL_OR_EMBEDDED", 0), ("x.png", "NOT_IN_PACKAGE", 0), ("x.png", "PRESENT_DIFFERENT_PATH", 1),
    ]


def test_first_of_equal_revisions(spark):
    member = "members array<struct<item:string,member:string,action:string>>"
    rows = spark.createDataFrame(
        [(1, "d", 2, 5, [("i", "late", "keep")]), (1, "d", 2, 4, [("i", "first", "omit"), ("i", "again", "keep")]), (1, "d", 1, 1, [("j", "old", "keep")]), (1, "e", 9, 1, None)], f"course int, deliverable string, revision int, position int, {member}"
    )
    assert [(r.item, r.member, r.state) for r in readiness.deliverable_members(rows, "course").collect()] == [("i", "first", "removed")]
    audits = spark.createDataFrame([("a", 1), ("b", None)], "id string, generation int")
    repairs = spark.createDataFrame([("a", 2, 1), ("a", 3, 2), ("a", None, 3), ("c", 9, 1)], "run_id string, to_generation int, position int")
    assert {tuple(r) for r in readiness.with_lineage_repairs(audits, repairs).select("id", "generation", "repaired").collect()} == {("a", 3, True), ("b", None, False)}


def test_texts_without_lines_and_other_precisions(spark):
    null = F.lit(None).cast("string")
    row = one(
        spark, captures.text_quality(null).alias("a"), captures.text_quality(F.lit("\u00a0\n[PAGE 1]")).alias("b"), captures.text_quality(F.lit("Loading…\r\n/ 3")).alias("c"), captures.text_quality(F.concat(F.lit("5%\n/ 9\n"), F.repeat(F.lit("x\n"), 200_000))).alias("d"),
        captures.decimal_places(null).alias("e"), captures.decimal_places(F.lit("0 decimal place")).alias("f"), captures.encoded_sha256(null).alias("g"), captures.topic_score(null, F.lit("t"), null, null, F.lit(True)).alias("h"),
    )
    assert [tuple(row[i]) for i in range(4)] == [(False, False, False), (False, False, False), (False, True, False), (True, False, True)]
    assert tuple(row)[4:] == (None, 0, None, 0.0)


def test_merged_questions_of_empty_and_repeated_rows(spark):
    schema = "a int, file string, ordinal int, id string, prompt string"
    base = spark.createDataFrame([(1, "f", 1, "q", "P"), (1, "f", 1, "q", "P"), (1, None, None, None, None)], schema)
    more = spark.createDataFrame([(1, "f", 1, "q", " p "), (1, "", None, "", ""), (1, "g", 1, "q", "P"), (1, "g", 1, "q", "p"), (2, "f", 1, "q", "P")], schema)
    assert captures.merged_questions(base, more, "a").count() == 5
    assert captures.merged_questions(base.limit(0), more, "a").count() == 4
    assert captures.merged_questions(base, more.limit(0), "a").count() == 3
