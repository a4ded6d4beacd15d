import pytest

from veriframe.operators import claims

REPORTS = "course string, report_id int, name string, path string, text string"
ITEMS = "course string, item_id string, name string, path string, assets array<string>"


def report(spark, text, name="Author Alignment Report"):
    return spark.createDataFrame([("c", 1, name, None, text), ("c", 2, "A page", None, text), ("c", 3, name, None, None)], REPORTS)


def found(df):
    return sorted((r["type"], r["subject"], r["path"]) for r in df.collect())


def test_events_take_the_nearest_headings_before_them(spark):
    text = (
        "Transformations. Module: Module 1 Basics Item: Reading list Content Excluded Left out. Item: Lab 2 Content Adaptation The file could not be uploaded. "
        "Module: Module 2 More Content Excluded Also left out. Item: lecture Content Excluded Gone. DO NOT PUBLISH"
    )
    rows = claims.report_events(report(spark, text)).orderBy("place").collect()
    assert [(r["category"], r["subject"], r["path"]) for r in rows] == [
        ("Content Excluded", "Reading list", "Module 1 Basics"), ("Content Adaptation", "Lab 2", "Module 1 Basics"),
        ("Content Excluded", "Module 2 More", "Module 2 More"), ("Content Excluded", "", "Module 2 More"),
    ]
    assert rows[0]["body"] == "Left out."


def test_a_heading_too_far_before_is_none(spark):
    text = "Module: Far away Content Excluded One. " + "filler " * 2000 + "Content Excluded Two."
    rows = claims.report_events(report(spark, text)).orderBy("place").collect()
    assert [r["path"] for r in rows] == ["Far away", ""]


def test_an_event_may_claim_several_things_and_the_same_words_are_one_claim(spark):
    twice = "Module: M Item: Essay Unsupported Content Fallback Course team should restore the file. "
    text = "Content Adaptation " + twice * 2 + "[ERROR DURING DISTILLATION] for a page. Later"
    assert found(claims.report_claims(report(spark, text))) == [
        ("REPAIR_INSTRUCTION", "Essay", "M"), ("REPAIR_INSTRUCTION", "Essay", "M"), ("SI_PROCESSING_FAILURE", "Essay", "M"), ("SI_PROCESSING_FAILURE", "processing", ""), ("UNSUPPORTED_CONTENT_FALLBACK", "Essay", "M"), ("UNSUPPORTED_CONTENT_FALLBACK", "Essay", "M"),
    ]


@pytest.mark.parametrize(
    ("kind", "words", "want"),
    [
        ("GENERATED_BEHAVIOR", "Set the passing score to null because the source is silent", ("SOURCE_GRADING_UNSPECIFIED", "INFO", "s")),
        ("GENERATED_BEHAVIOR", "Set the passing score to null. Created a rubric.", ("GENERATED_BEHAVIOR", "REVIEW", "s")),
        ("REPAIR_INSTRUCTION", 'The attachment "a/b/Guide.docx" could not be uploaded; restore it', ("UNRESOLVED_SOURCE_ASSET", "CRITICAL", "Guide.docx")),
        ("UNRESOLVED_SOURCE_ASSET", "Tables cannot be nested and were moved", ("CONTENT_MARKUP_ADAPTATION", "INFO", "s")),
        ("UNRESOLVED_SOURCE_ASSET", "A separate rubric document is not available within this item", ("SOURCE_ASSET_SCOPE_REVIEW", "REVIEW", "s")),
        ("UNSUPPORTED_CONTENT_FALLBACK", "'x.pdf' and 'y.pdf' became text", ("UNSUPPORTED_CONTENT_FALLBACK", "REVIEW", "s")),
        ("INTENTIONAL_EXCLUSION", "'x.pdf' was left out", ("INTENTIONAL_EXCLUSION", "REVIEW", "s")),
    ],
)
def test_scope(spark, kind, words, want):
    r = claims.scoped(spark.createDataFrame([("c", kind, "REVIEW", "s", "p", words)], "course string, type string, severity string, subject string, path string, excerpt string")).first()
    assert (r["type"], r["severity"], r["subject"]) == want
    assert (r["original_type"], r["original_subject"]) == ((kind, "s") if want[0] != kind or want[2] != "s" else (None, None))


def test_claims_are_bound_to_one_item_or_none(spark):
    rows = [
        ("c", "GENERATED_BEHAVIOR", "REVIEW", "Essay one", "Module 1", "told", None, None),  # the exact name, once in the module
        ("c", "GENERATED_BEHAVIOR", "REVIEW", "Twice here", "Module 1", "told", None, None),
        ("c", "SI_PROCESSING_FAILURE", "CRITICAL", "", "Module 1", "the lab on levers failed", None, None),  # the name in its words
        ("c", "SI_PROCESSING_FAILURE", "CRITICAL", "", "Module 1", "the final quiz failed", None, None),
        ("c", "UNRESOLVED_SOURCE_ASSET", "CRITICAL", "guide", "Module 1", "in Question 'How long is the lever of the crane?' a file", None, None),  # the quoted question
        ("c", "UNRESOLVED_SOURCE_ASSET", "CRITICAL", "levers figure.png", "Module 1", "file", None, None),  # the asset
        ("c", "UNRESOLVED_SOURCE_ASSET", "CRITICAL", "levers figure.png", "Module 3", "file", None, None),  # in another module
    ]
    told = spark.createDataFrame(rows, "course string, type string, severity string, subject string, path string, excerpt string, original_type string, original_subject string")
    items = spark.createDataFrame(
        [("c", "e", "Essay One", "Module 1 > A", []), ("c", "t1", "Twice here", "Module 1", []), ("c", "t2", "twice HERE", "Module 1 > B", []), ("c", "l", "Lab on levers", "Module 1 > A", ["Levers figure"]),
         ("c", "f", "Final quiz", "Module 1", None), ("c", "x", "Essay One", "Module 2", []), ("d", "e", "Essay One", "Module 1", [])], ITEMS
    )
    questions = spark.createDataFrame([("c", "f", "How long is the lever  of the crane?"), ("c", "x", "How long is the lever of the crane?")], "course string, item_id string, prompt string")
    local = claims.localized(told, items)
    assert {(r["subject"] or r["excerpt"], r["item_id"]) for r in local.collect() if r["item_id"]} == {("Essay one", "e"), ("the lab on levers failed", "l")}
    got = {(r["item_id"], r["type"], r["basis"]) for r in claims.claimed_items(local, items, questions).collect()}
    assert got == {
        ("e", "GENERATED_BEHAVIOR", "BOUND"), ("l", "SI_PROCESSING_FAILURE", "BOUND"), ("t1", "GENERATED_BEHAVIOR", "NAME"), ("t2", "GENERATED_BEHAVIOR", "NAME"), ("f", "UNRESOLVED_SOURCE_ASSET", "QUESTION"), ("l", "UNRESOLVED_SOURCE_ASSET", "ASSET"),
    }
    assert claims.claimed_items(local, items, questions, most=1).where("item_id = 'l'").count() == 1


@pytest.mark.parametrize("pairs", [0, 50])  # by features and side by side
def test_claims_find_the_same_items_in_large_and_small_courses(spark, pairs):
    told = [("c", kind, "REVIEW", subject, path, words, None, None) for kind, subject, path, words in (
        ("GENERATED_BEHAVIOR", "Lever lab", "Module 1", "a"), ("GENERATED_BEHAVIOR", "Lever lab two", "Module 1", "b"), ("GENERATED_BEHAVIOR", "", "Module 1", "of the Pulley lab, said"), ("GENERATED_BEHAVIOR", "", "Module 2", "of the pulley lab, said"),
        ("CONTENT_MARKUP_ADAPTATION", "", "Module 1", "of the pulley lab"), ("UNRESOLVED_SOURCE_ASSET", "figure of gears.png", "Module 1", "c"), ("UNRESOLVED_SOURCE_ASSET", "figure of gears.png", "Module 2", "d"),
    )]
    claimed = spark.createDataFrame(told, "course string, type string, severity string, subject string, path string, excerpt string, original_type string, original_subject string")
    items = spark.createDataFrame([("c", "l", "Lever LAB", "Module 1 > A", []), ("c", "p", "Pulley lab", "Module 1", ["Figure of gears"]), ("c", "q", "Pulley lab", "Module 3", None), ("d", "l", "Lever lab", "Module 1", [])], ITEMS)
    local = claims.localized(claimed, items, pairs=pairs)
    assert {(r["excerpt"], r["item_id"], r["item_name"], r["method"]) for r in local.collect()} == {
        ("a", "l", "Lever LAB", "UNIQUE_EXACT_SOURCE_NAME_IN_MODULE"), ("of the Pulley lab, said", "p", "Pulley lab", "UNIQUE_EXPLICIT_SOURCE_NAME_IN_MODULE"),
        *((x, None, None, None) for x in ("b", "of the pulley lab, said", "of the pulley lab", "c", "d")),
    }
    got = claims.claimed_items(local, items, spark.createDataFrame([], "course string, item_id string, prompt string"), pairs=pairs)
    assert sorted((r["item_id"], r["type"], r["basis"]) for r in got.collect()) == [
        ("l", "GENERATED_BEHAVIOR", "BOUND"), ("l", "GENERATED_BEHAVIOR", "NAME"), ("p", "GENERATED_BEHAVIOR", "BOUND"), ("p", "UNRESOLVED_SOURCE_ASSET", "ASSET"),
    ]


def test_an_event_told_in_many_reports_is_judged_once(spark):
    from pyspark.sql import functions as F

    text = "Transformations. Module: M Item: Essay Content Excluded Left out. [ERROR DURING DISTILLATION] of a page. Later"
    reports = spark.range(50).select(F.col("id").cast("string").alias("course"), F.lit(1).alias("report_id"), F.lit("Author Alignment Report").alias("name"), F.lit("").alias("path"), F.lit(text).alias("text"))
    rows = claims._read(reports).select(F.coalesce(F.concat_ws(" ", "category", "body"), "body").alias("event"), "failed")
    assert claims._judged(rows).count() == 3  # the exclusion, the failure in its words, the failure anywhere
    assert claims.report_claims(reports).groupBy("course").count().where("count = 3").count() == 50
