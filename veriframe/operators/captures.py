"""What captures hold: quizzes and banks by what was captured of them, questions by dimension, claims of reports, work done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions.files import canonical_asset_name
from veriframe.functions.text import SPACE, clean_name, clean_text, fuzzy, let, path_form, path_similarity
from veriframe.operators.readiness import interaction_key

# Numbers as words, in order from zero, and how a text declares the length of an exam.
NUMBERS = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen",
    "sixteen", "seventeen", "eighteen", "nineteen", "twenty",
)
NUMBER_AND_DIGITS = rf"(?i)\b({'|'.join(NUMBERS)})\s*\((\d+)\)"
QUESTION_KINDS = (
    r"short[ -]answer", r"long[ -]answer(?:\s*\(calculation\))?", r"true\s*/\s*false", r"multiple[ -]choice", r"multiple[ -]select", "matching", "essay", "numeric",
    r"written[ -]response",
)
DECLARED_COUNT = rf"(?i)(?<!\b(?:\d{{1,15}} of|from|pool of|bank of) ?)\b(\d{{1,15}})[ -]+(?:(?:{'|'.join(QUESTION_KINDS)})(?:\s*,?\s*(?:and\s+)?))*questions?\b"
SUPPORTED_TYPES = ("single-select", "multiple-select", "true-false", "text-entry", "essay", "regex")
NEVER_COMPARED = ("scoring", "structured_math", "rubric", "attempts_and_time", "media", "version")
# Phrases of ingestion reports.
FIELD = r"passing threshold|passing score|grader type|rubric|graded|grade setting"
LEFT_OPEN = r"\b(?:set|left|kept)\s+(?:the\s+)?passing (?:threshold|score)\s+(?:to\s+)?(?:unspecified\s*\(null\)|null|unspecified)\b\)?"
GENERATED = rf"(?i)\b(?:generated?|created?|set|assigned?|added?)\b[^.!?]*\b(?:{FIELD})\b"
NOT_ATTACHED = (
    r"(?i)\b(?:could not|cannot|unable to|failed to)\s+(?:be\s+)?(?:attach(?:ed)?|embed(?:ded)?|upload(?:ed)?|include(?:d)?|represent(?:ed)?|resolve(?:d)?)\b",
    r"(?i)\b(?:attachments?|documents?|files?|assets?|images?|videos?)\b",
)
NOT_AVAILABLE = r"(?i)\b(?:attachment|document|file|asset)\b[^.!?]{0,180}\b(?:not (?:available|represented|attached|embedded)|missing from|no corresponding asset)\b"
NO_IDENTIFIER = (
    r"(?i)\b(?:lacking|without|no|missing)\s+(?:an?\s+)?(?:corresponding\s+)?asset\s+(?:identifier|id)\b", r"(?i)\b(?:attachment|document|file)\b", r"(?i)\b(?:plain text|embedding|attach|upload)\b",
)
NO_NESTING = (
    r"(?i)\b(?:assets?|images?|tables?)\b[^.!?]{0,90}\b(?:cannot be nested|(?:not|never) (?:allowed|supported) (?:inside|within))\b|\b(?:CML|HTML)\b[^.!?]{0,70}\b(?:does not support|does not allow)\b[^.!?]{0,70}\b(?:inside|within)\b",
    r"(?i)\b(?:converted|transformed|lifted|extracted|moved)\b",
)
# File names that say nothing of their content, and what of a name is left out before asking.
GENERIC_NAME = (
    r"^(?:rubric|assessment|assignment|worksheet|workbook|participant workbook|instructor guide|syllabus|glossary|resource|resources|document|file|attachment|image|logo|answer key|answers?)$"
)
ASSET_END = r"\.(pdf|docx?|pptx?|xlsx?|csv|zip|png|jpe?g|webp)$"
EDITION = r"\b(?:final|combined|current|copy|v\d+(?:\.\d+)*)\b"
# Minutes of items, the first rule that holds; tools by name.
VIDEO_TOOLS, WRITTEN_TOOLS, FILE_TOOLS = ("mapi", "alvin", "altp"), ("assessment", "short-form-writing"), ("staticfile", "url")
FEATURES = ("webcontent", "assessments", "discussions", "weblinks", "lti", "empty", "unknown", "orphans", "runtimes", "total")
COUNTED = ("webcontent", "assessments", "discussions", "weblinks", "lti", "unknown")
# What extracted text holds that is no text of the page, and names of precisions with their decimal places.
NOTES = (r"(?m)^\[(?:TEACHING|ASSESSMENT|GAP) \|[^\n]*\]\s*", r"(?m)^\[PAGE \d+\]\s*$", r"(?m)^\[No text layer on this page\]\s*$", r"[\u200b\ufeff]")
LOADING, PAGE_OF, ZOOM = r"(?i)^loading(?:\.{1,3}|…)?$", r"^/\s*\d+$", r"^\d+(?:\.\d+)?%$"
PLACES = {
    "millionth": 6, "hundred thousandth": 5, "ten thousandth": 4, "thousandth": 3, "hundredth": 2, "tenth": 1, "integer": 0, "whole number": 0, "ten": -1, "hundred": -2, "thousand": -3,
    "ten thousand": -4, "hundred thousand": -5, "million": -6,
}
EXACT_TITLE, NEAR_TITLE, SAME_PATH, SAME_TYPE = 0.82, 0.65, 0.18, 0.10


def _all(text: Column, patterns) -> Column:
    out = F.lit(True)
    for p in patterns:
        out = out & text.rlike(p)
    return out


def declared_question_count(c: Column) -> Column:
    """The one length of an exam that a text declares; null for none, for several, and where a number's word and
    digits differ."""
    numbers = F.array(*map(F.lit, NUMBERS))

    def counted(text: Column) -> Column:
        spelt = F.zip_with(
            F.regexp_extract_all(text, F.lit(NUMBER_AND_DIGITS), 1), F.regexp_extract_all(text, F.lit(NUMBER_AND_DIGITS), 2), lambda w, d: F.array_position(numbers, F.lower(w)) - 1 == d.try_cast("long")
        )
        plain = F.regexp_replace(text, NUMBER_AND_DIGITS, "$2")
        counts = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(plain, F.lit(DECLARED_COUNT), 1), lambda n: n.cast("long")), lambda n: n > 0))
        return F.when(F.forall(spelt, lambda same: F.coalesce(same, F.lit(False))) & (F.size(counts) == 1), F.get(counts, 0))

    return let(clean_text(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]*>", " ")), counted)


def quiz_status(asked: Column, captured: Column, declared: Column, verified: Column) -> Column:
    """State of a quiz's capture: as the capture says, else by the questions it holds and those it declares."""
    return (
        F.when(asked == "PARTIAL", "PARTIAL_API_CAPTURE")
        .when(asked.isin("UNAVAILABLE", "NOT_REQUESTED"), asked)
        .when(captured == 0, "NO_DEFINITIONS_CAPTURED")
        .when(declared.isNotNull() & (declared != captured), "COUNT_DIFFERS")
        .when(~F.coalesce(verified, F.lit(True)), "TOTAL_UNVERIFIED")
        .otherwise("CAPTURED")
    )


def quiz_captures(quizzes: DataFrame, course: str) -> DataFrame:
    """(course, quizzes, definitions, gaps) of quizzes(course, asked, captured, description, verified)."""
    captured = F.coalesce("captured", F.lit(0))
    status = quiz_status(F.col("asked"), captured, declared_question_count(F.col("description")), F.col("verified"))
    return quizzes.groupBy(course).agg(F.count("*").alias("quizzes"), F.sum(captured).alias("definitions"), F.count_if(status != "CAPTURED").alias("gaps"))


def assignment_behavior(kind: Column, points: Column) -> Column:
    """struct(observed, file_upload, text_submission, on_paper, in_person, points) of a coded kind of submission, 0 to 4."""
    is_one = lambda *codes: F.coalesce(kind.isin(*codes), F.lit(False))
    return F.struct(
        (is_one(0, 1, 2, 3, 4) | points.isNotNull()).alias("observed"), is_one(0, 4).alias("file_upload"), is_one(1, 4).alias("text_submission"), is_one(2).alias("on_paper"), is_one(3).alias("in_person"),
        points.alias("points"),
    )


def question_dimensions(source: Column, target: Column) -> Column:
    """struct(status, dimensions) of two questions (prompt, type, options, answers, keyed, feedback, feedback_captured,
    limitations). VERIFIED or DIFFERENT only where both sides are wholly known; nothing makes the whole VERIFIED."""
    both = lambda use: F.coalesce(use(source), F.lit(False)) & F.coalesce(use(target), F.lit(False))
    clear = lambda pattern: both(lambda q: ~F.exists(F.coalesce(q["limitations"], F.array().cast("array<string>")), lambda s: s.rlike(pattern)))
    known = {
        "prompt": both(lambda q: q["prompt"] != "") & clear("(?i)truncat|prompt not captured|math.*unverified"),
        "type": both(lambda q: q["type"].isin(*SUPPORTED_TYPES)),
        "options": both(lambda q: F.size(q["options"]) > 0) & clear("(?i)choice.*(unverified|truncat)"),
        "answers": both(lambda q: q["keyed"] & q["answers"].isNotNull()),
        "feedback": both(lambda q: q["feedback_captured"]),
    }
    rows = [F.struct(F.lit(d).alias("dimension"), F.when(seen, F.when(source[d].eqNullSafe(target[d]), "VERIFIED").otherwise("DIFFERENT")).otherwise("UNVERIFIED").alias("status")) for d, seen in known.items()]
    rows += [F.struct(F.lit(d).alias("dimension"), F.lit("UNVERIFIED").alias("status")) for d in NEVER_COMPARED]
    whole = lambda all_: F.when(F.exists(all_, lambda d: d["status"] == "DIFFERENT"), "DIFFERENT").otherwise("UNVERIFIED")
    return let(F.array(*rows), lambda all_: F.struct(whole(all_).alias("status"), all_.alias("dimensions")))


def bank_coverage(questions: DataFrame, bank: str) -> DataFrame:
    """(bank, total, texts, answers, feedback, no_feedback) of questions(bank, prompt, cut, options_reliable,
    answer_coverage, answers_reliable, feedback_coverage); what isn't said is not covered."""
    n = lambda when, name: F.count_if(F.coalesce(when, F.lit(False))).alias(name)
    text = (F.col("prompt") != "") & ~F.col("cut") & F.col("options_reliable")
    return questions.groupBy(bank).agg(
        F.count("*").alias("total"), n(text, "texts"), n((F.col("answer_coverage") == "CAPTURED") & F.col("answers_reliable"), "answers"),
        n(F.col("feedback_coverage").isin("CAPTURED", "NONE_AUTHORED"), "feedback"), n(F.col("feedback_coverage") == "NONE_AUTHORED", "no_feedback"),
    )


def work_metrics(records: DataFrame, course: str) -> DataFrame:
    """(course, reviews, comparisons, intakes, events, mapping_reviews, reviews_per_comparison) of records(course, kind, type,
    events, mapping_reviews): counts of what was recorded, not of its quality."""
    operation = lambda t: (F.col("kind") == "operations") & (F.col("type") == t)
    total = lambda c: F.coalesce(F.sum(F.when(operation("item-lifecycle"), F.col(c))), F.lit(0)).alias(c)
    rows = records.groupBy(course).agg(
        F.count_if(F.col("kind") == "item-review").alias("reviews"), F.count_if(F.col("kind") == "audit").alias("comparisons"), F.count_if(operation("evidence-input")).alias("intakes"), total("events"),
        total("mapping_reviews"),
    )
    return rows.withColumn("reviews_per_comparison", F.when(F.col("comparisons") > 0, F.col("reviews") / F.col("comparisons")))


def generated_behavior(c: Column) -> Column:
    """A sentence tells of a generated setting; that a passing score was left open is none, nor what explains it."""

    def told(sentence: Column) -> Column:
        rest = F.regexp_replace(sentence, f"(?is)^(.*?){LEFT_OPEN}", "$1")
        kept = F.regexp_replace(rest, r"(?is)\bbecause\b.*$", "")
        field = rf"(?i)\b(?:{FIELD})\b"
        return F.when(sentence.rlike(f"(?i){LEFT_OPEN}"), rest.rlike(GENERATED) | kept.rlike(field)).otherwise(sentence.rlike(field))

    return F.exists(F.split(clean_text(c), r"[.!?;]\s+"), told)


def asset_event(c: Column) -> Column:
    """What a report's text says of an asset: not resolved, only adapted, or nothing."""
    lost = lambda t: _all(t, NOT_ATTACHED) | t.rlike(NOT_AVAILABLE) | _all(t, NO_IDENTIFIER)
    return let(clean_text(c), lambda t: F.when(lost(t), "UNRESOLVED_SOURCE_ASSET").when(_all(t, NO_NESTING), "CONTENT_MARKUP_ADAPTATION").otherwise(""))


def is_concrete_asset(sha: Column, visual: Column, asset_id: Column, size: Column, url: Column) -> Column:
    """A hash, an id, a size or a web address shows that an asset exists; a name alone doesn't."""
    there = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.lower(F.coalesce(sha, F.lit(""))).rlike("^[0-9a-f]{64}$") | there(visual) | there(asset_id) | F.coalesce(size > 0, F.lit(False)) | F.coalesce(url.rlike("(?i)^https?://"), F.lit(False))


def has_generic_name(name: Column) -> Column:
    """A file name too general to find the file elsewhere by it."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(canonical_asset_name(name)), ASSET_END, ""), EDITION, " ")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " ")).rlike(GENERIC_NAME)


def launch_key(c: Column) -> Column:
    """An address under which equal launches meet: an empty path is /, nothing else is changed."""
    return F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"(?i)^(https?://[^/?#\s]+)(?=[?#]|$)", "$1/")


def item_minutes(level: Column, name: Column, node: Column, tool: Column) -> Column:
    """struct(minutes, rule, counted) of an exported row."""
    low = F.lower(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"^[^\w]+", "")))
    node, tool = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (node, tool))
    reading, written, files = tool == "reading", tool.isin(*WRITTEN_TOOLS), tool.isin(*FILE_TOOLS)
    rules = (
        (F.coalesce(level, F.lit(0)) <= 1, 0, "module-root", False), (low.rlike("instructor|pre-class|active lecture"), 0, "instructor-support-excluded", False),
        (((node != "") & (node != "item")) | ((node == "") & (tool == "")), 0, "container", True), (reading & low.rlike(r"^part\s+[ivxlcdm]+\b"), 0, "reading-navigation-part", True),
        (reading & low.rlike(r"^chapter\s+\d+\b") & ~low.contains("review"), 0, "reading-navigation-chapter", True), (reading & low.contains("review"), 3, "reading-review", True), (reading, 8, "reading-section", True),
        (tool == "learningcurve", 10, "learningcurve-quiz", True), (tool.isin(*VIDEO_TOOLS) | low.contains("video"), 5, "video", True), (written & low.contains("quiz"), 10, "assessment-quiz", True),
        (written & low.rlike(r"homework|assignment|desmos|dynamic\s+figure"), 15, "assessment-activity", True), (tool == "short-form-writing", 15, "short-form-writing", True), (written, 15, "assessment-default", True),
        (files & low.rlike("rubric|report"), 2, "reference-rubric-report", True), (files, 5, "reference-file-url", True),
    )
    value = lambda minutes, rule, counted: F.struct(F.lit(minutes).alias("minutes"), F.lit(rule).alias("rule"), F.lit(counted).alias("counted"))
    return F.coalesce(*(F.when(when, value(*rest)) for when, *rest in rules), value(5, "unknown-leaf-default", True))


def course_features(counts: DataFrame) -> Column:
    """Ten log1p features of a course's counts, null and negative ones as none; a missing total is the sum of its kinds."""
    n = lambda c: F.greatest(F.lit(0.0), F.coalesce(counts[c].cast("double"), F.lit(0.0)))
    whole = sum((F.coalesce(counts[c].cast("double"), F.lit(0.0)) for c in COUNTED), F.lit(0.0))
    total = F.greatest(F.lit(0.0), F.coalesce(F.nullif(counts["total"].cast("double"), F.lit(0.0)), whole))
    return F.array(*(F.log1p(total if c == "total" else n(c)) for c in FEATURES))


def interaction_candidates(missing: DataFrame, targets: DataFrame, course: str) -> DataFrame:
    """missing(course, id, name) discussions with how many discussions of their course among targets(course, id, name)
    have the same key, and the one if it is alone: counts are joined, not candidates."""
    theirs = targets.withColumn("key", interaction_key(F.col("name"))).where("key != ''").groupBy(course, "key").agg(F.count("*").alias("candidates"), F.min("id").alias("only"))
    rows = missing.withColumn("key", interaction_key(F.col("name"))).join(theirs, [course, "key"], "left")
    return rows.select(course, "id", "key", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.when(F.col("candidates") == 1, F.col("only")).alias("candidate"))


def text_quality(c: Column) -> Column:
    """struct(readable, placeholder, viewer) of extracted text: whether lines are left that are neither notes of the
    extraction nor signs of a viewer or of a page that was still loading."""
    bare = F.coalesce(c, F.lit(""))
    for note in NOTES:
        bare = F.regexp_replace(bare, note, "")
    lines = F.filter(F.transform(F.split(bare, r"\r?\n"), lambda x: F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")), lambda x: x != "")

    def judged(kept: Column) -> Column:
        viewer = F.exists(kept, lambda x: x.rlike(PAGE_OF)) & F.exists(kept, lambda x: x.rlike(ZOOM))
        unfinished = viewer | F.exists(kept, lambda x: x.rlike(LOADING))
        content = F.exists(kept, lambda x: ~(x.rlike(LOADING) | x.rlike(PAGE_OF) | x.rlike(ZOOM)))
        readable = F.when(unfinished, content).otherwise(F.size(kept) > 0)
        return F.struct(readable.alias("readable"), ((F.size(kept) > 0) & ~readable).alias("placeholder"), viewer.alias("viewer"))

    return let(lines, judged)


def decimal_places(c: Column) -> Column:
    """Decimal places that the name of a precision asks for, negative for tens and more; null for other words."""
    plain = F.trim(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("-"), F.lit(" ")))
    named = F.try_element_at(F.create_map(*(F.lit(x) for pair in PLACES.items() for x in pair)), plain)
    return F.coalesce(named, F.nullif(F.regexp_extract(plain, "^([0-6]) decimal places?$", 1), F.lit("")).cast("int"))


def merged_questions(base: DataFrame, incoming: DataFrame, assessment: str) -> DataFrame:
    """Questions(assessment, file, ordinal, id, prompt) of both, those of ``incoming`` once each and only if ``base`` has none
    with the same file, place, id and prompt in normal form; null and empty are the same. Of equal ones the smallest row stays."""
    keys = [F.coalesce(F.col("file"), F.lit("")), F.coalesce(F.col("ordinal").cast("string"), F.lit("")), F.coalesce(F.col("id"), F.lit("")), F.lower(clean_text("prompt"))]
    names = [f"_k{i}" for i in range(len(keys))]
    columns = [assessment, "file", "ordinal", "id", "prompt"]
    keyed = lambda df: df.select(*columns, *(k.alias(n) for k, n in zip(keys, names, strict=True)))
    new = keyed(incoming).groupBy(assessment, *names).agg(F.min(F.struct("file", "ordinal", "id", "prompt")).alias("q"))
    new = new.join(keyed(base).select(assessment, *names).distinct(), [assessment, *names], "left_anti")
    return base.select(*columns).unionByName(new.select(assessment, "q.*"))


def topic_score(title: Column, topic: Column, path: Column, topic_path: Column, compatible: Column) -> Column:
    """How well a topic fits an item, 0 to 1: title first, then path (none if one has none) and type."""
    a, b = clean_name(title), clean_name(topic)
    base = F.when(a == b, EXACT_TITLE).otherwise(fuzzy(a, b) * NEAR_TITLE)
    place = F.coalesce(path_similarity(path_form(path), path_form(topic_path)), F.lit(0.0)) * SAME_PATH
    return F.when((a == "") | (b == ""), 0.0).otherwise(F.least(F.lit(1.0), base + place + F.when(compatible, SAME_TYPE).otherwise(0.0)))


def encoded_sha256(c: Column) -> Column:
    """SHA-256 of the bytes that a base64 text stands for; null if it is none."""
    return F.sha2(F.try_to_binary(c, F.lit("base64")), 256)
