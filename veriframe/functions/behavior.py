"""How an item behaves: what its text states, which interactive runtime its files show, whether a target keeps its settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veriframe.functions.text import clean_text, let

# What a resource type, its address and its files say of a runtime.
TYPE_FAMILIES = (("SCORM", "scorm|adlcp"), ("AICC", "aicc"), ("TINCAN_XAPI", "tincan|xapi"))
ADDRESS_FAMILIES = (("SCORM", r"(?:^|/)(?:scorm|scormengine|index_lms\.html)(?:/|$|[?#])"), ("TINCAN_XAPI", r"tincan\.xml"))
FILE_FAMILIES = (
    ("STORYLINE", r"storyline|story\.html|story_content"), ("RISE_ARTICULATE", r"articulate|/rise(?:/|[-_.])"),
    ("SCORM", r"scorm|index_lms\.html"), ("TINCAN_XAPI", r"tincan\.xml"),
)
EXPLICIT_FILE = r"(?:^|/)(?:story\.html|index_lms\.html|tincan\.xml)(?:$|[?#])|(?:storyline|scorm2004|scorm_?1\.2|scormdriver|articulate|/rise(?:/|[-_.]))"
SUPPORTING_FILE = r"/(?:story_content|scorm|tincan|lms)/|(?:player|launcher|launch)\.(?:html?|js)(?:$|[?#])"
PRACTICE_FILE, PRACTICE_FAMILY = r"\.practice\.json(?:$|[?#])", "D2L_PRACTICE_RUNTIME"
SUPPORTING_FROM = 3
CARRIER_TYPE = "Ungraded Plugin"
CARRIER_LINK = r"launch|scorm|tincan|xapi|plugin|widget"
CARRIER_FILE = r"story\.html|index_lms\.html|tincan\.xml|scormdriver|storyline|articulate|\.practice\.json"
# What exported text says of submissions, attempts and points.
FILE_PHRASE = r"(?i)\bfile[ _-]+(?:upload|submission)\b|\bsubmit(?:ted)?[ _-]+(?:a[ _-]+)?file\b"
TEXT_PHRASE = r"(?i)\btext[ _-]+submission\b|\binline[ _-]+text\b"
ATTEMPTS_PHRASE = r"(?i)\b(?:attempts?|submissions?)\s*[:=]?\s*(unlimited|\d+)\b"
POINTS_PHRASE = r"(?i)\b(?:grade\s+out\s+of|points?)\s*[:=]?\s*(\d+(?:\.\d+)?)\b"
BEHAVING_TYPE = "(?i)Assignment|Assessment|Quiz|Exam"

_NAMES = "array<string>"


def _hits(value: Column, table) -> Column:
    return F.array_compact(F.array(*(F.when(value.rlike(pattern), name) for name, pattern in table)))


def interactive_signals(kind: Column, paths: Column, address: Column) -> Column:
    """struct(detected, confidence, families): HIGH with an explicit marker, MEDIUM with a practice file or three
    supporting ones; families in order of appearance. Null arguments say nothing."""
    plain = lambda c: F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("\\"), F.lit("/"))
    files = F.array_distinct(F.transform(F.coalesce(paths, F.array().cast(_NAMES)), plain))
    own = F.concat(_hits(F.lower(F.coalesce(kind, F.lit(""))), TYPE_FAMILIES), _hits(plain(address), ADDRESS_FAMILIES))
    practice = lambda f: F.when(f.rlike(PRACTICE_FILE), F.array(F.lit(PRACTICE_FAMILY))).otherwise(F.array().cast(_NAMES))
    marked = lambda f: F.when(f.rlike(EXPLICIT_FILE), _hits(f, FILE_FAMILIES)).otherwise(F.array().cast(_NAMES))
    shown = F.flatten(F.transform(files, lambda f: F.concat(practice(f), marked(f))))
    supporting = F.size(F.filter(files, lambda f: ~f.rlike(EXPLICIT_FILE) & f.rlike(SUPPORTING_FILE)))
    explicit = (F.size(own) > 0) | F.exists(files, lambda f: f.rlike(EXPLICIT_FILE))
    likely = (supporting >= SUPPORTING_FROM) | F.exists(files, lambda f: f.rlike(PRACTICE_FILE))
    confidence = F.when(explicit, "HIGH").when(likely, "MEDIUM").otherwise("LOW")
    return F.struct((explicit | likely).alias("detected"), confidence.alias("confidence"), F.array_distinct(F.concat(own, shown)).alias("families"))


def merged_families(first: Column, more: Column) -> Column:
    """Union of two lists of families in order of appearance, without empty ones."""
    none = F.array().cast(_NAMES)
    return F.filter(F.array_distinct(F.concat(F.coalesce(first, none), F.coalesce(more, none))), lambda f: f != "")


def runtime_review(detected: Column, kind: Column, links: Column, paths: Column) -> Column:
    """struct(status, carrier): a detected runtime always asks for a review; ``carrier`` tells whether the target has
    something that could run it."""
    any_of = lambda values, pattern: F.exists(F.coalesce(values, F.array().cast(_NAMES)), lambda v: F.lower(v).rlike(pattern))
    seen = F.coalesce(detected, F.lit(False))
    carrier = (clean_text(kind) == CARRIER_TYPE) | F.coalesce(any_of(links, CARRIER_LINK), F.lit(False)) | F.coalesce(any_of(paths, CARRIER_FILE), F.lit(False))
    return F.struct(F.when(seen, "REVIEW").otherwise("NOT_APPLICABLE").alias("status"), (seen & carrier).alias("carrier"))


def stated_behavior(kind: Column, markup: Column) -> Column:
    """struct(observed, file_upload, text_submission, attempts, points) of what exported text says outright."""

    def read(text: Column) -> Column:
        assigned = F.lower(F.coalesce(kind, F.lit(""))).contains("assignment") | F.lower(text).rlike(r"\bassignment\b")
        upload, inline = assigned & text.rlike(FILE_PHRASE), assigned & text.rlike(TEXT_PHRASE)
        attempts = F.nullif(F.regexp_extract(text, ATTEMPTS_PHRASE, 1), F.lit(""))
        points = F.nullif(F.regexp_extract(text, POINTS_PHRASE, 1), F.lit("")).cast("double")
        observed = upload | inline | attempts.isNotNull() | points.isNotNull()
        return F.struct(observed.alias("observed"), upload.alias("file_upload"), inline.alias("text_submission"), attempts.alias("attempts"), points.alias("points"))

    return let(clean_text(F.regexp_replace(F.coalesce(markup, F.lit("")), "<[^>]+>", " ")), read)


def quiz_behavior(description: Column, grade_item: Column, exported: Column, unlimited: Column, attempts: Column, minutes: Column, enforced: Column) -> Column:
    """struct(observed, graded, conflict, attempts, minutes) of a quiz's settings. A quiz that calls itself ungraded and
    is linked to grades is a conflict, and then neither."""
    linked = F.coalesce(grade_item > 0, F.lit(False)) | F.coalesce(exported, F.lit(False))
    words = F.coalesce(description, F.lit(""))
    ungraded = words.rlike(r"(?i)\bungraded\b") & ~words.rlike(r"(?i)\bnot\s+(?:an?\s+)?ungraded\b")
    graded = F.when(ungraded & ~linked, False).when(~ungraded & linked, True)
    tries = F.when(F.coalesce(unlimited, F.lit(False)), "UNLIMITED").when(attempts.isNotNull(), attempts.cast("string"))
    limit = F.when(F.coalesce(enforced, F.lit(True)), minutes)
    return F.struct(
        (graded.isNotNull() | tries.isNotNull() | minutes.isNotNull()).alias("observed"), graded.alias("graded"), (ungraded & linked).alias("conflict"), tries.alias("attempts"), limit.alias("minutes"),
    )


def attempts_key(c: Column) -> Column:
    """UNLIMITED, or the first number in the text without leading zeros; else null."""
    number = F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"\d+", 0), F.lit(""))
    return F.when(F.lower(c).contains("unlimited"), "UNLIMITED").otherwise(F.nullif(F.regexp_replace(number, r"^0+(?=\d)", ""), F.lit("")))


def compare_behavior(kind: Column, source: Column, target: Column) -> Column:
    """struct(status, issues) of two structs (file_upload, text_submission, ai_graded, attempts, graded, passing, points,
    minutes, conflict); null where a side was not observed. Each setting that the source has is one row of a small
    list, SAME, UNVERIFIED (the target doesn't tell) or the way in which it differs; the status reads that list."""
    yes = lambda side, name: F.coalesce(side[name], F.lit(False))
    row = lambda name, state: F.struct(F.lit(name).alias("setting"), state.alias("state"))

    def submission(name: str, flag: str, replaced: Column) -> Column:
        return row(name, F.when(yes(source, flag), F.when(yes(target, flag), "SAME").when(replaced, "REPLACED").otherwise("UNVERIFIED")))

    def setting(name: str, want: Column, got: Column) -> Column:
        return row(name, F.when(want.isNotNull(), F.when(got.isNull(), "UNVERIFIED").when(want == got, "SAME").otherwise("CHANGED")))

    passing = setting("PASSING_THRESHOLD", source["passing"], target["passing"])["state"]
    gate = F.coalesce(~source["graded"] & (target["passing"] > 0), F.lit(False))
    rows = F.array(
        submission("FILE_UPLOAD", "file_upload", yes(target, "ai_graded") | yes(target, "text_submission")),
        submission("TEXT_SUBMISSION", "text_submission", yes(target, "file_upload") & ~yes(target, "ai_graded")),
        setting("ATTEMPTS", attempts_key(source["attempts"]), attempts_key(target["attempts"])),
        setting("GRADED_STATE", source["graded"], target["graded"]),
        row("PASSING_THRESHOLD", F.when(gate, "ON_UNGRADED_SOURCE").otherwise(passing)),
        setting("POINTS", source["points"], target["points"]),
        setting("TIME_LIMIT", source["minutes"], target["minutes"]),
    )
    codes = lambda kept: F.transform(kept, lambda r: F.concat_ws("_", r["setting"], r["state"]))
    none = F.array().cast(_NAMES)

    def judged(checks: Column) -> Column:
        changed = F.filter(checks, lambda r: ~r["state"].isin("SAME", "UNVERIFIED"))
        unseen = F.filter(checks, lambda r: r["state"] == "UNVERIFIED")
        conflict = yes(target, "conflict")
        compared = F.exists(checks, lambda r: r["state"] != "UNVERIFIED")
        status = F.when(F.size(changed) > 0, "MUTATED").when((F.size(unseen) > 0) | ~compared | conflict, "UNVERIFIED").otherwise("VERIFIED")
        issues = F.concat(codes(changed), codes(unseen), F.when(conflict, F.array(F.lit("NATIVE_GRADING_OBSERVATIONS_CONFLICT"))).otherwise(none))
        return F.struct(status.alias("status"), issues.alias("issues"))

    unknown = lambda status, *issue: F.struct(F.lit(status).alias("status"), F.array(*map(F.lit, issue)).cast(_NAMES).alias("issues"))
    return (
        F.when(source.isNull() & F.coalesce(kind, F.lit("")).rlike(BEHAVING_TYPE), unknown("UNVERIFIED", "BEHAVIOR_SOURCE_UNVERIFIED"))
        .when(source.isNull(), unknown("NOT_APPLICABLE"))
        .when(target.isNull(), unknown("UNVERIFIED", "BEHAVIOR_DESTINATION_UNVERIFIED"))
        .otherwise(let(F.filter(rows, lambda r: r["state"].isNotNull()), judged))
    )
