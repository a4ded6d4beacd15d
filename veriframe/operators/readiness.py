"""Whether a target is ready: dimensions of evidence and their gate, stages of a course, losses, findings, repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions.behavior import BEHAVING_TYPE
from veriframe.functions.files import normal_zip_path, url_decoded
from veriframe.functions.text import clean_name, words

# Statuses that settle a dimension, words of those that fail it, verdicts a gate may lower.
SETTLED = ("VERIFIED", "TRANSFORMED", "RELOCATED", "VERIFIED_CONFIGURATION")
FAILING = "MISSING|MUTATED|CHANGED|FAILED|PARTIAL"
GOOD_VERDICTS = ("VERIFIED", "EXPECTED_TRANSFORMATION", "MOVED")
ANSWERS_FROM = 0.99
# Names under which a stage is asked for, and shares of published items that show one.
REQUESTS = (
    ("raw", ("raw", "raw_ingestion", "raw-ingestion")), ("ops", ("ops", "current", "ops_ready", "ops-ready", "prepared")),
    ("published", ("published", "learner_facing", "learner-facing", "live")),
)
STAGE_FROM, RAW_SHARE, PUBLISHED_SHARE = 3, 0.70, 0.90
# Issues by what they prove of a loss, and the evidence that a split item needs for one.
NO_LOSS = ("MANUAL_PAYLOAD_REGRESSION_SINCE_RAW", "SI_UNRESOLVED_SOURCE_ASSET")
SURE_LOSS = ("SI_GENERATED_CONTENT_FALLBACK_HARD", "RUBRIC_CONTENT_CHANGED", "ASSESSMENT_CHANGED")
SPLIT_PAYLOAD, SPLIT_TEXT, COVERED = 0.85, 0.80, 80
# Words that don't tell one interaction from another.
INTERACTION_WORDS = ("forum", "activity", "activities", "discussion", "prompt", "graded", "ungraded", "topic", "exercise")


def evidence_dimensions(f: DataFrame) -> Column:
    """array of struct(dimension, required, status) from the facts of a result: comparable, structured, has_text, assets,
    links, assets_missing, assets_open, kind, behaves, runs, answers_apply, answer_share, and ``status``, a map from
    check to status. A check that isn't in the map is UNVERIFIED; a dimension that isn't required NOT_APPLICABLE."""
    has = lambda name: F.coalesce(f[name], F.lit(False))
    stated = lambda check: F.coalesce(F.try_element_at(f["status"], F.lit(check)), F.lit("UNVERIFIED"))
    assets = F.when(f["assets_missing"] > 0, "MISSING").when(f["assets_open"] > 0, "UNVERIFIED").otherwise(stated("assets"))
    nothing = (F.coalesce(f["assets"], F.lit(0)) == 0) & (F.coalesce(f["links"], F.lit(0)) == 0)
    table = (
        ("structure", F.lit(True), stated("structure")),
        ("learner_text", F.coalesce(f["comparable"], F.lit(True)) & ~has("structured") & (has("has_text") | nothing), stated("content")),
        ("required_assets", F.coalesce(f["assets"] > 0, F.lit(False)), assets),
        ("links_media", F.coalesce(f["links"] > 0, F.lit(False)), stated("links")),
        ("assessment_questions", has("structured"), stated("assessment")),
        ("answers", has("structured") & F.coalesce(f["answers_apply"], F.lit(True)), F.when(f["answer_share"] >= ANSWERS_FROM, "VERIFIED").otherwise("UNVERIFIED")),
        ("behavior", F.coalesce(f["kind"], F.lit("")).rlike(BEHAVING_TYPE) | has("behaves"), stated("behavior")),
        ("runtime", has("runs"), stated("runtime")),
    )
    return F.array(*(F.struct(F.lit(name).alias("dimension"), need.alias("required"), F.when(need, status).otherwise("NOT_APPLICABLE").alias("status")) for name, need, status in table))


def dimension_gate(verdict: Column, dimensions: Column) -> Column:
    """struct(verdict, failed, unverified): a good verdict gives way to what its required dimensions show."""
    names = lambda kept: F.transform(kept, lambda d: d["dimension"])
    fails = lambda d: d["required"] & d["status"].rlike(FAILING)
    failed = F.filter(dimensions, fails)
    unsure = F.filter(dimensions, lambda d: d["required"] & ~fails(d) & ~d["status"].isin(*SETTLED))
    mutated = F.exists(failed, lambda d: (d["dimension"] == "behavior") & (d["status"] == "MUTATED"))
    lowered = F.when(F.size(failed) > 0, F.when(mutated, "BEHAVIOR_MUTATION").otherwise("PARTIAL")).when(F.size(unsure) > 0, "UNVERIFIED")
    after = F.when(verdict.isin(*GOOD_VERDICTS), F.coalesce(lowered, verdict)).otherwise(verdict)
    return F.struct(after.alias("verdict"), names(failed).alias("failed"), names(unsure).alias("unverified"))


def snapshot_stage(courses: DataFrame, items: DataFrame, course: str) -> DataFrame:
    """courses(course, requested, report) with (observed, published, mode, stage, confidence): what was asked for goes
    first; otherwise the share of published items(course, published) tells, from three observed ones on."""
    counts = items.where("published is not null").groupBy(course).agg(F.count("*").alias("observed"), F.count_if("published").alias("live"))
    rows = courses.join(counts, course, "left").withColumns({"observed": F.coalesce("observed", F.lit(0)), "live": F.coalesce("live", F.lit(0))})
    asked = F.lit("auto")
    for name, spellings in REQUESTS:
        asked = F.when(F.lower("requested").isin(*spellings), name).otherwise(asked)
    auto, enough = F.col("asked") == "auto", F.col("observed") >= STAGE_FROM
    raw_seen = F.coalesce("report", F.lit(False)) & enough & (F.col("live") == 0) & ((F.col("observed") - F.col("live")) / F.col("observed") >= RAW_SHARE)
    live_seen = enough & (F.col("live") / F.col("observed") >= PUBLISHED_SHARE)
    raw = (F.col("asked") == "raw") | (auto & raw_seen)
    stage = F.when(raw, "RAW_UNPUBLISHED").when((F.col("asked") == "published") | (auto & live_seen), "PUBLISHED").otherwise("OPS_PREPARED_UNPUBLISHED")
    sure = F.when(~auto, 1.0).when(raw_seen, 0.97).when(live_seen, 0.94).otherwise(0.72)
    rows = rows.withColumn("asked", asked)
    return rows.select(course, "asked", "observed", F.col("live").alias("published"), F.when(raw, "RAW_INGESTION").otherwise("OPS_CURRENT").alias("mode"), stage.alias("stage"), sure.alias("confidence"))


def proven_loss(issues: Column, split: Column, coverage: Column) -> Column:
    """Whether issues prove that content was lost. ``split`` is struct(payload, text), the shares observed of an item
    that became several, else null: what was seen of too few of its parts proves nothing."""
    has = lambda *codes: F.arrays_overlap(F.coalesce(issues, F.array().cast("array<string>")), F.array(*map(F.lit, codes)))
    seen = lambda share, least: split.isNull() | (F.coalesce(split[share], F.lit(0.0)) >= least)
    return (
        F.when(has(*NO_LOSS), False)
        .when(has(*SURE_LOSS), True)
        .when(has("MISSING_ASSET"), seen("payload", SPLIT_PAYLOAD))
        .when(has("CONTENT_CHANGED"), seen("text", SPLIT_TEXT) & (F.coalesce(coverage, F.lit(0)) >= COVERED))
        .otherwise(False)
    )


def readiness_recommendation(code: Column, repairs: Column, critical: Column, review: Column, gaps: Column) -> Column:
    """A recommendation after the findings of the target: repairs by hand hold back KEEP and REVIEW, others only KEEP."""
    some = lambda c: F.coalesce(c, F.lit(0)) > 0
    by_hand = some(repairs) & code.isin("KEEP", "REVIEW")
    return F.when(by_hand, "MANUAL_REMEDIATION").when((some(critical) | some(review) | some(gaps)) & (code == "KEEP"), "REVIEW").otherwise(code)


def open_findings(findings: DataFrame, actions: DataFrame, course: str) -> DataFrame:
    """findings(course, code, item, severity, exempt) that count and that no action(course, code, item) stands for; a
    finding without an item is met by any action of its code. Two joins on keys that are unique in the actions."""
    counting = findings.where(~F.coalesce("exempt", F.lit(False)) & F.col("severity").isin("CRITICAL", "REVIEW", "EVIDENCE"))
    by_item = actions.where("item is not null").select(course, "code", "item").distinct()
    by_code = actions.select(course, "code").distinct()
    named = counting.where("item is not null").join(by_item, [course, "code", "item"], "left_anti")
    general = counting.where("item is null").join(by_code, [course, "code"], "left_anti")
    return named.unionByName(general)


def headline(open_rows: DataFrame, course: str) -> DataFrame:
    """(course, critical, review, evidence, status) of open findings."""
    count = lambda s: F.count_if(F.col("severity") == s)
    rows = open_rows.groupBy(course).agg(count("CRITICAL").alias("critical"), count("REVIEW").alias("review"), count("EVIDENCE").alias("evidence"))
    return rows.withColumn("status", F.when(F.col("critical") > 0, "BLOCKED").otherwise("REVIEW"))


def media_presence(refs: DataFrame, entries: DataFrame) -> DataFrame:
    """refs(package, file, ref) with (path, status, candidates): at its place, elsewhere in its package under the same
    name, or not there. References with a scheme, a host or nothing before ``#`` are external. Entries(package, path)
    are counted by path and by name, so a name that stands everywhere is one row."""
    bare = F.regexp_replace(F.trim(F.coalesce("ref", F.lit(""))), "[?#].*$", "")
    outside = (bare == "") | bare.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:|//)")
    folder = F.regexp_replace("file", "[^/]*$", "")
    path = F.when(~outside, F.nullif(normal_zip_path(F.concat(folder, url_decoded(bare))), F.lit("")))
    name = lambda c: F.substring_index(F.lower(c), "/", -1)
    known = entries.select("package", F.lower("path").alias("at")).distinct()
    names = known.groupBy("package", name(F.col("at")).alias("name")).agg(F.count("*").alias("same"))
    rows = refs.withColumn("path", path).withColumns({"at": F.lower("path"), "name": name(F.col("path"))})
    rows = rows.join(known.withColumn("here", F.lit(True)), ["package", "at"], "left").join(names, ["package", "name"], "left")
    status = F.when(F.col("path").isNull(), "EXTERNAL_OR_EMBEDDED").when(F.col("here"), "PRESENT_AT_REFERENCE").when(F.col("same") > 0, "PRESENT_DIFFERENT_PATH").otherwise("NOT_IN_PACKAGE")
    return rows.select("package", "file", "ref", "path", status.alias("status"), F.when(F.col("here"), 1).otherwise(F.coalesce("same", F.lit(0))).cast("long").alias("candidates"))


def with_lineage_repairs(audits: DataFrame, repairs: DataFrame) -> DataFrame:
    """audits(id, generation) with the generation of the last repair(run_id, to_generation, position) of their run."""
    last = repairs.where("to_generation is not null").groupBy(F.col("run_id").alias("id")).agg(F.max_by("to_generation", "position").alias("_to"))
    rows = audits.join(last, "id", "left")
    return rows.withColumns({"generation": F.coalesce("_to", "generation"), "repaired": F.col("_to").isNotNull()}).drop("_to")


def deliverable_members(deliverables: DataFrame, course: str) -> DataFrame:
    """(course, item, deliverable, revision, member, state) of the newest revision of each deliverables(course,
    deliverable, revision, position, members); of equal revisions the first counts, of an item's entries too."""
    newest = deliverables.where("members is not null").groupBy(course, "deliverable").agg(F.max_by(F.struct("revision", "members"), F.struct("revision", -F.col("position"))).alias("last"))
    rows = newest.select(course, "deliverable", "last.revision", F.posexplode("last.members").alias("place", "m"))
    one = rows.groupBy(course, "deliverable", "revision", F.col("m.item").alias("item")).agg(F.min_by("m", "place").alias("m"))
    state = F.when(F.col("m.action") == "omit", "removed").otherwise("included")
    return one.select(course, "item", "deliverable", "revision", F.col("m.member").alias("member"), state.alias("state"))


def declared_changes(events: DataFrame, course: str) -> DataFrame:
    """(course, platform, declarations, latest) of events(course, platform, event, decision, recorded_at, observed_at,
    position) that declare a change; the latest by the later of its times, then by position."""
    changed = events.where("decision = 'changed'")
    return changed.groupBy(course, "platform").agg(F.count("*").alias("declarations"), F.max_by("event", F.struct(F.greatest("recorded_at", "observed_at"), "position")).alias("latest"))


def interaction_key(name: Column) -> Column:
    """Words of a name that tell it from other interactions, in order."""
    return F.array_join(F.filter(words(name), lambda w: ~w.isin(*INTERACTION_WORDS)), " ")


def lifecycle_key(source_id: Column, name: Column, path: Column) -> Column:
    """Key under which a result meets itself in another snapshot: its id, or its name and path in normal form."""
    return F.when(F.coalesce(source_id, F.lit("")) != "", F.concat(F.lit("id:"), source_id)).otherwise(F.concat(F.lit("name:"), clean_name(name), F.lit("|path:"), clean_name(path)))
