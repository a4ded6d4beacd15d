"""What of a course counts: areas kept for reference, owners' decisions, extra items of a target, times, identities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions.text import clean_text, let

# Areas that are kept for reference, and what names of extra items say, asked in this order.
REFERENCE_AREA = r"(?i)^(?:instructor resources?|instruction(?:al)? resources?|archives?)$"
EXTRA_NAMES = (
    ("ADMIN_EXTRA", "INFO", r"author alignment|author.?s eyes|delete me|archive|instructor only"),
    ("PLACEHOLDER_EXTRA", "REVIEW", r"\[empty\]|empty|placeholder|new reading|untitled|supporting content"),
    ("TEMPLATE_EXTRA", "INFO", r"course-specific resources|summative assessment resources|student resources"),
)
NO_CONTENT = ("ADMIN_EXTRA", "TEMPLATE_EXTRA", "PLACEHOLDER_EXTRA")
INFORMATIONAL = ("ADMIN_EXTRA", "TEMPLATE_EXTRA", "CONSOLIDATION_CARRIER", "SOURCE_ASSET_CARRIER")
AGGREGATE_ID = "^cti-aggregate:"
SHA = "^[a-f0-9]{64}$"
EMPTY_FROM, NEAR_EMPTY_FROM = 5, 10


def path_segments(path: Column) -> Column:
    return F.split(F.coalesce(path, F.lit("")), r"\s*[>|/]\s*")


def path_root(path: Column) -> Column:
    """First segment of a path in lower case; empty for none."""
    parts = F.filter(path_segments(F.replace(F.trim(F.coalesce(path, F.lit(""))), F.lit("\\"), F.lit("/"))), lambda p: p != "")
    return F.lower(F.trim(F.coalesce(F.get(parts, 0), F.trim(F.coalesce(path, F.lit(""))))))


def is_reference_area(path: Column) -> Column:
    """A folder of the path, whichever, is an instructor's area or an archive."""
    return F.exists(path_segments(path), lambda p: F.trim(p).rlike(REFERENCE_AREA))


def owner_scope(path: Column, source_only: Column, source_paths: Column, relevance: Column) -> Column:
    """struct(included, why): an owner's choice goes first; then a reference area leaves an item out, and for an item
    that only the source has, sources that all lie in one."""
    sources = source_only & (F.size(source_paths) > 0) & F.forall(source_paths, is_reference_area)
    left_out = is_reference_area(path) | F.coalesce(sources, F.lit(False))
    why = F.when(relevance == "relevant", "OWNER_IN").when(relevance == "not_relevant", "OWNER_OUT").when(left_out, "REFERENCE_AREA").otherwise("DEFAULT")
    return F.struct(why.isin("OWNER_IN", "DEFAULT").alias("included"), why.alias("why"))


def needs_action(included: Column, verified: Column, actions: Column) -> Column:
    """In scope, and not verified or with an action that is not NONE."""
    return included & (~F.coalesce(verified, F.lit(False)) | F.exists(F.coalesce(actions, F.array().cast("array<string>")), lambda a: a != "NONE"))


def in_decision_gate(path: Column, exempt_roots: Sequence[str]) -> Column:
    """False below one of ``exempt_roots`` (lower case), the areas of a partner that don't count for a decision."""
    plain = F.replace(F.lower(F.trim(F.coalesce(path, F.lit("")))), F.lit("\\"), F.lit("/"))
    below = lambda root: (path_root(path) == root) | (plain == root) | plain.rlike(f"^{root}(?::| >|/|\\|)")
    out = F.lit(True)
    for root in exempt_roots:
        out = out & ~below(root)
    return out


def extra_class(name: Column, path: Column, failed: Column, provenance: Column, carried: Column) -> Column:
    """struct(class, severity) of an item that no source item is bound to: a failure first, then what it carries of
    the source (``provenance`` PARTIAL or FULL, ``carried`` names of source items), then what its name and path say."""
    said = F.lower(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(path, F.lit(""))))
    kind = lambda c, severity: F.struct(F.lit(c).alias("class"), F.lit(severity).alias("severity"))
    out = (
        F.when(F.coalesce(failed, F.lit(False)), kind("INGESTION_FAILURE_EXTRA", "CRITICAL"))
        .when(provenance == "PARTIAL", kind("PARTIAL_SOURCE_ASSET_CARRIER", "REVIEW"))
        .when(provenance == "FULL", kind("SOURCE_ASSET_CARRIER", "REVIEW"))
        .when(F.size(F.filter(carried, lambda c: c != "")) > 0, kind("CONSOLIDATION_CARRIER", "INFO"))
    )
    for c, severity, pattern in EXTRA_NAMES:
        out = out.when(said.rlike(pattern), kind(c, severity))
    return out.otherwise(kind("CONTENT_EXTRA", "REVIEW"))


def extra_policy(kind: Column, gate: Column) -> Column:
    """What an extra item means for the decision to ingest again."""
    informational = (kind["severity"] == "INFO") | kind["class"].isin(*INFORMATIONAL)
    return (
        F.when((kind["class"] == "INGESTION_FAILURE_EXTRA") & gate, "FORCE_REINGEST")
        .when(~gate, "POLICY_EXEMPT")
        .when(informational, "INFORMATIONAL")
        .otherwise("REVIEW")
    )


def course_failure(sources: DataFrame, targets: DataFrame, course: str) -> DataFrame:
    """(course, source_items, target_items, code): courses whose target has nothing, or next to nothing, of a source with
    substance. sources(course, counts boolean), targets(course, class, gate)."""
    mine = sources.groupBy(course).agg(F.count_if("counts").alias("source_items"))
    theirs = targets.groupBy(course).agg(F.count_if(~F.col("class").isin(*NO_CONTENT) & F.col("gate")).alias("target_items"))
    rows = mine.join(theirs, course, "left").withColumn("target_items", F.coalesce("target_items", F.lit(0)))
    code = F.when((F.col("source_items") >= EMPTY_FROM) & (F.col("target_items") == 0), "EMPTY").when((F.col("source_items") >= NEAR_EMPTY_FROM) & (F.col("target_items") <= 1), "NEAR_EMPTY").otherwise("")
    return rows.withColumn("code", code)


def task_times(baseline: Column, observed: Column) -> Column:
    """struct(latest, refreshed) of two structs (minutes, captured_at); the newer one stands even if its minutes are
    unknown, and an undated one counts as newer."""
    newer = observed.isNotNull() & F.coalesce(observed["captured_at"] >= baseline["captured_at"], F.lit(True))
    return F.struct(F.when(newer, observed["minutes"]).otherwise(baseline["minutes"]).alias("latest"), newer.alias("refreshed"))


def time_totals(tasks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """tasks (included, baseline and observed structs) by ``keys``: minutes and how many are observed or missing, at first
    and by now; excluded tasks are counted, not added."""
    rows = tasks.withColumn("_now", task_times(F.col("baseline"), F.col("observed")))
    first, now, counts = F.col("baseline.minutes"), F.col("_now.latest"), F.col("included")
    total = lambda c: F.coalesce(F.sum(F.when(counts, c)), F.lit(0))
    return rows.groupBy(*keys).agg(
        F.count_if(counts).alias("total"), F.count_if(~counts).alias("excluded"), total(first).alias("baseline_minutes"), F.count_if(counts & first.isNotNull()).alias("baseline_captured"),
        total(now).alias("latest_minutes"), F.count_if(counts & now.isNotNull()).alias("latest_captured"), F.count_if(counts & now.isNull()).alias("missing"), F.count_if(counts & F.col("_now.refreshed")).alias("refreshed"),
    )


# ---- identities


def item_id(*parts: Column) -> Column:
    """A stable id of several strings, null if one is missing: the hash of their JSON array."""
    text = F.to_json(F.array(*parts))
    missing = parts[0].isNull() | (parts[0] == "")
    for p in parts[1:]:
        missing = missing | p.isNull() | (p == "")
    return F.when(~missing, F.concat(F.lit("item-"), F.sha2(text, 256)))


def canonical_json(values: Column) -> Column:
    """JSON of a flat map with its keys in order, so that equal maps have equal texts."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(values))))


def identified(items: DataFrame, parts: Sequence[str]) -> DataFrame:
    """``items`` with item_id and whether several have it (``ambiguous``); counts are joined, not rows."""
    named = items.withColumn("item_id", item_id(*map(F.col, parts)))
    counts = named.where("item_id is not null").groupBy("item_id").agg((F.count("*") > 1).alias("ambiguous"))
    return named.join(counts, "item_id", "left").withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))


def physical_ids(items: DataFrame, key: str) -> DataFrame:
    """(key, id): distinct ids of items (id, children) that stand for something; an aggregate stands for its children."""
    trimmed = F.trim(F.coalesce("id", F.lit("")))
    ids = F.when(trimmed.rlike(AGGREGATE_ID), F.coalesce("children", F.array().cast("array<string>"))).otherwise(F.array(trimmed))
    rows = items.select(key, F.explode(ids).alias("id")).select(key, F.trim("id").alias("id"))
    return rows.where((F.col("id") != "") & ~F.col("id").rlike(AGGREGATE_ID)).distinct()


def obsolete_stage_guard(guards: DataFrame, baseline: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """(key, obsolete): guards(key, missing) that counted only made-up ids as missing. baseline and seen are items
    (key, id, children): all that the baseline stands for is seen, as many ids as the guard says are not, and all of
    those are aggregates with children."""
    need, have = physical_ids(baseline, key), physical_ids(seen, key).withColumn("there", F.lit(True))
    real = need.join(have, [key, "id"], "left").groupBy(key).agg(F.count_if(F.col("there").isNull()).alias("lost"))
    ids = baseline.select(key, F.trim("id").alias("id"), F.col("id").rlike(AGGREGATE_ID).alias("made"), (F.size(F.coalesce("children", F.array().cast("array<string>"))) > 0).alias("full")).where("id != ''").distinct()
    old = ids.join(have, [key, "id"], "left").groupBy(key).agg(
        F.count_if(F.col("there").isNull()).alias("gone"), F.count_if(F.col("there").isNull() & ~F.col("made")).alias("gone_real"), F.count_if("made").alias("made"), F.count_if(F.col("made") & ~F.col("full")).alias("hollow"),
    )
    rows = guards.join(real, key, "left").join(old, key, "left")
    yes = (F.col("lost") == 0) & (F.col("gone") == F.col("missing")) & (F.col("gone_real") == 0) & (F.col("made") > 0) & (F.col("hollow") == 0)
    return rows.select(key, F.coalesce(yes, F.lit(False)).alias("obsolete"))


def exact_replay(saved: Sequence[Column], incoming: Sequence[Column], late: Column) -> Column:
    """The same inputs as before: hashes that are hashes and equal, and no late recovery on either side."""
    out = ~F.coalesce(late, F.lit(False))
    for a, b in zip(saved, incoming, strict=True):
        a = F.lower(F.coalesce(a, F.lit("")))
        out = out & a.rlike(SHA) & (a == F.lower(F.coalesce(b, F.lit(""))))
    return out


# ---- values


def whole_number(c: Column) -> Column:
    """A number of any spelling as a whole one, at least 0; what is no number is 0."""
    number = c.try_cast("double")
    return F.coalesce(F.floor(F.greatest(F.lit(0.0), F.when(F.abs(number) < 9.0e15, number))), F.lit(0).cast("long"))


def unique_strings(values: Column, limit: int) -> Column:
    """The first ``limit`` distinct non-blank values, trimmed."""
    return F.slice(F.array_distinct(F.filter(F.transform(values, clean_text), lambda v: v != "")), 1, limit)


def one_of(value: Column, allowed: Sequence[str], default: str) -> Column:
    """``value`` if it is one of ``allowed``, ``default`` if it is missing, else an error."""
    v = F.coalesce(value, F.lit(default))
    return let(v, lambda x: F.when(x.isin(*allowed), x).otherwise(F.raise_error(F.concat(F.lit("not one of the states: "), x)).cast("string")))
