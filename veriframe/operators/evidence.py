"""Evidence from several captures: merging, gaps, gates and what an owner should do about a result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.functions import text

# Dimensions of a result that can be required.
DIMENSIONS = ("identity", "structure", "content", "assets", "links", "behavior", "assessment", "runtime")


def merged_evidence(evidence: DataFrame, key: str, fields: Sequence[str], priority: str) -> DataFrame:
    """One row per key: each field from the row of highest priority that observed it."""
    best = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(priority))).alias(f) for f in fields]
    return evidence.groupBy(key).agg(*best, F.count("*").alias("captures"))


def traversal(expected: DataFrame, visited: DataFrame, key: str, group: str) -> DataFrame:
    """(group, eligible, visited, complete) of expected(group, key) and visited(key); repeats count once."""
    seen = visited.select(key).distinct().withColumn("seen", F.lit(True))
    rows = expected.select(group, key).distinct().join(seen, key, "left")
    counts = rows.groupBy(group).agg(F.count("*").alias("eligible"), F.count("seen").alias("visited"))
    return counts.withColumn("complete", F.col("eligible") == F.col("visited"))


def with_traversal_gap(results: DataFrame, traversed: DataFrame, group: str) -> DataFrame:
    """``results`` (verdict) where MISSING counts only if the group was traversed completely; otherwise it is
    UNVERIFIED, for what was not visited was not seen to be absent."""
    known = traversed.select(group, "complete")
    gap = (F.col("verdict") == "MISSING") & ~F.coalesce("complete", F.lit(False))
    return results.join(known, group, "left").withColumn("demoted", gap).withColumn("verdict", F.when(gap, "UNVERIFIED").otherwise(F.col("verdict"))).drop("complete")


def recovered(base: DataFrame, late: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``base`` with fields it did not observe taken from a late capture; what it observed stays."""
    extra = late.select(key, *(F.col(f).alias(f"late_{f}") for f in fields))
    rows = base.join(extra, key, "left")
    filled = F.array_join(F.array_compact(F.array(*(F.when(F.col(f).isNull() & F.col(f"late_{f}").isNotNull(), F.lit(f)) for f in fields))), ",")
    rows = rows.withColumn("recovered", filled)
    return rows.withColumns({f: F.coalesce(f, f"late_{f}") for f in fields}).drop(*(f"late_{f}" for f in fields))


def gated_verdict(verdict: Column, required: Column, status: Column) -> Column:
    """A verdict after its required dimensions: ``required`` is an array of names, ``status`` a map from name to
    status. A failed one makes a good verdict PARTIAL, one that is not verified (or not there) UNVERIFIED."""
    states = F.transform(required, lambda d: F.coalesce(F.try_element_at(status, d), F.lit("UNVERIFIED")))
    good = verdict.isin("VERIFIED", "EXPECTED_TRANSFORMATION")
    return F.when(good & F.exists(states, lambda s: s == "FAILED"), "PARTIAL").when(good & F.exists(states, lambda s: s != "VERIFIED"), "UNVERIFIED").otherwise(verdict)


def strength(coverage: Column, fidelity: Column, hashes: Column, ambiguous: Column) -> Column:
    """struct(value, label) of how far a result can be trusted, 0 to 100."""
    raw = coverage * 0.7 + F.coalesce(fidelity, F.lit(0.0)) * 0.3 + F.least(hashes, F.lit(5)) * 2
    value = F.least(F.when(ambiguous, 60.0).otherwise(100.0), F.greatest(F.lit(0.0), raw))
    label = F.when(value >= 95, "DEFINITIVE").when(value >= 85, "STRONG").when(value >= 70, "MODERATE").otherwise("LIMITED")
    return F.struct(F.round(value, 6).alias("value"), label.alias("label"))


def owner_action(verdict: Column, issues: Column) -> Column:
    """struct(severity, action) for the first reason that applies. ``issues`` is an array of codes."""
    rungs = [
        (verdict == "INGESTION_FAILURE", "CRITICAL", "REINGEST"), (verdict == "MISSING", "CRITICAL", "RESTORE_ITEM"), (F.array_contains(issues, "MISSING_ASSET"), "HIGH", "RESTORE_ASSET"),
        (F.array_contains(issues, "CONTENT_CHANGED"), "HIGH", "REVIEW_CONTENT"), (verdict == "TYPE_MUTATION", "HIGH", "CONFIRM_TYPE"), (F.array_contains(issues, "LINK_NOT_OBSERVED"), "MEDIUM", "CHECK_LINKS"),
        (F.array_contains(issues, "CONTENT_DRIFT"), "MEDIUM", "REVIEW_CONTENT"), (verdict == "UNPUBLISHED", "LOW", "PUBLISH"), (verdict == "MOVED", "LOW", "CONFIRM_PLACE"), (verdict == "UNVERIFIED", "INFO", "CAPTURE_AGAIN"),
    ]
    action = lambda severity, code: F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("action"))
    out = F.when(rungs[0][0], action(*rungs[0][1:]))
    for when, *rest in rungs[1:]:
        out = out.when(when, action(*rest))
    return out.otherwise(action("NONE", "NONE"))


def question_identity(source: DataFrame, target: DataFrame) -> DataFrame:
    """Questions (id, prompt, options array) with equal normal prompt and options in order: EXACT where one stands
    against one, AMBIGUOUS where several do, NONE without a counterpart. Counts are joined, not candidates."""
    key = lambda df: df.select("id", F.sha2(F.concat_ws("\x01", text.clean_name("prompt"), F.transform("options", lambda o: text.clean_name(o))), 256).alias("key"))
    s, t = key(source), key(target)
    mine = s.groupBy("key").agg(F.count("*").alias("n"))
    theirs = t.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("target_id"))
    rows = s.join(mine, "key").join(theirs, "key", "left")
    kind = F.when(F.col("m").isNull(), "NONE").when((F.col("n") == 1) & (F.col("m") == 1), "EXACT").otherwise("AMBIGUOUS")
    return rows.select("id", kind.alias("kind"), F.when(kind == "EXACT", F.col("target_id")).alias("target_id"))


def merged_reviews(reviews: DataFrame, keys: Sequence[str], decided_at: str, decision: str) -> DataFrame:
    """Latest decision per key; CONFLICT where decisions of the same moment differ, for none of them is the latest."""
    last = Window.partitionBy(*keys)
    rows = reviews.withColumn("last", F.max(decided_at).over(last)).where(F.col(decided_at) == F.col("last"))
    return rows.groupBy(*keys).agg(F.when(F.count_distinct(decision) > 1, "CONFLICT").otherwise(F.min(decision)).alias(decision), F.max(decided_at).alias(decided_at))


def attempt_chain(attempts: DataFrame, course: str) -> DataFrame:
    """attempts(course, id, generation, base): highest generation per course and whether every attempt names the one
    before it as its base and follows it by one."""
    w = Window.partitionBy(course).orderBy("generation", "id")
    rows = attempts.withColumns({"before": F.lag("id").over(w), "prior": F.lag("generation").over(w)})
    broken = F.col("before").isNotNull() & (~F.col("base").eqNullSafe(F.col("before")) | (F.col("generation") != F.col("prior") + 1))
    return rows.groupBy(course).agg(F.max("generation").alias("generation"), F.max_by("id", F.struct("generation", "id")).alias("current"), F.count_if(broken).alias("breaks"))


def checked_rows(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all rules, the others with the names of those they break). A rule that is null is not kept."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))
    marked = rows.withColumn("problems", F.array_join(broken, ","))
    return marked.where("problems = ''").drop("problems"), marked.where("problems != ''")
