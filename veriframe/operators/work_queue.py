"""Work queue: planner slots resolved against catalog, packages, runtimes and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolved_candidates(slots: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each slot(slot_id, key, owner) with a status: NONE, ONE, OWNER (one candidate of the slot's owner), COMPLETE
    (one complete candidate) or AMBIGUOUS, and the catalog_id where it is settled. Counts, not candidate lists,
    are joined, so a key with many candidates costs one row."""
    mine = F.col("c_owner") == F.col("owner")
    keyed = catalog.select("key", "catalog_id", F.col("owner").alias("c_owner"), "complete")
    by_key = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("catalog_id").alias("any_id"), F.count_if("complete").alias("n_complete"), F.min(F.when(F.col("complete"), F.col("catalog_id"))).alias("complete_id"))
    by_owner = keyed.groupBy("key", F.col("c_owner").alias("owner")).agg(F.count("*").alias("n_owner"), F.min("catalog_id").alias("owner_id"))
    rows = slots.join(by_key, "key", "left").join(by_owner, ["key", "owner"], "left")
    status = (
        F.when(F.col("n").isNull(), "NONE")
        .when(F.col("n") == 1, "ONE")
        .when(F.col("n_owner") == 1, "OWNER")
        .when(F.col("n_complete") == 1, "COMPLETE")
        .otherwise("AMBIGUOUS")
    )
    settled = F.when(status == "ONE", F.col("any_id")).when(status == "OWNER", F.col("owner_id")).when(status == "COMPLETE", F.col("complete_id"))
    return rows.select(*slots.columns, status.alias("catalog_status"), settled.alias("catalog_id"))


def next_action(status: Column, has_source: Column, audits: Column, latest: Column) -> Column:
    """First open step of a slot, in order of precedence."""
    return (
        F.when(status == "AMBIGUOUS", "RESOLVE_CATALOG")
        .when(status == "NONE", "ADD_TO_CATALOG")
        .when(~has_source, "UPLOAD_SOURCE")
        .when(F.coalesce(audits, F.lit(0)) == 0, "AUDIT")
        .when(latest == "F", "RESOLVE_BLOCKER")
        .when(latest == "P", "REVIEW")
        .otherwise("DONE")
    )


def build_queue(slots: DataFrame, catalog: DataFrame, sources: DataFrame, audits: DataFrame) -> DataFrame:
    """slots ⟕ catalog ⟕ sources(catalog_id) ⟕ latest audit(catalog_id, audited_at, audit_id, status) with the next
    action. Each join is on a key that is unique on its right side."""
    rows = resolved_candidates(slots, catalog)
    seen = sources.groupBy("catalog_id").agg(F.count("*").alias("sources"))
    last = audits.groupBy("catalog_id").agg(F.count("*").alias("audits"), F.max_by("status", F.struct("audited_at", "audit_id")).alias("latest"))
    joined = rows.join(seen, "catalog_id", "left").join(last, "catalog_id", "left")
    return joined.withColumn("action", next_action(F.col("catalog_status"), F.col("sources").isNotNull(), F.col("audits"), F.col("latest")))


def known_codes(texts: DataFrame, keys: DataFrame, text_column: str, pattern: str) -> DataFrame:
    """Codes found in texts that are keys too, first place first: (id, code, place)."""
    found = texts.select("id", F.posexplode(F.regexp_extract_all(text_column, F.lit(pattern), 0)).alias("place", "code"))
    return found.join(keys.select("code").distinct(), "code", "left_semi").groupBy("id", "code").agg(F.min("place").cast("long").alias("place"))
