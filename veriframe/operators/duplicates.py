"""Duplicate packages: groups of records that are one package under different file names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.functions import files, text


def _comparable(field: str) -> Column:
    value = F.trim(F.col(field).cast("string"))
    return F.when(value != "", F.lower(value))


def keyed_records(records: DataFrame) -> DataFrame:
    """``records`` (id, partner, file_name, updated_at, scanned_at, ...) with their group keys."""
    return records.select(
        "*",
        text.clean_name("partner").alias("partner_key"),
        files.semantic_key("file_name").alias("semantic_key"),
        (files.normal_file_name("file_name") == F.lower(files.display_file_name("file_name"))).alias("unsuffixed"),
    ).where((F.col("partner_key") != "") & (F.col("semantic_key") != ""))


def duplicate_plan(records: DataFrame, metadata: Sequence[str]) -> DataFrame:
    """One row per group of two or more: the survivor (earliest, unsuffixed names first), the latest scan, the
    metadata fields on which the group disagrees and whether it can be merged. Blank values are not observed,
    so they never disagree. One shuffle: all parts are partial aggregates."""
    order = F.struct((~F.col("unsuffixed")).alias("late"), F.col("updated_at"), F.col("id"))
    newest = F.struct(F.coalesce("scanned_at", "updated_at"), F.col("id"))
    differing = [F.when(F.min(_comparable(f)) != F.max(_comparable(f)), f) for f in metadata]
    plan = keyed_records(records).groupBy("partner_key", "semantic_key").agg(
        F.count("*").alias("members"),
        F.min_by("id", order).alias("survivor"),
        F.min_by(files.display_file_name("file_name"), order).alias("canonical_name"),
        F.max_by("id", newest).alias("latest_scan"),
        F.array_join(F.array_compact(F.array(*differing)), ",").alias("conflicts"),
    )
    return plan.where("members > 1").withColumn("safe_to_merge", F.col("conflicts") == "")


def merged_survivors(records: DataFrame, metadata: Sequence[str]) -> DataFrame:
    """Survivors of mergeable groups; a blank field takes the first value that the group has, survivor first."""
    plan = duplicate_plan(records, metadata).where("safe_to_merge").select("partner_key", "semantic_key", "survivor")
    rows = keyed_records(records).join(plan, ["partner_key", "semantic_key"])
    order = F.struct(F.col("id") != F.col("survivor"), F.col("updated_at"), F.col("id"))
    filled = [F.min(F.when(_comparable(f).isNotNull(), F.struct(order, F.col(f).alias("value"))))["value"].alias(f) for f in metadata]
    return rows.groupBy("partner_key", "semantic_key", "survivor").agg(*filled, (F.count("*") - 1).alias("archived"))


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    place = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")
