"""Counters, indexes and ordered verdicts over results and inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the workload index.
INDEX_WEIGHTS = {"lti": 10.0, "empty": 5.0, "unknown": 3.0, "assessments": 2.0, "discussions": 1.5, "weblinks": 1.0, "webcontent": 0.5}


def workload_index(counts: DataFrame) -> DataFrame:
    """``counts`` (one column per kind) with total_items, ifs, ifs_per_item and is_boilerplate. Nothing at all, or a
    handful of items without content, counts as 100."""
    count = lambda c: F.greatest(F.lit(0), F.coalesce(F.floor(F.col(c)), F.lit(0)))
    total = sum((count(c) for c in ("webcontent", "assessments", "discussions", "weblinks", "lti")), count("unknown"))
    weighted = sum((count(c) * w for c, w in INDEX_WEIGHTS.items()), F.lit(0.0))
    thin = (total > 0) & (total <= 5) & (count("assessments") == 0) & (count("webcontent") == 0)
    out = counts.withColumns({"total_items": total, "is_boilerplate": thin})
    out = out.withColumn("ifs", F.when((F.col("total_items") == 0) | F.col("is_boilerplate"), 100.0).otherwise(weighted))
    return out.withColumn("ifs_per_item", F.when(F.col("total_items") > 0, F.round(F.col("ifs") / F.col("total_items"), 2)).otherwise(100.0))


def labour_hours(ifs: Column, items: Column, lti: Column, empty: Column) -> Column:
    """Estimated hours of a package: a two-unit rectified layer over its counts, at least one hour."""
    # fixed values: weights and biases of the two units and of their sum
    first = F.greatest(F.lit(0.0), ifs * 0.05 + items * 0.02 + lti * 1.5 + empty * 0.8 + 0.5)
    second = F.greatest(F.lit(0.0), ifs * 0.01 + items * 0.05 + lti * 0.2 + empty * 0.1 + 0.1)
    return F.greatest(F.lit(1).cast("long"), F.floor(first * 0.85 + second * 0.3 + 1.2 + 0.5))


def preflight(counts: DataFrame) -> DataFrame:
    """BLOCKED without items, with empty core folders or more than 50 LTI items."""
    blocked = (F.col("total_items") == 0) | (F.col("core_empty") > 0) | (F.col("lti") > 50)
    return counts.withColumn("verdict", F.when(blocked, "BLOCKED").otherwise("CLEARED TO INGEST"))


def imbalance(counts: DataFrame, value: str) -> DataFrame:
    """``counts`` with the z-score of ``value`` over all rows (population deviation, 1 where it is 0). The two
    moments are one aggregate of one row, joined back."""
    moments = counts.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    sd = F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))
    return counts.join(F.broadcast(moments)).withColumn("z", (F.col(value) - F.col("mean")) / sd).drop("mean", "sd")


def fidelity_summary(results: DataFrame, *keys: str) -> DataFrame:
    """Counts by verdict, fidelity and coverage of results(verdict, earned, possible, coverage). Points that are not
    observed are left out on both sides, and a summary without possible points has no fidelity."""
    known = F.col("earned").isNotNull() & F.col("possible").isNotNull()
    earned, possible = F.sum(F.when(known, F.col("earned"))), F.sum(F.when(known, F.col("possible")))
    count = lambda *v: F.count_if(F.col("verdict").isin(*v))
    return results.groupBy(*keys).agg(
        F.count("*").alias("items"), count("VERIFIED").alias("verified"), count("DRIFT").alias("drift"), count("CHANGED").alias("changed"),
        count("MISSING").alias("missing"), count("UNVERIFIED").alias("unverified"),
        F.when(possible > 0, F.round(earned / possible * 100, 6)).alias("fidelity"), F.round(F.avg("coverage"), 6).alias("coverage"),
    ).withColumn(
        "headline",
        F.when(F.col("missing") > 0, "BLOCKED").when((F.col("unverified") > 0) | (F.col("drift") > 0) | (F.col("items") == 0), "REVIEW").otherwise("NO_BLOCKERS_OBSERVED"),
    )


def text_verdict(source_length: Column, target_length: Column, completeness: Column, lexical: Column, ngram: Column) -> Column:
    """Verdict on a pair of texts: the first rung that holds. What was not captured well enough is UNVERIFIED, never
    CHANGED."""
    similarity = lexical * 0.58 + ngram * 0.42
    ratio = F.least(source_length, target_length) / F.greatest(source_length, target_length, F.lit(1))
    return (
        F.when(source_length < 80, "NOT_APPLICABLE")
        .when(target_length < 40, "UNVERIFIED")
        .when(F.coalesce(completeness, F.lit(0.0)) < 0.75, "UNVERIFIED")
        .when((similarity >= 0.74) & ((ratio >= 0.55) | (similarity >= 0.90)), "VERIFIED")
        .when((similarity >= 0.46) & (ratio >= 0.30), "DRIFT")
        .when(ratio < 0.30, "UNVERIFIED")
        .when((completeness >= 0.85) & (lexical < 0.22) & (ngram < 0.30), "CHANGED")
        .otherwise("UNVERIFIED")
    )


def coherence(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Overlap of the ids of two snapshots: sizes, both, and their share of the smaller."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    sizes = a.agg(F.count("*").alias("left_ids")).join(b.agg(F.count("*").alias("right_ids"))).join(a.join(b, key, "left_semi").agg(F.count("*").alias("both")))
    return sizes.withColumn("share", F.when(F.least("left_ids", "right_ids") > 0, F.round(F.col("both") / F.least("left_ids", "right_ids"), 9)))


def minutes(c: Column) -> Column:
    """Tolerant minutes in [0, 1e6], else null."""
    value = F.trim(c.cast("string")).try_cast("double")
    return F.when((value >= 0) & (value <= 1_000_000), value)


def minutes_text(c: Column) -> Column:
    whole = F.floor(c + 0.5)
    hours, rest = F.floor(whole / 60), whole % 60
    return (
        F.when(c.isNull(), "not observed")
        .when(hours == 0, F.concat(rest.cast("string"), F.lit(" min")))
        .when(rest == 0, F.concat(hours.cast("string"), F.lit(" h")))
        .otherwise(F.concat(hours.cast("string"), F.lit(" h "), rest.cast("string"), F.lit(" min")))
    )


def count_text(c: Column) -> Column:
    """Count of a tolerant cell: blank, n/a, no and none are 0, other words 1."""
    t = F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    number = t.try_cast("double")
    return F.when(t.isin("", "n/a", "na", "no", "none", "-"), 0).when(number.isNotNull(), F.greatest(F.lit(0), F.floor(number))).otherwise(1).cast("long")


def excel_date(c: Column) -> Column:
    """Date of a spreadsheet serial number or an ISO text; null for anything else."""
    t = F.trim(c.cast("string"))
    serial = t.try_cast("double")
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))
    return F.coalesce(F.when((serial >= 1) & (serial < 2958466), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(serial).cast("int"))), iso)


def top_rows(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
