"""What of an item's files and links turned up elsewhere: recovery rolled up for each source item, and a chain of weaker evidence.

Carriers are reduced to the two smallest of each (key, hash) before anything is joined: one may be the item that the source
is matched with, which is not elsewhere. So a file that stands in every item costs a source one row for each of its hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.functions.files import canonical_asset_name
from veriframe.functions.text import clean_name

# What a text elsewhere needs to be the source's.
NEAR_PATH, NEAR_TEXT, READING_COVERAGE = 0.62, 0.82, 0.86


def _carriers(carried: DataFrame, key: Column) -> DataFrame:
    """(course, kind, k, sha, low, other): the two smallest items that carry a key with a hash."""
    rows = carried.select("course", "kind", key.alias("k"), F.lower("sha256").alias("sha"), "item_id").where("k != ''").distinct()
    keys = ["course", "kind", "k", "sha"]
    two = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("item_id"))).where("place <= 2")
    return two.groupBy(*keys).agg(F.min("item_id").alias("low"), F.max(F.when(F.col("place") == 2, F.col("item_id"))).alias("other"))


def payload_recovery(expected: DataFrame, carried: DataFrame, matched: DataFrame, inferred: DataFrame) -> DataFrame:
    """One row for each source with something to recover: expected(course, source_id, kind, key, name, sha256, reference_only, present), carried(course,
    item_id, kind, key, name, sha256), matched(course, source_id, item_id), inferred(course, source_id, item_id).

    A file is found where its key is carried without another hash, a link by its key. References that are no files of the package are not expected. An
    inferred carrier counts only where nothing was found and no file of the same name has another hash; it proves no recovery."""
    ids = ["course", "source_id"]
    real = expected.where(~F.coalesce("reference_only", F.lit(False)) & F.coalesce("present", F.lit(True)))
    real = real.select(*ids, "kind", "key", "name", F.lower("sha256").alias("own")).distinct().join(matched.withColumnRenamed("item_id", "not_here"), ids, "left")
    elsewhere = F.when(F.col("not_here").isNull() | (F.col("low") != F.col("not_here")), F.col("low")).otherwise(F.col("other"))

    by_key = _carriers(carried, F.col("key"))
    met = real.join(by_key.withColumnRenamed("k", "key"), ["course", "kind", "key"], "left").withColumn("carrier", elsewhere)
    fits = (F.col("kind") == "link") | F.col("own").isNull() | F.col("sha").isNull() | (F.col("own") == F.col("sha"))
    found = met.groupBy(*ids, "kind", "key", "name", "own").agg(F.min(F.when(fits, F.col("carrier"))).alias("carrier"))

    by_name = _carriers(carried.where("kind = 'asset'"), clean_name(canonical_asset_name("name"))).select("course", "k", "sha", "low", "other")
    named = real.where("kind = 'asset' and own is not null").withColumn("k", clean_name(canonical_asset_name("name")))
    same_key = met.where("kind = 'asset' and own is not null and sha is not null").select(*ids, "own", "sha", "carrier")
    same_name = named.join(by_name, ["course", "k"]).withColumn("carrier", elsewhere).select(*ids, "own", "sha", "carrier")
    conflicts = same_key.unionByName(same_name).where("carrier is not null and sha != own").select(*ids).distinct().withColumn("conflict", F.lit(True))

    held = found.groupBy(*ids).agg(F.count("*").alias("expected"), F.count("carrier").alias("found"), F.min("carrier").alias("first_carrier"), F.count_distinct("carrier").alias("carriers"))
    guess = inferred.groupBy(*ids).agg(F.min("item_id").alias("guess"))
    rows = held.join(guess, ids, "full").join(conflicts, ids, "left").na.fill(0, ["expected", "found", "carriers"]).withColumn("conflict", F.coalesce("conflict", F.lit(False)))
    derived = (F.col("found") == 0) & ~F.col("conflict") & F.col("guess").isNotNull()
    total = F.when(F.col("expected") > 0, F.col("expected")).otherwise(derived.cast("long"))
    recovered = F.col("found") + derived.cast("long")
    return rows.select(
        *ids, total.alias("expected"), recovered.alias("recovered"), F.round(F.when(total > 0, F.least(F.lit(1.0), recovered / total)).otherwise(0.0), 9).alias("ratio"), (F.col("carriers") + derived.cast("long")).alias("carriers"),
        F.coalesce("first_carrier", F.when(derived, F.col("guess"))).alias("first_carrier"), "conflict", derived.alias("inferred"), ((F.col("expected") > 0) & (F.col("found") == F.col("expected"))).alias("complete"),
    )


def repackaged_texts(pairs: DataFrame) -> DataFrame:
    """(course, source_id, item_id, score, basis) of pairs(course, source_id, item_id, same_type, reading, path_score, status, score, coverage): the best text of
    the same type in a fitting place that is verified; else, for readings, the only one that covers the source. The smaller id of equals."""
    near = F.coalesce((F.col("path_score") >= NEAR_PATH) & F.col("same_type") & (F.col("status") == "VERIFIED") & (F.col("score") >= NEAR_TEXT), F.lit(False))
    covers = F.coalesce(F.col("reading") & (F.col("coverage") >= READING_COVERAGE), F.lit(False))
    best = pairs.groupBy("course", "source_id").agg(
        F.min(F.when(near, F.struct((-F.col("score")).alias("order"), "item_id", "score"))).alias("near"), F.count_if(covers).alias("n"), F.min(F.when(covers, F.struct("item_id", F.col("coverage").alias("score")))).alias("only"),
    )
    only = F.when(F.col("n") == 1, F.col("only"))
    chosen = best.withColumn("basis", F.when(F.col("near").isNotNull(), "TEXT").when(only.isNotNull(), "ONLY_READING")).where("basis is not null")
    return chosen.select("course", "source_id", F.coalesce("near.item_id", "only.item_id").alias("item_id"), F.coalesce("near.score", "only.score").alias("score"), "basis")


def recovered_by(sources: DataFrame, payload: DataFrame, texts: DataFrame, structures: DataFrame) -> DataFrame:
    """(course, source_id, item_id, basis): where each source is to be looked for: by files and links that were found, else by its text, else
    by its structure(course, source_id, item_id), else nowhere."""
    ids = ["course", "source_id"]
    rows = sources.select(*ids).distinct()
    rows = rows.join(payload.where("recovered > 0").select(*ids, F.col("first_carrier").alias("p"), "inferred"), ids, "left").join(texts.select(*ids, F.col("item_id").alias("t")), ids, "left")
    rows = rows.join(structures.groupBy(*ids).agg(F.min("item_id").alias("s")), ids, "left")
    basis = F.when(F.col("p").isNotNull(), F.when(F.col("inferred"), "TITLE").otherwise("PAYLOAD")).when(F.col("t").isNotNull(), "TEXT").when(F.col("s").isNotNull(), "STRUCTURE").otherwise("NONE")
    return rows.select(*ids, F.coalesce("p", "t", "s").alias("item_id"), basis.alias("basis"))
