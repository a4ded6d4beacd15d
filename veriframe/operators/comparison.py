"""Fidelity of bound items: what of a source item's assets, links, text and settings its target has.

Evidence is counted in joins first (local, then relocated to another item, then missing or unresolved by how
well the target was observed), and scored in one projection afterwards. What was not observed lowers the
points that are possible, never those that were earned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions import files, text

# Points of the checks.
POINTS = {"structure": 30, "type": 15, "path": 10, "assets": 20, "links": 10, "content": 10, "published": 5}
LOCAL_SCORE, RELOCATED_SCORE = 0.78, 0.90


def asset_form(assets: DataFrame) -> DataFrame:
    """``assets`` (id, name, size, sha256) with what comparisons need; a hash that isn't 64 hex digits is none."""
    sha = F.lower(F.coalesce("sha256", F.lit("")))
    return assets.select("id", "name", files.asset_key("name").alias("key"), text.alnum("name").alias("plain"), files.extension(F.col("name")).alias("ext"), F.when(F.col("size") > 0, F.col("size")).alias("size"), F.when(sha.rlike("^[0-9a-f]{64}$"), sha).alias("sha"))


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.toDF(*(f"{prefix}{c}" for c in df.columns))


def _evidence() -> Column:
    ratio = F.least("e_size", "o_size") / F.greatest("e_size", "o_size")
    both = F.col("e_sha").isNotNull() & F.col("o_sha").isNotNull()
    ratio = F.when(F.col("e_size").isNotNull() & F.col("o_size").isNotNull(), ratio)
    return files.asset_method(
        both & (F.col("e_sha") == F.col("o_sha")), both & (F.col("e_sha") != F.col("o_sha")), F.lit(None).cast("double"), (F.col("e_key") != "") & (F.col("e_key") == F.col("o_key")),
        ratio, text.edit_similarity(F.col("e_plain"), F.col("o_plain")), (F.col("e_ext") != "") & (F.col("e_ext") == F.col("o_ext")),
    )


def asset_evidence(pairs: DataFrame, source_assets: DataFrame, target_assets: DataFrame) -> DataFrame:
    """(source_id, name, state, method, score, carrier): for each asset of pairs(source_id, target_id,
    asset_confidence) whether it is PRESENT in its target, RELOCATED to another item (by hash or key, a generic name
    only by hash), MISSING (the target's assets were well observed) or UNRESOLVED."""
    expected = _prefixed(asset_form(source_assets), "e_").withColumnRenamed("e_id", "source_id").join(pairs, "source_id")
    observed = _prefixed(asset_form(target_assets), "o_")
    local = expected.join(observed, F.col("target_id") == F.col("o_id")).withColumn("found", _evidence())
    best = local.groupBy("source_id", "e_name").agg(F.max(F.struct("found.score", "found.method")).alias("local"))
    rows = expected.join(best, ["source_id", "e_name"], "left")
    rows = rows.withColumn("here", F.coalesce(F.col("local.score") >= LOCAL_SCORE, F.lit(False)))
    by_sha = observed.where("o_sha is not null").groupBy("o_sha").agg(F.min("o_id").alias("sha_low"), F.max("o_id").alias("sha_high"))
    by_key = observed.where("o_key != ''").groupBy("o_key").agg(F.min("o_id").alias("key_low"), F.max("o_id").alias("key_high"), F.count_if(F.col("o_sha").isNotNull()).alias("hashed"))
    rows = rows.join(by_sha, F.col("e_sha") == F.col("o_sha"), "left").join(by_key, F.col("e_key") == F.col("o_key"), "left")
    other = lambda low, high: F.when(F.col(low) != F.col("target_id"), F.col(low)).when(F.col(high) != F.col("target_id"), F.col(high))
    named = (F.size(files.informative_tokens("e_name")) > 0) & ~(F.col("e_sha").isNotNull() & (F.col("hashed") > 0))
    carrier = F.coalesce(other("sha_low", "sha_high"), F.when(named, other("key_low", "key_high")))
    state = (
        F.when(F.col("here"), "PRESENT")
        .when(carrier.isNotNull(), "RELOCATED")
        .when(F.coalesce("asset_confidence", F.lit(0.0)) >= 0.80, "MISSING")
        .otherwise("UNRESOLVED")
    )
    return rows.select("source_id", F.col("e_name").alias("name"), state.alias("state"), F.col("local.method").alias("method"), F.round("local.score", 9).alias("score"), F.when(~F.col("here"), carrier).alias("carrier"))


def link_evidence(pairs: DataFrame, source_links: DataFrame, target_links: DataFrame) -> DataFrame:
    """(source_id, link, state): the same for normal addresses; links(id, link)."""
    expected = source_links.toDF("source_id", "link").distinct().join(pairs, "source_id")
    targets = target_links.toDF("target_id", "link").distinct()
    local = targets.withColumn("here", F.lit(True))
    anywhere = targets.groupBy("link").agg(F.min("target_id").alias("low"), F.max("target_id").alias("high"))
    rows = expected.join(local, ["target_id", "link"], "left").join(anywhere, "link", "left")
    state = (
        F.when(F.col("here"), "PRESENT")
        .when((F.col("low") != F.col("target_id")) | (F.col("high") != F.col("target_id")), "RELOCATED")
        .when(F.coalesce("link_confidence", F.lit(0.0)) >= 0.85, "MISSING")
        .otherwise("UNRESOLVED")
    )
    return rows.select("source_id", "link", state.alias("state"))


def state_counts(evidence: DataFrame, prefix: str) -> DataFrame:
    """Evidence rows by source item: how many of each state."""
    states = ("PRESENT", "RELOCATED", "MISSING", "UNRESOLVED")
    return evidence.groupBy("source_id").agg(F.count("*").alias(f"{prefix}_expected"), *(F.count_if(F.col("state") == s).alias(f"{prefix}_{s.lower()}") for s in states))


def item_fidelity(facts: DataFrame, raw_snapshot: bool = False) -> DataFrame:
    """facts (source_id, compatible, path_score, content, published, asset_* and link_* counts) with earned and possible
    points, fidelity, coverage, issues in the order of the checks, and the verdict."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    no = F.lit(None).cast("string")
    points = F.lit(0.0)
    possible = F.lit(float(POINTS["structure"] + POINTS["type"]))
    points = points + POINTS["structure"] + F.when(F.col("compatible"), POINTS["type"]).otherwise(0)
    path = F.col("path_score")
    possible = possible + F.when(path.isNotNull(), POINTS["path"]).otherwise(0)
    points = points + F.when(path >= 0.62, POINTS["path"]).when(path >= 0.40, POINTS["path"] / 2).otherwise(0)
    issues = [F.when(~F.col("compatible"), "TYPE_MUTATION"), F.when(path < 0.62, "MOVED_ITEM")]
    for kind, lost, moved in (("asset", "MISSING_ASSET", "ASSET_RELOCATED"), ("link", "LINK_NOT_OBSERVED", "LINK_RELOCATED")):
        full, all_ = POINTS[f"{kind}s"], n(f"{kind}_expected")
        share = lambda c, kind=kind, all_=all_: n(f"{kind}_{c}") / all_
        open_ = full * share("unresolved")
        # Where a fidelity is half a percent the last bit decides it: points are summed in the order of the statement.
        possible = F.when(all_ > 0, possible + full - open_ if kind == "asset" else possible + (full - open_)).otherwise(possible)
        points = points + F.when(all_ > 0, full * (share("present") + share("relocated") * 0.5)).otherwise(0.0)
        issues += [F.when(n(f"{kind}_relocated") > 0, moved), F.when(n(f"{kind}_missing") > 0, lost), F.when(n(f"{kind}_unresolved") > 0, "PAYLOAD_UNVERIFIED")]
    content = F.coalesce("content", F.lit("UNVERIFIED"))
    possible = possible + F.when(content.isin("VERIFIED", "DRIFT", "CHANGED"), POINTS["content"]).otherwise(0)
    points = points + F.when(content == "VERIFIED", POINTS["content"]).when(content == "DRIFT", POINTS["content"] / 2).otherwise(0)
    issues += [F.when(content == "DRIFT", "CONTENT_DRIFT").when(content == "CHANGED", "CONTENT_CHANGED").when(content == "UNVERIFIED", "PAYLOAD_UNVERIFIED")]
    seen = F.col("published")
    possible = possible + F.when(seen.isNotNull(), POINTS["published"]).otherwise(0)
    points = points + F.when(seen.isNotNull() & (seen | F.lit(raw_snapshot)), POINTS["published"]).otherwise(0)
    issues.append(no if raw_snapshot else F.when(~seen, "UNPUBLISHED"))
    out = facts.select("source_id", points.alias("earned"), possible.alias("possible"), F.array_distinct(F.array_compact(F.array(*issues))).alias("issues"))
    has = lambda *codes: F.arrays_overlap("issues", F.array(*map(F.lit, codes)))
    verdict = (
        F.when(has("TYPE_MUTATION"), "TYPE_MUTATION")
        .when(has("UNPUBLISHED") & ~has("MISSING_ASSET", "LINK_NOT_OBSERVED", "CONTENT_CHANGED", "CONTENT_DRIFT"), "UNPUBLISHED")
        .when(has("MISSING_ASSET", "LINK_NOT_OBSERVED", "CONTENT_CHANGED", "CONTENT_DRIFT", "ASSET_RELOCATED", "LINK_RELOCATED"), "PARTIAL")
        .when(has("MOVED_ITEM"), "MOVED")
        .when(has("PAYLOAD_UNVERIFIED") | (F.col("coverage") < 55), "UNVERIFIED")
        .otherwise("VERIFIED")
    )
    out = out.withColumns({"fidelity": F.floor(F.col("earned") / F.col("possible") * 100 + 0.5), "coverage": F.least(F.lit(100).cast("long"), F.floor(F.col("possible") + 0.5))})
    return out.withColumn("verdict", verdict).select("source_id", F.round("earned", 6).alias("earned"), F.round("possible", 6).alias("possible"), "fidelity", "coverage", F.array_join("issues", ",").alias("issues"), "verdict")
