"""Binding and matching: identities are joined only where they are unique, equal candidates stay open."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions import text
from veriframe.operators import joins
from veriframe.operators.stored import settled

CUTOFF = 0.78
_RANK = ("exact_title", "compatible", "score_9", "path_9")


def unique_binding(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Every source row with a status: BOUND where the key is there once on either side, else the reason why
    not. source(source_id, key), target(target_id, key); blank keys bind nothing."""
    left = source.withColumn("key", F.when(F.trim(F.col(key)) != "", F.trim(F.col(key)))).select("source_id", "key")
    right = target.withColumn("key", F.when(F.trim(F.col(key)) != "", F.trim(F.col(key)))).select("target_id", "key")
    sources = left.groupBy("key").agg(F.count("*").alias("n_source"))
    targets = right.groupBy("key").agg(F.count("*").alias("n_target"), F.min("target_id").alias("target_id"))
    rows = left.join(sources, "key", "left").join(targets, "key", "left")
    status = (
        F.when(F.col("key").isNull(), "NO_KEY")
        .when(F.col("n_target").isNull(), "NO_TARGET")
        .when((F.col("n_source") > 1) | (F.col("n_target") > 1), "AMBIGUOUS")
        .otherwise("BOUND")
    )
    return rows.select("source_id", "key", status.alias("status"), F.when(status == "BOUND", F.col("target_id")).alias("target_id"), F.coalesce("n_target", F.lit(0)).alias("candidates"))


def candidate_pairs(source: DataFrame, target: DataFrame, blocks: Column) -> DataFrame:
    """Distinct (source row, target row) pairs that share a block; ``blocks`` is an array of keys over
    (name, type, path). Only ids travel until pairs are distinct."""
    left = source.select("source_id", F.explode(blocks).alias("block")).distinct()
    right = target.select("target_id", F.explode(blocks).alias("block")).distinct()
    return left.join(right, "block").select("source_id", "target_id").distinct()


def _form(df: DataFrame, side: str, *keep: str) -> DataFrame:
    """What a score needs of a row's name, type and path."""
    return df.select(*keep, text.title_key("name").alias(f"{side}_title"), text.alnum("name").alias(f"{side}_name"), F.col("type").alias(f"{side}_type"), text.path_form("path").alias(f"{side}_path"))


def _scored(rows: DataFrame, cutoff: float) -> DataFrame:
    rows = rows.withColumns({
        "title": text.edit_similarity(F.col("source_name"), F.col("target_name")),
        "path": text.path_similarity(F.col("source_path"), F.col("target_path")),
        "compatible": text.types_compatible(F.col("source_type"), F.col("target_type")),
        "exact_title": (F.col("source_title") != "") & (F.col("source_title") == F.col("target_title")),
    })
    rows = rows.withColumn("score", text.match_score(F.col("title"), F.col("path"), F.col("compatible"))).where(F.col("score") >= cutoff)
    return rows.withColumns({"score_9": F.round("score", 9), "path_9": F.round(F.coalesce("path", F.lit(-1.0)), 9)})


def scored_edges(source: DataFrame, target: DataFrame, pairs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """(source_id, target_id, exact_title, compatible, score, path_score) of pairs at or above the cutoff."""
    rows = pairs.join(_form(source, "source", "source_id"), "source_id").join(_form(target, "target", "target_id"), "target_id")
    return _scored(rows, cutoff).select("source_id", "target_id", *_RANK)


def blocked_edges(source: DataFrame, target: DataFrame, blocks: Column, cutoff: float = CUTOFF) -> DataFrame:
    """``scored_edges`` of all pairs that share a block, without listing these: rows of the same name, type and path are one form, forms that meet in
    a block are scored once, and only rows of forms that pass are paired. A pair of several blocks is found in the first of them."""
    words = ["name", "type", "path"]
    both = source.select(*words).unionByName(target.select(*words)).distinct()
    forms = settled(both.select(F.monotonically_increasing_id().alias("form"), *words))
    equal = lambda df: [df[c].eqNullSafe(F.col(f"f_{c}")) for c in words]

    def placed(df: DataFrame, side: str) -> DataFrame:
        named = forms.select(F.col("form").alias(f"{side}_form"), *(F.col(c).alias(f"f_{c}") for c in words))
        rows = df.where(F.col(f"{side}_id").isNotNull()).withColumn("_blocks", F.array_sort(F.array_distinct(blocks))).join(named, equal(df))
        return rows.select(f"{side}_id", f"{side}_form", F.col("_blocks").alias(f"{side}_blocks"), F.explode("_blocks").alias("block"))

    s, t = settled(placed(source, "source").distinct()), settled(placed(target, "target").distinct())
    met = s.select("block", "source_form").distinct().join(t.select("block", "target_form").distinct(), "block").select("source_form", "target_form").distinct()
    of = lambda side: _form(forms.withColumnRenamed("form", f"{side}_form"), side, f"{side}_form")
    kept = settled(_scored(met.join(of("source"), "source_form").join(of("target"), "target_form"), cutoff).select("source_form", "target_form", *_RANK))
    rows = s.join(kept, "source_form").join(t, ["block", "target_form"])
    first = F.get(F.array_intersect("source_blocks", "target_blocks"), F.lit(0))
    return rows.where(F.col("block") == first).select("source_id", "target_id", *_RANK)


def unambiguous(edges: DataFrame) -> DataFrame:
    """Edges without those that touch a row with two equally ranked edges, at any rank."""
    same = edges.groupBy("source_id", *_RANK).agg(F.count("*").alias("n")).where("n > 1")
    other = edges.groupBy("target_id", *_RANK).agg(F.count("*").alias("n")).where("n > 1")
    touched = edges.join(same.drop("n"), ["source_id", *_RANK], "left_semi").unionByName(edges.join(other.drop("n"), ["target_id", *_RANK], "left_semi"))
    return edges.join(touched.select("source_id").distinct(), "source_id", "left_anti").join(touched.select("target_id").distinct(), "target_id", "left_anti")


def greedy(edges: DataFrame, order: Sequence[Column], source: str = "source_id", target: str = "target_id") -> DataFrame:
    """The greedy one-to-one assignment in ``order``, a total order of the edges: an edge is taken if no edge before it has taken
    one of its rows. Edges that share no row, not even over others, don't touch each other, so each component is decided in one
    pass over its edges in order, holding the rows that are taken. Components take rounds that grow with the logarithm of the longest chain."""
    edges = settled(edges)
    node = lambda side, c: F.concat(F.lit(side), F.col(c).cast("string"))
    parts = joins.components(edges.select(node("t", target).alias("u"), node("s", source).alias("v")))
    rows = edges.withColumn("_node", node("s", source)).join(parts.withColumnRenamed("node", "_node").withColumnRenamed("component", "_part"), "_node").drop("_node")
    at = [rows.columns.index(c) for c in ("_part", source, target)]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, used = None, (set(), set())
        for batch in batches:
            keep = []
            for p, s, t in zip(*(batch.column(i).to_pylist() for i in at), strict=True):
                if p != part:
                    part, used = p, (set(), set())
                good = s not in used[0] and t not in used[1]
                if good:
                    used[0].add(s)
                    used[1].add(t)
                keep.append(good)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.repartition("_part").sortWithinPartitions("_part", *order).mapInArrow(take, rows.schema).drop("_part")


def match_plan(edges: DataFrame) -> DataFrame:
    """One-to-one assignment, greedy in order of rank, of the edges that are not ambiguous. Edges without an id on
    either side are no edges."""
    order = [F.desc("exact_title"), F.desc("compatible"), F.desc("score_9"), F.desc("path_9"), F.asc("source_id"), F.asc("target_id")]
    method = F.when(F.col("exact_title"), "EXACT_TITLE").when(F.col("compatible"), "TYPE_COMPATIBLE").otherwise("FUZZY")
    return greedy(unambiguous(edges.where("source_id is not null and target_id is not null")), order).withColumn("method", method)


def key_candidates(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Of every left row: UNIQUE, AMBIGUOUS or NONE by how often its key stands on the right."""
    counts = right.groupBy(key).agg(F.count_distinct("target_id").alias("targets"), F.min("target_id").alias("target_id"))
    kind = F.when(F.col("targets").isNull(), "NONE").when(F.col("targets") == 1, "UNIQUE").otherwise("AMBIGUOUS")
    return left.join(counts, key, "left").select("source_id", key, kind.alias("kind"), F.when(F.col("targets") == 1, F.col("target_id")).alias("target_id"))
