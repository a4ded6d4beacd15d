"""Proof that a document became part of a native assignment: which documents are to be compared, and whether the criteria of a rubric stand in
them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions.files import asset_key
from veriframe.functions.questions import question_text
from veriframe.functions.text import clean_name, clean_text

# A title that is no criterion, weights and least shares of a proof.
PLAIN_RUBRIC = r"(?i)^rubric\s*\d*$"
CRITERIA_SHARE, LABEL_SHARE = 0.82, 0.18
LEAST_CRITERIA, LEAST_COVERAGE, LEAST_SCORE = 2, 0.67, 0.72
LEAST_TEXT, LEAST_NAME = 80, 8


def comparison_set(assets: DataFrame, kind: str = "pdf") -> DataFrame:
    """(item_id, key, name, copies, ignored): the distinct documents of a kind among assets(item_id, name, path, sha256, size, extension, reference_only,
    present), known by hash, else by path, else by name and size. References and files absent from the package are ``ignored``: one row each, not compared."""
    rows = assets.where(F.lower("extension") == kind)
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    path = F.lower(F.replace(blank("path"), F.lit("\\"), F.lit("/")))
    by_name = F.concat(F.lit("name:"), asset_key("name"), F.lit(":"), F.coalesce("size", F.lit(0)).cast("string"))
    key = F.when(blank("sha256") != "", F.concat(F.lit("sha:"), F.lower("sha256"))).when(path != "", F.concat(F.lit("path:"), path)).otherwise(by_name)
    ignored = F.coalesce("reference_only", F.lit(False)) | ~F.coalesce("present", F.lit(True))
    return rows.select("item_id", key.alias("key"), "name", ignored.alias("ignored")).groupBy("item_id", "key", "ignored").agg(F.min("name").alias("name"), F.count("*").alias("copies")).select("item_id", "key", "name", "copies", "ignored")


def _stands(text: Column, name: Column, needle: Column) -> Column:
    """Whether a needle stands in a text, as it is or, from eight letters and digits on, by its words."""
    words = clean_name(needle)
    return F.contains(text, F.lower(question_text(needle))) | ((F.length(words) >= LEAST_NAME) & F.contains(name, F.concat(F.lit(" "), words, F.lit(" "))))


def rubric_anchors(pairs: DataFrame, documents: DataFrame, rubrics: DataFrame) -> DataFrame:
    """(doc_id, target_id, criteria, matched, labels, matched_labels, score, verified) of pairs(doc_id, target_id): how many distinct criteria and level labels of
    the target's rubrics(target_id, criterion, labels) stand in the document(doc_id, text). Criteria carry the proof, labels only support it; short texts
    and rubrics of one criterion prove nothing."""
    title = clean_text("criterion")
    rows = rubrics.select("target_id", F.when((title != "") & ~title.rlike(PLAIN_RUBRIC), title).alias("criterion"), F.filter(F.transform("labels", clean_text), lambda x: x != "").alias("labels"))
    # Of one rubric: as many titles and labels as its author wrote.
    wanted = rows.groupBy("target_id").agg(F.collect_set("criterion").alias("_criteria"), F.array_distinct(F.flatten(F.collect_list("labels"))).alias("_labels"))
    form = F.struct(F.lower(question_text("text")).alias("text"), F.concat(F.lit(" "), clean_name("text"), F.lit(" ")).alias("name"))
    texts = documents.select("doc_id", form.alias("_form"))
    both = pairs.select("doc_id", "target_id").join(wanted, "target_id").join(texts, "doc_id")
    hits = lambda c: F.when(F.length("_form.text") >= LEAST_TEXT, F.size(F.filter(c, lambda x: _stands(F.col("_form.text"), F.col("_form.name"), x)))).otherwise(0)
    both = both.select("doc_id", "target_id", F.size("_criteria").alias("criteria"), hits("_criteria").alias("matched"), F.size("_labels").alias("labels"), hits("_labels").alias("matched_labels"))
    share = lambda hit, n: F.when(F.col(n) > 0, F.col(hit) / F.col(n)).otherwise(0.0)
    both = both.withColumn("score", F.round(share("matched", "criteria") * CRITERIA_SHARE + share("matched_labels", "labels") * LABEL_SHARE, 9))
    proof = (F.col("criteria") >= LEAST_CRITERIA) & (share("matched", "criteria") >= LEAST_COVERAGE) & (F.col("score") >= LEAST_SCORE)
    return both.withColumn("verified", proof)
