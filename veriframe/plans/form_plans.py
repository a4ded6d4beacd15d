"""Queries over forms of addresses, cells and hashes, and over questions read from XML."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.functions import text, urls
from veriframe.sources import assessments
from veriframe.sources.tables import table


def page_addresses(spark, sf_dir: str) -> DataFrame:
    """Addresses of an order's pages, written in several ways, once each and without those of schemas."""
    k = lambda n: F.pmod("o_orderkey", F.lit(n)).cast("string")
    links = F.array(
        F.concat(F.lit(" https://www.Shop.example//a/"), k(5), F.lit("/?utm_source=x&q="), k(3)), F.concat(F.lit("http://shop.example/a/"), k(5), F.lit("?q="), k(3)), F.lit("http://www.w3.org/2001/XMLSchema"),
        F.when(F.pmod("o_orderkey", F.lit(2)) == 0, F.concat(F.lit("HTTP://docs.example/"), "o_orderpriority")).otherwise("mailto:someone"), F.lit(""), F.lit("https://www.imsglobal.org/xsd/imscp_v1p1"),
    )
    found = table(spark, sf_dir, "orders").select("o_orderkey", urls.external_links(links).alias("links"))
    return found.select("o_orderkey", F.array_join("links", " ").alias("links"), urls.is_schema_address(F.lit("ccv1p3.xsd")).alias("rest_is_schema"))


def video_ids(spark, sf_dir: str) -> DataFrame:
    """Ids of videos in the usual forms of address; other addresses have none."""
    name = F.lpad(F.col("c_custkey").cast("string"), 11, "Ab_-")
    form = F.pmod("c_custkey", F.lit(5))
    address = (
        F.when(form == 0, F.concat(F.lit("https://youtu.be/"), name, F.lit("?t=3"))).when(form == 1, F.concat(F.lit("https://www.youtube.com/embed/"), name)).when(form == 2, F.concat(F.lit("https://youtube.com/watch?list=x&v="), name, F.lit("&t=1")))
        .when(form == 3, F.concat(F.lit("https://youtube.com/watch?v="), name, F.lit("more"))).otherwise(F.concat(F.lit("https://video.example/"), name))
    )
    return table(spark, sf_dir, "customer").select("c_custkey", urls.video_id(address).alias("video"))


def safe_cells(spark, sf_dir: str) -> DataFrame:
    """Cells of customers as a workbook may hold them."""
    cell = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("-"), "c_name")).when(F.pmod("c_custkey", F.lit(3)) == 0, F.concat(F.lit("=SUM("), "c_name", F.lit(")"))).when(F.pmod("c_custkey", F.lit(3)) == 1, F.concat(F.lit("@"), "c_mktsegment")).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.safe_cell(cell).alias("cell"))


def hash_similarities(spark, sf_dir: str) -> DataFrame:
    """Hashes of neighbouring documents by the share of characters they have in common; null where lengths differ."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 9, F.sha2(F.coalesce("text", F.lit("")), 256)).otherwise(F.md5(F.coalesce("text", F.lit("")))).alias("h"))
    pairs = d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("h").alias("other")), "doc_id")
    return pairs.select("doc_id", F.round(text.hash_bits_similarity(F.col("h"), F.col("other")), 9).alias("alike"))


def xml_questions(spark, sf_dir: str) -> DataFrame:
    """Questions of a brand's products, written as XML and read again with their right options."""
    size = F.col("p_size")
    option = lambda i: F.concat(F.lit(f'<response_label ident="o{i}"><material><mattext>'), (size + i).cast("string"), F.lit(" cm</mattext></material></response_label>"))
    right = F.when(size % 3 == 0, "<not><varequal>o0</varequal></not><varequal>o1</varequal>").otherwise("<varequal>o0</varequal>")
    lid = F.when(size % 5 == 0, "").otherwise(F.concat(F.lit('<response_lid ident="r" rcardinality="'), F.when(size % 4 == 0, "Multiple").otherwise("Single"), F.lit('"><render_choice>'), option(0), option(1), F.lit("</render_choice></response_lid>")))
    item = F.concat(
        F.lit('<item ident="q'), F.col("p_partkey").cast("string"), F.lit('"><presentation><material><mattext>How long is the '), "p_name", F.lit("?</mattext></material>"), lid,
        F.lit("</presentation><resprocessing><respcondition><conditionvar>"), right, F.lit('</conditionvar><setvar varname="SCORE" action="Set">100</setvar></respcondition></resprocessing></item>'),
    )
    page = F.floor(F.col("p_partkey") / 50)  # fifty products a document
    pages = table(spark, sf_dir, "part").groupBy(page.alias("page")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("item")))), lambda x: x["item"]).alias("items"))
    xml = pages.select("page", F.concat(F.lit("<questestinterop><assessment><section>"), F.array_join("items", ""), F.lit("</section></assessment></questestinterop>")).alias("text"))
    rows = assessments.qti_questions(xml)
    marks = F.array_join(F.transform("options", lambda o: F.concat(o["text"], F.when(o["correct"], "*").otherwise(""))), "|")
    return rows.select("page", "question_id", "prompt", "kind", marks.alias("options"))


QUERIES = {f.__name__: f for f in (page_addresses, video_ids, safe_cells, hash_similarities, xml_questions)}

ORACLE_SQL = {
    "page_addresses": """SELECT o_orderkey, 'shop.example/a/' || o_orderkey % 5 || '?q=' || o_orderkey % 3 || CASE WHEN o_orderkey % 2 = 0 THEN ' docs.example/' || o_orderpriority ELSE '' END AS links, true AS rest_is_schema FROM orders""",
    "video_ids": "SELECT c_custkey, CASE WHEN c_custkey % 5 < 3 THEN lpad(c_custkey::VARCHAR, 11, 'Ab_-') ELSE '' END AS video FROM customer",
    "safe_cells": """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '''-' || c_name WHEN c_custkey % 3 = 0 THEN '''=SUM(' || c_name || ')' WHEN c_custkey % 3 = 1 THEN '''@' || c_mktsegment ELSE c_name END AS cell FROM customer""",
    "hash_similarities": """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN sha256(coalesce(text, '')) ELSE md5(coalesce(text, '')) END AS h FROM documents)
        SELECT a.doc_id, CASE WHEN length(a.h) = length(b.h) THEN round(list_sum(list_transform(range(1, length(a.h) + 1), lambda i: (a.h[i] = b.h[i])::INT))::DOUBLE / length(a.h), 9) END AS alike FROM d a JOIN d b ON b.doc_id = a.doc_id + 1""",
    "xml_questions": """SELECT p_partkey // 50 AS page, 'q' || p_partkey AS question_id, 'How long is the ' || p_name || '?' AS prompt, CASE WHEN p_size % 5 = 0 THEN 'text' WHEN p_size % 4 = 0 THEN 'multiple' ELSE 'choice' END AS kind,
        CASE WHEN p_size % 5 = 0 THEN '' ELSE p_size || ' cm' || CASE WHEN p_size % 3 <> 0 THEN '*' ELSE '' END || '|' || (p_size + 1) || ' cm' || CASE WHEN p_size % 3 = 0 THEN '*' ELSE '' END END AS options FROM part""",
}
