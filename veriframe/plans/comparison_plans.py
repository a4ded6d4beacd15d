"""Queries that compare bound items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.functions import urls
from veriframe.operators import comparison
from veriframe.sources.tables import table


def _pairs(spark, sf_dir: str) -> DataFrame:
    """Each page bound to the page after it; secure pages count as well observed."""
    p = table(spark, sf_dir, "pages")
    confidence = F.when(F.col("url").like("https:%"), 0.9)
    return p.select(F.col("page_id").alias("source_id"), (F.col("page_id") + 1).alias("target_id"), confidence.alias("asset_confidence"), confidence.alias("link_confidence"))


def link_evidence(spark, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    links = p.select(F.col("page_id").alias("id"), F.explode(urls.html_links("html")).alias("link"))
    return comparison.link_evidence(_pairs(spark, sf_dir), links, links)


def asset_evidence(spark, sf_dir: str) -> DataFrame:
    """Products as files of items, eight to an item: states of an item's files in the next item."""
    p = table(spark, sf_dir, "part")
    sha = F.when(F.col("p_size") < 10, F.sha2(F.concat("p_name", "p_brand"), 256))
    item = F.floor(F.col("p_partkey") / 8)
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("."), F.when(F.col("p_size") > 25, "pdf").otherwise("docx"))
    files = p.select(item.alias("id"), name.alias("name"), (F.col("p_size") * 1000).alias("size"), sha.alias("sha256"))
    first = files.groupBy("id", "name").agg(F.min(F.struct("size", "sha256")).alias("f")).select("id", "name", "f.*")
    pairs = first.groupBy(F.col("id").alias("source_id")).agg(F.when(F.max("size") > 40_000, 0.9).alias("asset_confidence"))
    return comparison.asset_evidence(pairs.withColumn("target_id", F.col("source_id") + 1), first, first)


def item_fidelity(spark, sf_dir: str) -> DataFrame:
    """Orders as items: facts made of their lines."""
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy(F.col("l_orderkey").alias("source_id")).agg(
        (F.max("l_linenumber") < 7).alias("compatible"), F.when(F.min("l_linenumber") > 1, F.max("l_tax") * 12).alias("path_score"), F.count("*").alias("asset_expected"),
        F.count_if(F.col("l_returnflag") == "A").alias("asset_present"), F.count_if(F.col("l_returnflag") == "N").alias("asset_relocated"), F.count_if((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")).alias("asset_missing"),
        F.count_if((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("asset_unresolved"), F.count_if(F.col("l_quantity") > 40).alias("link_expected"), F.count_if((F.col("l_quantity") > 40) & (F.col("l_tax") > 0.02)).alias("link_present"),
        F.lit(0).cast("long").alias("link_relocated"), F.count_if((F.col("l_quantity") > 40) & (F.col("l_tax") <= 0.01)).alias("link_missing"), F.count_if((F.col("l_quantity") > 40) & (F.col("l_tax") > 0.01) & (F.col("l_tax") <= 0.02)).alias("link_unresolved"),
        F.when(F.min("l_discount") < 0.01, "VERIFIED").when(F.min("l_discount") < 0.03, "DRIFT").when(F.max("l_discount") > 0.09, "CHANGED").alias("content"), F.when(F.sum("l_linenumber") % 3 != 0, F.sum("l_linenumber") % 3 == 1).alias("published"),
    )
    return comparison.item_fidelity(g)


QUERIES = {f.__name__: f for f in (link_evidence, asset_evidence, item_fidelity)}

ORACLE_SQL = {
    "link_evidence": r"""WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"'']+)["'']', 1)) AS link FROM pages),
        a AS (SELECT link, min(page_id) AS low, max(page_id) AS high FROM l GROUP BY link)
        SELECT s.page_id AS source_id, s.link, CASE WHEN t.page_id IS NOT NULL THEN 'PRESENT' WHEN low <> s.page_id + 1 OR high <> s.page_id + 1 THEN 'RELOCATED' WHEN p.url LIKE 'https:%' THEN 'MISSING' ELSE 'UNRESOLVED' END AS state
        FROM l s JOIN pages p ON p.page_id = s.page_id LEFT JOIN l t ON t.page_id = s.page_id + 1 AND t.link = s.link LEFT JOIN a ON a.link = s.link""",
    "item_fidelity": """WITH g AS (SELECT l_orderkey AS source_id, max(l_linenumber) < 7 AS compatible, CASE WHEN min(l_linenumber) > 1 THEN max(l_tax) * 12 END AS path, count(*) AS ae, count(*) FILTER (l_returnflag = 'A') AS ap,
          count(*) FILTER (l_returnflag = 'N') AS ar, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') AS am, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS au, count(*) FILTER (l_quantity > 40) AS le,
          count(*) FILTER (l_quantity > 40 AND l_tax > 0.02) AS lp, count(*) FILTER (l_quantity > 40 AND l_tax <= 0.01) AS lm, count(*) FILTER (l_quantity > 40 AND l_tax > 0.01 AND l_tax <= 0.02) AS lu,
          coalesce(CASE WHEN min(l_discount) < 0.01 THEN 'VERIFIED' WHEN min(l_discount) < 0.03 THEN 'DRIFT' WHEN max(l_discount) > 0.09 THEN 'CHANGED' END, 'UNVERIFIED') AS c, CASE WHEN sum(l_linenumber) % 3 <> 0 THEN sum(l_linenumber) % 3 = 1 END AS pub FROM lineitem GROUP BY l_orderkey),
        s AS (SELECT *, 30.0::DOUBLE + CASE WHEN compatible THEN 15 ELSE 0 END + CASE WHEN path >= 0.62 THEN 10 WHEN path >= 0.40 THEN 5 ELSE 0 END + 20 * (ap::DOUBLE / ae + ar::DOUBLE / ae * 0.5) + CASE WHEN le > 0 THEN 10 * (lp::DOUBLE / le) ELSE 0 END
            + CASE c WHEN 'VERIFIED' THEN 10 WHEN 'DRIFT' THEN 5 ELSE 0 END + CASE WHEN pub THEN 5 ELSE 0 END AS earned,
          45.0::DOUBLE + CASE WHEN path IS NOT NULL THEN 10 ELSE 0 END + 20 - 20 * (au::DOUBLE / ae) + CASE WHEN le > 0 THEN 10 - 10 * (lu::DOUBLE / le) ELSE 0 END + CASE WHEN c <> 'UNVERIFIED' THEN 10 ELSE 0 END + CASE WHEN pub IS NOT NULL THEN 5 ELSE 0 END AS possible FROM g),
        i AS (SELECT *, array_to_string(list_filter([CASE WHEN NOT compatible THEN 'TYPE_MUTATION' END, CASE WHEN path < 0.62 THEN 'MOVED_ITEM' END, CASE WHEN ar > 0 THEN 'ASSET_RELOCATED' END, CASE WHEN am > 0 THEN 'MISSING_ASSET' END,
            CASE WHEN au > 0 THEN 'PAYLOAD_UNVERIFIED' END, CASE WHEN lm > 0 THEN 'LINK_NOT_OBSERVED' END, CASE WHEN lu > 0 AND au = 0 THEN 'PAYLOAD_UNVERIFIED' END,
            CASE WHEN c = 'DRIFT' THEN 'CONTENT_DRIFT' WHEN c = 'CHANGED' THEN 'CONTENT_CHANGED' WHEN c = 'UNVERIFIED' AND au = 0 AND lu = 0 THEN 'PAYLOAD_UNVERIFIED' END, CASE WHEN NOT pub THEN 'UNPUBLISHED' END], lambda x: x IS NOT NULL), ',') AS issues,
          floor(earned / possible * 100 + 0.5)::BIGINT AS fidelity, least(100, floor(possible + 0.5))::BIGINT AS coverage FROM s)
        SELECT source_id, round(earned, 6) AS earned, round(possible, 6) AS possible, fidelity, coverage, issues,
          CASE WHEN NOT compatible THEN 'TYPE_MUTATION' WHEN NOT pub AND am = 0 AND lm = 0 AND c NOT IN ('CHANGED', 'DRIFT') THEN 'UNPUBLISHED' WHEN am > 0 OR lm > 0 OR c IN ('CHANGED', 'DRIFT') OR ar > 0 THEN 'PARTIAL'
            WHEN path < 0.62 THEN 'MOVED' WHEN contains(issues, 'PAYLOAD_UNVERIFIED') OR coverage < 55 THEN 'UNVERIFIED' ELSE 'VERIFIED' END AS verdict FROM i""",
}
