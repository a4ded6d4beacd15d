"""Queries over what turned up elsewhere: products as files of items, eight to an item, fifty items to a course."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.operators import recovery
from veriframe.sources.tables import table


def _files(spark, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    item = F.floor(F.col("p_partkey") / 8)
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("."), F.when(F.col("p_size") > 25, "pdf").otherwise("docx"))
    return p.select(
        F.floor(F.col("p_partkey") / 400).alias("course"), item.alias("item"), F.when(F.col("p_partkey") % 5 == 0, "link").otherwise("asset").alias("kind"), name.alias("name"), name.alias("key"),
        F.when((F.col("p_size") < 20) & (F.col("p_partkey") % 5 != 0), F.sha2(F.concat("p_name", "p_brand"), 256)).alias("sha256"), (F.col("p_partkey") % 11 == 0).alias("reference_only"), (F.col("p_partkey") % 13 != 0).alias("present"),
    )


def _recovered(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Even items are sources, odd ones carry files, the next one is the matched one."""
    files = _files(spark, sf_dir)
    expected, carried = files.where("item % 2 = 0").withColumnRenamed("item", "source_id"), files.where("item % 2 = 1").withColumnRenamed("item", "item_id").drop("reference_only", "present")
    sources = files.where("item % 2 = 0").select("course", F.col("item").alias("source_id")).distinct()
    step = lambda n: sources.withColumn("item_id", F.col("source_id") + n)
    return sources, recovery.payload_recovery(expected, carried, step(1), step(3).where("source_id % 4 = 0"))


def payload_recovery(spark, sf_dir: str) -> DataFrame:
    return _recovered(spark, sf_dir)[1]


def recovered_by(spark, sf_dir: str) -> DataFrame:
    """The chain of evidence: what files don't tell, texts may, and then structures."""
    sources, payload = _recovered(spark, sf_dir)
    k = F.col("source_id")
    pairs = sources.withColumn("n", F.explode(F.array(F.lit(5), F.lit(7), F.lit(9)))).select(
        "course", "source_id", (k + F.col("n")).alias("item_id"), ((k + F.col("n")) % 3 != 0).alias("same_type"), (k % 8 == 0).alias("reading"), F.when(k % 6 == 0, 0.5).otherwise(0.7).alias("path_score"),
        F.when((k + F.col("n")) % 5 != 0, "VERIFIED").otherwise("DRIFT").alias("status"), (F.lit(0.80) + (k + F.col("n")) % 4 / 100).alias("score"), (F.lit(0.80) + (k * F.col("n")) % 11 / 100).alias("coverage"),
    )
    found = recovery.recovered_by(sources, payload, recovery.repackaged_texts(pairs), sources.where("source_id % 3 = 0").withColumn("item_id", k + 11))
    return found


QUERIES = {f.__name__: f for f in (payload_recovery, recovered_by)}

_PAYLOAD = """f AS (SELECT p_partkey // 400 AS course, p_partkey // 8 AS item, CASE WHEN p_partkey % 5 = 0 THEN 'link' ELSE 'asset' END AS kind, replace(p_name, ' ', '_') || CASE WHEN p_size > 25 THEN '.pdf' ELSE '.docx' END AS key, p_name AS stem,
    CASE WHEN p_size < 20 AND p_partkey % 5 <> 0 THEN sha256(p_name || p_brand) END AS sha, p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AS real FROM part),
e AS (SELECT DISTINCT course, item AS source_id, kind, key, stem, sha FROM f WHERE item % 2 = 0 AND real), c AS (SELECT * FROM f WHERE item % 2 = 1),
found AS (SELECT e.course, e.source_id, e.kind, e.key, e.sha, min(c.item) AS carrier FROM e LEFT JOIN c
    ON c.course = e.course AND c.kind = e.kind AND c.key = e.key AND c.item <> e.source_id + 1 AND (e.kind = 'link' OR e.sha IS NULL OR c.sha IS NULL OR c.sha = e.sha) GROUP BY ALL),
conflicts AS (SELECT DISTINCT e.course, e.source_id FROM e JOIN c ON c.course = e.course AND e.kind = 'asset' AND c.kind = 'asset' AND c.stem = e.stem AND c.item <> e.source_id + 1 AND c.sha <> e.sha),
s AS (SELECT DISTINCT course, item AS source_id FROM f WHERE item % 2 = 0),
held AS (SELECT course, source_id, count(*) AS n, count(carrier) AS hits, min(carrier) AS low, count(DISTINCT carrier) AS carriers FROM found GROUP BY ALL),
r AS (SELECT s.*, coalesce(n, 0) AS n, coalesce(hits, 0) AS hits, low, coalesce(carriers, 0) AS carriers, x.source_id IS NOT NULL AS conflict, CASE WHEN s.source_id % 4 = 0 THEN s.source_id + 3 END AS guess FROM s LEFT JOIN held USING (course, source_id) LEFT JOIN conflicts x USING (course, source_id) WHERE n IS NOT NULL OR s.source_id % 4 = 0),
d AS (SELECT *, hits = 0 AND NOT conflict AND guess IS NOT NULL AS inferred FROM r),
payload AS (SELECT course, source_id, CASE WHEN n > 0 THEN n ELSE inferred::INT END AS expected, hits + inferred::INT AS recovered, round(CASE WHEN n > 0 THEN least(1, (hits + inferred::INT)::DOUBLE / n) ELSE inferred::INT::DOUBLE END, 9) AS ratio, carriers + inferred::INT AS carriers,
    coalesce(low, CASE WHEN inferred THEN guess END) AS first_carrier, conflict, inferred, n > 0 AND hits = n AS complete FROM d)"""
ORACLE_SQL = {
    "payload_recovery": f"WITH {_PAYLOAD} SELECT * FROM payload",
    "recovered_by": f"""WITH {_PAYLOAD}, t AS (SELECT course, source_id, source_id + n AS item_id, (source_id + n) % 3 <> 0 AND source_id % 6 <> 0 AND (source_id + n) % 5 <> 0 AND (source_id + n) % 4 >= 2 AS near, (source_id + n) % 4 AS score,
          source_id % 8 = 0 AND (source_id * n) % 11 >= 6 AS covers FROM s, unnest([5, 7, 9]) u(n)),
        b AS (SELECT course, source_id, arg_min(item_id, (-score, item_id)) FILTER (near) AS near, CASE WHEN count(*) FILTER (covers) = 1 THEN min(item_id) FILTER (covers) END AS only FROM t GROUP BY ALL)
        SELECT s.course, s.source_id, coalesce(CASE WHEN p.recovered > 0 THEN p.first_carrier END, b.near, b.only, CASE WHEN s.source_id % 3 = 0 THEN s.source_id + 11 END) AS item_id,
          CASE WHEN p.recovered > 0 THEN CASE WHEN p.inferred THEN 'TITLE' ELSE 'PAYLOAD' END WHEN coalesce(b.near, b.only) IS NOT NULL THEN 'TEXT' WHEN s.source_id % 3 = 0 THEN 'STRUCTURE' ELSE 'NONE' END AS basis
        FROM s LEFT JOIN payload p USING (course, source_id) LEFT JOIN b USING (course, source_id)""",
}
