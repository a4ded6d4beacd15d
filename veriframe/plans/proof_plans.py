"""Queries over documents to be compared and rubrics to be found in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.functions.text import clean_text
from veriframe.operators import proofs
from veriframe.plans import sql
from veriframe.sources.tables import table


def comparison_set(spark, sf_dir: str) -> DataFrame:
    """Products as files of items, known by hash, path or name."""
    k = lambda n: F.pmod("p_partkey", F.lit(n))
    rows = table(spark, sf_dir, "part").select(
        F.floor(F.col("p_partkey") / 20).alias("item_id"), F.concat("p_name", F.lit(".PDF")).alias("name"), F.when(k(3) == 1, F.concat(F.lit("Files\\"), "p_name")).alias("path"), F.when(k(3) == 0, F.upper(F.md5("p_brand"))).alias("sha256"),
        (F.col("p_size") % 2).alias("size"), F.when(k(10) == 9, "docx").otherwise("PDF").alias("extension"), (k(7) == 0).alias("reference_only"), F.when(k(5) > 0, k(11) > 0).alias("present"),
    )
    return proofs.comparison_set(rows)


def rubric_anchors(spark, sf_dir: str) -> DataFrame:
    """Documents against rubrics made of their neighbour's or their own words."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    said = lambda start, n: F.substring(clean_text("text"), start, n)
    titles = F.array(said(1, 30), F.replace(said(1, 45), F.lit(" "), F.lit("-")), F.lit("Rubric 2"), F.lit("Nothing of the kind here"), F.when(F.col("doc_id") % 3 == 0, said(70, 12)))
    rubrics = d.select(F.col("doc_id").alias("target_id"), F.explode(titles).alias("criterion"), F.array(said(10, 4), F.lit("Unheard label")).alias("labels"))
    pairs = d.select("doc_id", (F.col("doc_id") - F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("target_id"))
    return proofs.rubric_anchors(pairs, d, rubrics)


QUERIES = {f.__name__: f for f in (comparison_set, rubric_anchors)}

_STANDS = "len(list_filter({0}, lambda c: contains(t, lower(translate(c, '‘’“”', '''''\"\"'))) OR (length(trim(regexp_replace(lower(c), '[^a-z0-9]+', ' ', 'g'))) >= 8 AND contains(n, ' ' || trim(regexp_replace(lower(c), '[^a-z0-9]+', ' ', 'g')) || ' '))))"
ORACLE_SQL = {
    "comparison_set": """WITH p AS (SELECT p_partkey // 20 AS item_id, p_name || '.PDF' AS name, CASE p_partkey % 3 WHEN 0 THEN 'sha:' || md5(p_brand) WHEN 1 THEN 'path:files/' || p_name ELSE 'name:' || regexp_replace(p_name, '[^a-z0-9]+', '', 'g') || 'pdf:' || p_size % 2 END AS key,
        p_partkey % 7 = 0 OR (p_partkey % 5 > 0 AND p_partkey % 11 = 0) AS ignored FROM part WHERE p_partkey % 10 <> 9) SELECT item_id, key, min(name) AS name, count(*) AS copies, ignored FROM p GROUP BY item_id, key, ignored""",
    "rubric_anchors": f"""WITH d AS (SELECT doc_id, {sql.clean('text')} AS c FROM documents), r AS (SELECT doc_id AS target_id, list_filter([trim(c[1:30]), trim(replace(c[1:45], ' ', '-')), 'Nothing of the kind here', CASE WHEN doc_id % 3 = 0 THEN trim(c[70:81]) END], lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^rubric\\s*\\d*$')) AS a,
          list_filter([trim(c[10:13]), 'Unheard label'], lambda x: x <> '') AS b FROM d),
        p AS (SELECT d.doc_id, target_id, list_distinct(a) AS a, list_distinct(b) AS b, lower(translate(c, '‘’“”', '''''""')) AS t, ' ' || trim(regexp_replace(lower(c), '[^a-z0-9]+', ' ', 'g')) || ' ' AS n FROM d JOIN r ON r.target_id = d.doc_id - CASE WHEN d.doc_id % 5 = 0 THEN 1 ELSE 0 END),
        m AS (SELECT doc_id, target_id, len(a) AS criteria, CASE WHEN length(t) >= 80 THEN {_STANDS.format('a')} ELSE 0 END AS matched, len(b) AS labels, CASE WHEN length(t) >= 80 THEN {_STANDS.format('b')} ELSE 0 END AS matched_labels FROM p),
        s AS (SELECT *, round(CASE WHEN criteria > 0 THEN matched::DOUBLE / criteria ELSE 0 END * 0.82::DOUBLE + CASE WHEN labels > 0 THEN matched_labels::DOUBLE / labels ELSE 0 END * 0.18::DOUBLE, 9) AS score FROM m)
        SELECT *, criteria >= 2 AND matched::DOUBLE / criteria >= 0.67 AND score >= 0.72 AS verified FROM s""",
}
