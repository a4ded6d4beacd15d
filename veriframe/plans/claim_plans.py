"""Queries over ingestion reports: the text of an order's report is made of its lines, then read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.operators import claims
from veriframe.sources.tables import table

# What an event of a line says: its heading and words, and the types and severities to be read from them. %s is a file of the line's.
_EVENTS = (
    ("AI-Generated Mandatory Field", "The passing score was generated.", (("GENERATED_BEHAVIOR", "REVIEW"),)),
    ("Content Excluded", "The lab was left out.", (("INTENTIONAL_EXCLUSION", "REVIEW"),)),
    ("Unsupported Content Fallback", 'The widget "notes %s.html" became a page.', (("UNSUPPORTED_CONTENT_FALLBACK", "REVIEW"),)),
    ("Content Adaptation", 'The attachment "guide %s.pdf" could not be uploaded.', (("UNRESOLVED_SOURCE_ASSET", "CRITICAL"),)),
    ("Content Adaptation", "Tables are not allowed inside lists and were converted.", (("CONTENT_MARKUP_ADAPTATION", "INFO"),)),
    ("AI-Generated Mandatory Field", "It generated the replacement reading content.", (("GENERATED_CONTENT_FALLBACK", "REVIEW"),)),
    ("Empty Module Structure", "Someone must recreate the question by hand.", (("REPAIR_INSTRUCTION", "REVIEW"),)),
    ("Content Adaptation", "A parsing failure stopped the unit.", (("SI_PROCESSING_FAILURE", "CRITICAL"),)),
    ("AI-Generated Mandatory Field", "Left the passing score to null because nothing was said.", ()),
)


def _name(c: Column) -> Column:
    return F.concat("p_name", F.lit(" unit "), c.cast("string"))


def _lines(spark, sf_dir: str) -> DataFrame:
    """Order lines with the product's name, their module, and one of the events."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    module = F.concat(F.lit("Module "), (F.pmod("l_suppkey", F.lit(3)) + 1).cast("string"), F.lit(" "), "p_brand")
    return li.join(p, "l_partkey").withColumns({"item": _name(F.pmod("l_partkey", F.lit(40))), "module": module, "e": F.pmod("l_partkey", F.lit(len(_EVENTS))).cast("int")})


def _reports(spark, sf_dir: str) -> DataFrame:
    """One report for each order: every line under its module; every second one names its item, the others are told in words."""
    pick = lambda i: F.get(F.array(*(F.lit(e[i]) for e in _EVENTS)), F.col("e"))
    said = F.concat(pick(0), F.lit(" "), F.replace(pick(1), F.lit("%s"), F.pmod("l_partkey", F.lit(40)).cast("string")))
    line = F.when(F.pmod("l_partkey", F.lit(2)) == 0, F.concat(F.lit("Module: "), "module", F.lit(" Item: "), "item", F.lit(" "), said)).otherwise(F.concat(F.lit("Module: "), "module", F.lit(" Item: widget "), said, F.lit(" See "), "item", F.lit(".")))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", line.alias("line"))
    rows = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["line"]).alias("lines"))
    return rows.select(F.col("l_orderkey").alias("course"), F.lit(0).alias("report_id"), F.lit("Author Alignment Report").alias("name"), F.lit("").alias("path"), F.concat(F.lit("Transformations and gap-filling. "), F.array_join("lines", "\n")).alias("text"))


def _items(spark, sf_dir: str) -> DataFrame:
    """The lines as items of their order, some in another place, each with a file."""
    path = F.concat("module", F.when(F.col("l_linenumber") == 3, F.lit("")).otherwise(F.lit(" > Lesson")))
    asset = F.concat(F.lit("guide "), F.pmod("l_partkey", F.lit(40)).cast("string"), F.lit(" v2.pdf"))
    rows = _lines(spark, sf_dir).groupBy("l_orderkey", "item", path.alias("path")).agg(F.min(F.struct("l_linenumber", "l_partkey"))["l_partkey"].alias("k"), F.min(asset).alias("asset"))
    return rows.select(F.col("l_orderkey").alias("course"), F.concat_ws("|", "item", "path").alias("item_id"), F.col("item").alias("name"), "path", F.when(F.col("k") % 4 == 3, F.array("asset")).otherwise(F.array().cast("array<string>")).alias("assets"))


def report_claims_read(spark, sf_dir: str) -> DataFrame:
    return claims.report_claims(_reports(spark, sf_dir)).withColumnRenamed("course", "l_orderkey")


def localized_claims(spark, sf_dir: str) -> DataFrame:
    found = claims.localized(claims.report_claims(_reports(spark, sf_dir)), _items(spark, sf_dir))
    return found.select(F.col("course").alias("l_orderkey"), "type", "subject", "path", "excerpt", "item_id", "method")


def claimed_items(spark, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    bound = claims.localized(claims.report_claims(_reports(spark, sf_dir)), items)
    nothing = items.select("course", "item_id", F.lit(None).cast("string").alias("prompt")).limit(0)
    found = claims.claimed_items(bound, items, nothing)
    return found.groupBy(F.col("course").alias("l_orderkey"), "item_id", "type", "basis").agg(F.count("*").alias("claims"))


QUERIES = {f.__name__: f for f in (report_claims_read, localized_claims, claimed_items)}

_LINES = """lines AS (SELECT l_orderkey, l_linenumber, l_partkey, p_name || ' unit ' || (l_partkey % 40) AS item, 'Module ' || (l_suppkey % 3 + 1) || ' ' || p_brand AS module, l_partkey % 9 AS e, l_partkey % 2 = 0 AS named, (l_partkey % 40)::VARCHAR AS f FROM lineitem JOIN part ON p_partkey = l_partkey)"""
_TOLD = ["AI-Generated Mandatory Field The passing score was generated.", "Content Excluded The lab was left out.", "Unsupported Content Fallback The widget \"notes ' || f || '.html\" became a page.", "Content Adaptation The attachment \"guide ' || f || '.pdf\" could not be uploaded.",
         "Content Adaptation Tables are not allowed inside lists and were converted.", "AI-Generated Mandatory Field It generated the replacement reading content.", "Empty Module Structure Someone must recreate the question by hand.", "Content Adaptation A parsing failure stopped the unit."]
_TYPES = ["GENERATED_BEHAVIOR", "INTENTIONAL_EXCLUSION", "UNSUPPORTED_CONTENT_FALLBACK", "UNRESOLVED_SOURCE_ASSET", "CONTENT_MARKUP_ADAPTATION", "GENERATED_CONTENT_FALLBACK", "REPAIR_INSTRUCTION", "SI_PROCESSING_FAILURE"]
_SEVERITIES = ["REVIEW", "REVIEW", "REVIEW", "CRITICAL", "INFO", "REVIEW", "REVIEW", "CRITICAL"]
_CHOICE = lambda values: "CASE e " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"
_CLAIMS = f"""{_LINES}, told AS (SELECT *, {_CHOICE(_TOLD)} || CASE WHEN named THEN '' ELSE ' See ' || item || '.' END AS excerpt, {_CHOICE(_TYPES)} AS type, {_CHOICE(_SEVERITIES)} AS severity,
    CASE WHEN named THEN item ELSE '' END AS s, CASE e WHEN 2 THEN 'notes ' || f || '.html' WHEN 3 THEN 'guide ' || f || '.pdf' END AS file FROM lines WHERE e < 8),
claims AS (SELECT DISTINCT l_orderkey, type, severity, coalesce(file, s) AS subject, module AS path, excerpt, CASE WHEN file IS NOT NULL AND file <> s THEN type END AS original_type, CASE WHEN file IS NOT NULL AND file <> s THEN s END AS original_subject FROM told)"""
_ITEMS = """items AS (SELECT l_orderkey, item, path, item || '|' || path AS item_id, CASE WHEN arg_min(l_partkey, (l_linenumber, l_partkey)) % 4 = 3 THEN min('guide ' || f || ' v2.pdf') END AS asset
    FROM (SELECT *, module || CASE WHEN l_linenumber = 3 THEN '' ELSE ' > Lesson' END AS path FROM lines) GROUP BY l_orderkey, item, path)"""
_CLEAN = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_LOCAL = f"""{_CLAIMS}, {_ITEMS}, met AS (SELECT c.*, i.item_id FROM claims c JOIN items i ON i.l_orderkey = c.l_orderkey AND (i.path = c.path OR starts_with(i.path, c.path || ' '))
    AND ((c.subject <> '' AND i.item = c.subject) OR (c.subject = '' AND type IN ('GENERATED_BEHAVIOR', 'GENERATED_CONTENT_FALLBACK', 'SI_PROCESSING_FAILURE') AND contains(' ' || {_CLEAN.format('c.excerpt')} || ' ', ' ' || {_CLEAN.format('i.item')} || ' ')))),
alone AS (SELECT l_orderkey, type, subject, path, excerpt, min(item_id) AS item_id FROM met GROUP BY ALL HAVING count(*) = 1),
local AS (SELECT c.*, a.item_id, CASE WHEN a.item_id IS NULL THEN NULL WHEN c.subject = '' THEN 'UNIQUE_EXPLICIT_SOURCE_NAME_IN_MODULE' ELSE 'UNIQUE_EXACT_SOURCE_NAME_IN_MODULE' END AS method FROM claims c LEFT JOIN alone a USING (l_orderkey, type, subject, path, excerpt))"""
ORACLE_SQL = {
    "report_claims_read": f"WITH {_CLAIMS} SELECT l_orderkey, type, severity, subject, path, excerpt, original_type, original_subject FROM claims",
    "localized_claims": f"WITH {_LOCAL} SELECT l_orderkey, type, subject, path, excerpt, item_id, method FROM local",
    "claimed_items": f"""WITH {_LOCAL}, free AS (SELECT *, {_CLEAN.format('subject')} AS s, {_CLEAN.format('path')} AS h FROM local WHERE item_id IS NULL AND subject <> ''),
        named AS (SELECT *, {_CLEAN.format('item')} AS n, {_CLEAN.format('path')} AS p, {_CLEAN.format("coalesce(asset, '')")} AS a FROM items),
        hits AS (SELECT f.l_orderkey, f.type, f.subject, f.path, f.excerpt, i.item_id, CASE WHEN s = n OR (length(s) >= length(n) + 3 AND contains(s, n)) OR (length(n) >= length(s) + 3 AND contains(n, s)) THEN 'NAME' ELSE 'ASSET' END AS basis FROM free f JOIN named i ON i.l_orderkey = f.l_orderkey
          AND (s = n OR (length(s) >= length(n) + 3 AND contains(s, n)) OR (length(n) >= length(s) + 3 AND contains(n, s)) OR (a <> '' AND (contains(s, a) OR contains(a, s))))
          AND regexp_extract(h, 'module (\\d+)', 1) = regexp_extract(p, 'module (\\d+)', 1) AND (contains(p, h) OR contains(h, p) OR (SELECT CASE WHEN contains(x, y) OR contains(y, x) THEN 0.9 ELSE 1 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y)) END FROM (SELECT replace(p, ' ', '') AS x, replace(h, ' ', '') AS y)) >= 0.78)),
        every AS (SELECT l_orderkey, item_id, type, excerpt, basis FROM hits UNION ALL SELECT l_orderkey, item_id, type, excerpt, 'BOUND' FROM local WHERE item_id IS NOT NULL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, item_id ORDER BY type, excerpt) AS r FROM every)
        SELECT l_orderkey, item_id, type, basis, count(*) AS claims FROM ranked WHERE r <= 14 GROUP BY ALL""",
}
