"""Queries over evidence from several captures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.operators import evidence
from veriframe.sources.tables import table


def merged_evidence(spark, sf_dir: str) -> DataFrame:
    """Flags and status of each part from its order lines, later shipments first."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", F.when(F.col("l_discount") > 0.05, F.col("l_returnflag")).alias("flag"), F.when(F.col("l_tax") > 0.04, F.col("l_linestatus")).alias("status"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("p"))
    return evidence.merged_evidence(li, "l_partkey", ["flag", "status"], "p")


def traversal_summary(spark, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return evidence.traversal(o.select("o_custkey", F.col("o_orderkey").alias("k")), li.where("l_returnflag != 'A'").select(F.col("l_orderkey").alias("k")), "k", "o_custkey")


def traversal_gap(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    results = o.select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", "MISSING").otherwise("VERIFIED").alias("verdict"))
    rows = evidence.with_traversal_gap(results, traversal_summary(spark, sf_dir), "o_custkey")
    return rows.groupBy("verdict", "demoted").agg(F.count("*").alias("items"))


def late_recovery(spark, sf_dir: str) -> DataFrame:
    """Labels and languages of documents, missing qualities taken from toxicity."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 2000, F.col("lang")).alias("lang"), F.lit(None).cast("int").alias("quality"))
    late = table(spark, sf_dir, "labels").select("doc_id", F.lit("xx").alias("lang"), "quality")
    return evidence.recovered(d, late, "doc_id", ["lang", "quality"]).select("doc_id", "lang", "quality", "recovered")


def gated_verdicts(spark, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    state = lambda c, high, low: F.when(F.col(c) > high, "VERIFIED").when(F.col(c) > low, "UNVERIFIED").otherwise("FAILED")
    status = F.create_map(F.lit("content"), state("l_discount", 0.02, 0.0), F.lit("assets"), state("l_tax", 0.01, -1.0))
    required = F.when(F.col("l_quantity") > 25, F.array(F.lit("content"), F.lit("assets"))).when(F.col("l_quantity") > 5, F.array(F.lit("content"))).otherwise(F.array(F.lit("runtime")))
    verdict = F.when(F.col("l_returnflag") == "R", "MOVED").otherwise("VERIFIED")
    return li.groupBy("l_returnflag", evidence.gated_verdict(verdict, required, status).alias("verdict")).agg(F.count("*").alias("items"))


def owner_actions(spark, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    issues = F.array_compact(F.array(F.when(F.col("l_tax") > 0.06, "MISSING_ASSET"), F.when(F.col("l_discount") > 0.08, "CONTENT_CHANGED"), F.when(F.col("l_quantity") > 45, "LINK_NOT_OBSERVED")))
    verdict = F.when(F.col("l_linenumber") == 7, "MISSING").when(F.col("l_returnflag") == "N", "UNVERIFIED").otherwise("VERIFIED")
    return li.groupBy(evidence.owner_action(verdict, issues).alias("a")).agg(F.count("*").alias("items")).select("a.severity", "a.action", "items")


def evidence_strength(spark, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    s = evidence.strength(F.col("l_quantity") * 2, 100 - F.col("l_discount") * 100, F.col("l_linenumber"), F.col("l_returnflag") == "A")
    return li.groupBy("l_returnflag", s["label"].alias("label")).agg(F.count("*").alias("items"), F.round(F.avg(s["value"]), 4).alias("average"))


def question_identity(spark, sf_dir: str) -> DataFrame:
    """User turns against the other turns: the whole text is the prompt, its lines are the options."""
    c = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("text").alias("prompt"), F.split("text", "\n").alias("options"), "role")
    return evidence.question_identity(c.where("role = 'user'"), c.where("role != 'user'"))


def merged_reviews(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return evidence.merged_reviews(o, ["o_custkey"], "o_orderdate", "o_orderstatus").select("o_custkey", "o_orderstatus")


def attempt_chains(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), F.floor("value").alias("generation"), (F.col("event_id") - 1).alias("base"))
    return evidence.attempt_chain(e, "user_id")


def import_preview(spark, sf_dir: str) -> DataFrame:
    """Customers that break the rules of an import, by the rules they break."""
    c = table(spark, sf_dir, "customer")
    rules = {"balance": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "FURNITURE"), "name": F.length("c_name") == 18}
    good, bad = evidence.checked_rows(c, rules)
    return bad.groupBy("problems").agg(F.count("*").alias("rows")).union(good.agg(F.lit("").alias("problems"), F.count("*").alias("rows")))


QUERIES = {f.__name__: f for f in (
    merged_evidence, traversal_summary, traversal_gap, late_recovery, gated_verdicts, owner_actions, evidence_strength, question_identity, merged_reviews, attempt_chains, import_preview,
)}

_TRAVERSAL = """WITH s AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag <> 'A'),
    t AS (SELECT o_custkey, count(*) AS eligible, count(s.k) AS visited, count(*) = count(s.k) AS complete FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders) LEFT JOIN s ON k = o_orderkey GROUP BY o_custkey)"""
_NAME = r"trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_KEY = f"sha256(concat_ws(chr(1), {_NAME.format('text')}, array_to_string([{_NAME.format('x')} FOR x IN string_split(text, chr(10))], chr(1))))"

ORACLE_SQL = {
    "merged_evidence": """WITH l AS (SELECT l_partkey, CASE WHEN l_discount > 0.05 THEN l_returnflag END AS f, CASE WHEN l_tax > 0.04 THEN l_linestatus END AS s,
        {'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber, 'd': l_suppkey, 'e': l_extendedprice} AS p FROM lineitem)
        SELECT l_partkey, arg_max(f, p) FILTER (f IS NOT NULL) AS flag, arg_max(s, p) FILTER (s IS NOT NULL) AS status, count(*) AS captures FROM l GROUP BY l_partkey""",
    "traversal_summary": f"{_TRAVERSAL} SELECT * FROM t",
    "traversal_gap": f"""{_TRAVERSAL}, r AS (SELECT o_orderstatus = 'F' AND NOT complete AS demoted, o_orderstatus FROM orders JOIN t USING (o_custkey))
        SELECT CASE WHEN demoted THEN 'UNVERIFIED' WHEN o_orderstatus = 'F' THEN 'MISSING' ELSE 'VERIFIED' END AS verdict, demoted, count(*) AS items FROM r GROUP BY ALL""",
    "late_recovery": """SELECT doc_id, coalesce(CASE WHEN n_chars > 2000 THEN lang END, CASE WHEN l.doc_id IS NOT NULL THEN 'xx' END) AS lang, quality,
        array_to_string(list_filter([CASE WHEN n_chars <= 2000 AND l.doc_id IS NOT NULL THEN 'lang' END, CASE WHEN quality IS NOT NULL THEN 'quality' END], lambda x: x IS NOT NULL), ',') AS recovered
        FROM documents d LEFT JOIN (SELECT doc_id, quality FROM labels) l USING (doc_id)""",
    "gated_verdicts": """WITH s AS (SELECT l_returnflag, l_quantity, CASE WHEN l_discount > 0.02 THEN 'V' WHEN l_discount > 0 THEN 'U' ELSE 'F' END AS c, CASE WHEN l_tax > 0.01 THEN 'V' ELSE 'U' END AS a FROM lineitem)
        SELECT l_returnflag, CASE WHEN l_returnflag = 'R' THEN 'MOVED' WHEN l_quantity <= 5 THEN 'UNVERIFIED' WHEN c = 'F' THEN 'PARTIAL' WHEN c = 'U' OR (l_quantity > 25 AND a = 'U') THEN 'UNVERIFIED' ELSE 'VERIFIED' END AS verdict, count(*) AS items
        FROM s GROUP BY ALL""",
    "owner_actions": """WITH a AS (SELECT CASE WHEN l_linenumber = 7 THEN 'CRITICAL RESTORE_ITEM' WHEN l_tax > 0.06 THEN 'HIGH RESTORE_ASSET' WHEN l_discount > 0.08 THEN 'HIGH REVIEW_CONTENT' WHEN l_quantity > 45 THEN 'MEDIUM CHECK_LINKS'
        WHEN l_returnflag = 'N' THEN 'INFO CAPTURE_AGAIN' ELSE 'NONE NONE' END AS x FROM lineitem) SELECT split_part(x, ' ', 1) AS severity, split_part(x, ' ', 2) AS action, count(*) AS items FROM a GROUP BY ALL""",
    "evidence_strength": """WITH v AS (SELECT l_returnflag, round(least(CASE WHEN l_returnflag = 'A' THEN 60 ELSE 100 END, greatest(0, l_quantity * 2 * 0.7::DOUBLE + (100 - l_discount * 100) * 0.3::DOUBLE + least(l_linenumber, 5) * 2)), 6) AS v,
          least(CASE WHEN l_returnflag = 'A' THEN 60 ELSE 100 END, greatest(0, l_quantity * 2 * 0.7::DOUBLE + (100 - l_discount * 100) * 0.3::DOUBLE + least(l_linenumber, 5) * 2)) AS r FROM lineitem)
        SELECT l_returnflag, CASE WHEN r >= 95 THEN 'DEFINITIVE' WHEN r >= 85 THEN 'STRONG' WHEN r >= 70 THEN 'MODERATE' ELSE 'LIMITED' END AS label, count(*) AS items, round(avg(v), 4) AS average FROM v GROUP BY ALL""",
    "question_identity": f"""WITH q AS (SELECT concat_ws(':', conv_id, turn) AS id, role = 'user' AS mine, {_KEY} AS key FROM conversations),
        s AS (SELECT key, count(*) AS n FROM q WHERE mine GROUP BY key), t AS (SELECT key, count(*) AS m, min(id) AS target FROM q WHERE NOT mine GROUP BY key)
        SELECT id, CASE WHEN m IS NULL THEN 'NONE' WHEN n = 1 AND m = 1 THEN 'EXACT' ELSE 'AMBIGUOUS' END AS kind, CASE WHEN n = 1 AND m = 1 THEN target END AS target_id FROM q JOIN s USING (key) LEFT JOIN t USING (key) WHERE mine""",
    "merged_reviews": """WITH l AS (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey) AS last FROM orders)
        SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 'CONFLICT' ELSE min(o_orderstatus) END AS o_orderstatus FROM l WHERE o_orderdate = last GROUP BY o_custkey""",
    "attempt_chains": """WITH e AS (SELECT user_id, event_id AS id, floor(value)::BIGINT AS generation, event_id - 1 AS base FROM events),
        l AS (SELECT *, lag(id) OVER w AS before, lag(generation) OVER w AS prior FROM e WINDOW w AS (PARTITION BY user_id ORDER BY generation, id))
        SELECT user_id, max(generation) AS generation, arg_max(id, {'a': generation, 'b': id}) AS current, count(*) FILTER (before IS NOT NULL AND (base IS DISTINCT FROM before OR generation <> prior + 1)) AS breaks FROM l GROUP BY user_id""",
    "import_preview": """WITH p AS (SELECT array_to_string(list_filter([CASE WHEN NOT c_acctbal >= 0 THEN 'balance' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE') THEN 'segment' END, CASE WHEN length(c_name) <> 18 THEN 'name' END], lambda x: x IS NOT NULL), ',') AS problems FROM customer)
        SELECT problems, count(*) AS rows FROM p GROUP BY problems""",
}
