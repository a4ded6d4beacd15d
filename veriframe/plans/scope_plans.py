"""Queries over scope, extra items, times and identities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.operators import scope
from veriframe.sources.tables import table

_ROOTS = ("low area", "archive")


def _tasks(spark, sf_dir: str) -> DataFrame:
    """Orders as tasks of their customers."""
    o = table(spark, sf_dir, "orders")
    k = lambda n: F.pmod("o_orderkey", F.lit(n))
    area = F.when(k(7) == 0, "Instructor Resources / unit").when(k(7) == 1, "Unit | ARCHIVES").when(k(7) == 2, "About archives > unit").otherwise("Unit > page")
    choice = F.when(k(5) == 0, "relevant").when(k(5) == 1, "not_relevant").when(k(5) == 2, "auto")
    sources = F.when(k(3) == 0, F.array(F.lit("archive > a"), F.lit("x / Archive"))).when(k(3) == 1, F.array(F.lit("archive"), F.lit("unit"))).otherwise(F.array().cast("array<string>"))
    return o.select("*", area.alias("path"), choice.alias("choice"), sources.alias("sources"), (k(2) == 0).alias("source_only"))


def owner_scopes(spark, sf_dir: str) -> DataFrame:
    """Tasks by whether and why they are in scope, and how many of them need an owner."""
    t = _tasks(spark, sf_dir).withColumn("s", scope.owner_scope(F.col("path"), F.col("source_only"), F.col("sources"), F.col("choice")))
    actions = F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("NONE"), F.lit("FIX"))).when(F.col("o_orderpriority") == "2-HIGH", F.array(F.lit("NONE")))
    needed = scope.needs_action(F.col("s.included"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F"), actions)
    return t.groupBy(scope.path_root(F.col("path")).alias("root"), "s.included", "s.why").agg(F.count("*").alias("tasks"), F.count_if(needed).alias("needed"))


def time_totals(spark, sf_dir: str) -> DataFrame:
    """Minutes of tasks by customer, as planned and as observed later."""
    t = _tasks(spark, sf_dir).withColumn("s", scope.owner_scope(F.col("path"), F.lit(False), F.col("sources"), F.col("choice")))
    minutes = F.pmod("o_orderkey", F.lit(50))
    first = F.struct(F.when(minutes > 4, minutes).alias("minutes"), F.col("o_orderdate").alias("captured_at"))
    later = F.struct(F.when(minutes < 40, minutes + 3).alias("minutes"), F.when(minutes != 9, F.col("o_orderdate") + F.expr("INTERVAL 1 DAY") * (minutes % 3 - 1)).alias("captured_at"))
    rows = t.select("o_custkey", F.col("s.included").alias("included"), first.alias("baseline"), F.when(minutes > 20, later).alias("observed"))
    return scope.time_totals(rows, ["o_custkey"])


def _extras(spark, sf_dir: str) -> DataFrame:
    """Products as extra items of their brands."""
    p = table(spark, sf_dir, "part")
    k = lambda n: F.pmod("p_partkey", F.lit(n))
    name = F.when(k(6) == 0, "Author's eyes only").when(k(6) == 1, "Untitled").when(k(6) == 2, "Student Resources").otherwise(F.col("p_name"))
    path = F.when(k(4) == 0, "Low Area/x").when(k(4) == 1, "low area: y").when(k(4) == 2, "Low areas > z").otherwise("main > z")
    kind = scope.extra_class(name, path, F.col("p_size") == 3, F.when(F.col("p_size") == 4, "PARTIAL").when(F.col("p_size") == 5, "FULL"), F.when(F.col("p_size") == 6, F.array(F.lit(""), F.lit("s"))).otherwise(F.array(F.lit(""))))
    return p.select("p_partkey", "p_brand", "p_size", kind.alias("kind"), scope.in_decision_gate(path, _ROOTS).alias("gate"))


def extra_items(spark, sf_dir: str) -> DataFrame:
    rows = _extras(spark, sf_dir).withColumn("policy", scope.extra_policy(F.col("kind"), F.col("gate")))
    return rows.groupBy("kind.class", "kind.severity", "gate", "policy").agg(F.count("*").alias("items"))


def course_failures(spark, sf_dir: str) -> DataFrame:
    """Types of products as courses: those with size 50 are what a source has, few of the others what a target has."""
    p = table(spark, sf_dir, "part").withColumn("course", F.concat_ws("/", "p_type", F.pmod("p_partkey", F.lit(12))))
    targets = _extras(spark, sf_dir).join(p.select("p_partkey", "course"), "p_partkey").where("p_size between 2 and 4").select("course", "kind.class", "gate")
    return scope.course_failure(p.select("course", (F.col("p_size") > 5).alias("counts")), targets, "course")


def item_identities(spark, sf_dir: str) -> DataFrame:
    """Order lines under ids of order, product and a flag that may be missing."""
    li = table(spark, sf_dir, "lineitem")
    rows = scope.identified(li.select(F.col("l_orderkey").cast("string").alias("a"), F.concat(F.lit('p"'), F.pmod("l_partkey", F.lit(3))).alias("b"), F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("c")), ["a", "b", "c"])
    return rows.groupBy("item_id").agg(F.count("*").alias("items"), F.bool_or("ambiguous").alias("ambiguous"))


def canonical_values(spark, sf_dir: str) -> DataFrame:
    """Supplier attributes as JSON with ordered keys, and values put right."""
    s = table(spark, sf_dir, "supplier")
    values = F.create_map(F.lit("name"), F.col("s_name"), F.lit("key"), F.col("s_suppkey").cast("string"), F.lit("a"), F.lit('x"y'))
    raw = F.when(F.col("s_suppkey") % 4 == 0, F.lit("none")).otherwise(F.col("s_acctbal").cast("string"))
    return s.select(
        "s_suppkey", scope.canonical_json(values).alias("json"), scope.whole_number(raw).alias("whole"), F.array_join(scope.unique_strings(F.array(F.lit(" a "), F.lit("a"), F.col("s_name"), F.lit(""), F.lit("z"), F.lit("y")), 3), "|").alias("names"),
        scope.one_of(F.when(F.col("s_suppkey") % 2 == 0, "DONE"), ("OPEN", "DONE"), "OPEN").alias("state"),
    )


def _aggregates(spark, sf_dir: str, least: int) -> DataFrame:
    """Orders with their lines as items; the first line stands for several others."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_linenumber") >= least)
    own = F.col("l_suppkey").cast("string")
    made = F.concat(F.lit("cti-aggregate:"), own)
    kids = F.when(F.col("l_linenumber") == 1, F.array(F.concat(F.lit(" "), F.col("l_partkey").cast("string")), own, F.lit("cti-aggregate:z"), F.lit("")))
    return li.select("l_orderkey", F.when(F.col("l_linenumber") == 1, made).otherwise(own).alias("id"), kids.alias("children"))


def physical_ids(spark, sf_dir: str) -> DataFrame:
    return scope.physical_ids(_aggregates(spark, sf_dir, 1), "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("ids"), F.min("id").alias("first"))


def obsolete_guards(spark, sf_dir: str) -> DataFrame:
    """Guards of orders that took their made-up first line for missing."""
    base = _aggregates(spark, sf_dir, 1)
    seen = scope.physical_ids(base, "l_orderkey").where(F.pmod("l_orderkey", F.lit(3)) != 0).select("l_orderkey", "id", F.lit(None).cast("array<string>").alias("children"))
    guards = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.pmod("o_orderkey", F.lit(2)) + 1).alias("missing"))
    return scope.obsolete_stage_guard(guards, base, seen, "l_orderkey")


def exact_replays(spark, sf_dir: str) -> DataFrame:
    """Documents whose text and language hashes are the same in two captures."""
    d = table(spark, sf_dir, "documents").select("source", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("a"), F.sha2(F.coalesce("lang", F.lit("")), 256).alias("b"))
    again = (F.upper("a"), F.when(F.col("n_chars") % 3 != 0, F.col("b")))
    return d.groupBy(scope.exact_replay((F.col("a"), F.col("b")), again, F.when(F.col("n_chars") % 7 < 6, F.col("n_chars") % 7 == 1)).alias("replay")).agg(F.count("*").alias("documents"))


QUERIES = {f.__name__: f for f in (owner_scopes, time_totals, extra_items, course_failures, item_identities, canonical_values, physical_ids, obsolete_guards, exact_replays)}

_TASKS = """t AS (SELECT *, o_orderkey % 7 AS a, o_orderkey % 5 AS c, o_orderkey % 3 AS s, o_orderkey % 2 = 0 AS source_only FROM orders)"""
_EXTRAS = """e AS (SELECT p_partkey, p_brand, p_size, CASE WHEN p_size = 3 THEN 'INGESTION_FAILURE_EXTRA' WHEN p_size = 4 THEN 'PARTIAL_SOURCE_ASSET_CARRIER' WHEN p_size = 5 THEN 'SOURCE_ASSET_CARRIER' WHEN p_size = 6 THEN 'CONSOLIDATION_CARRIER'
    WHEN p_partkey % 6 = 0 THEN 'ADMIN_EXTRA' WHEN p_partkey % 6 = 1 THEN 'PLACEHOLDER_EXTRA' WHEN p_partkey % 6 = 2 THEN 'TEMPLATE_EXTRA' ELSE 'CONTENT_EXTRA' END AS class, p_partkey % 4 > 1 AS gate FROM part)"""
_BASE = """b AS (SELECT l_orderkey, l_linenumber = 1 AS made, l_suppkey::VARCHAR AS own, l_partkey::VARCHAR AS kid FROM lineitem),
    ids AS (SELECT DISTINCT l_orderkey, own AS id FROM b UNION SELECT l_orderkey, kid FROM b WHERE made)"""

ORACLE_SQL = {
    "owner_scopes": f"""WITH {_TASKS}, w AS (SELECT *, CASE WHEN c = 0 THEN 'OWNER_IN' WHEN c = 1 THEN 'OWNER_OUT' WHEN a < 2 OR (source_only AND s = 0) THEN 'REFERENCE_AREA' ELSE 'DEFAULT' END AS why FROM t)
        SELECT CASE a WHEN 0 THEN 'instructor resources' WHEN 2 THEN 'about archives' ELSE 'unit' END AS root, why IN ('OWNER_IN', 'DEFAULT') AS included, why, count(*) AS tasks,
          count(*) FILTER (why IN ('OWNER_IN', 'DEFAULT') AND (o_orderstatus <> 'F' OR o_orderpriority = '1-URGENT')) AS needed FROM w GROUP BY ALL""",
    "time_totals": f"""WITH {_TASKS}, m AS (SELECT o_custkey, c = 0 OR (c <> 1 AND a > 1) AS inc, o_orderkey % 50 AS m FROM t), n AS (SELECT *, CASE WHEN m > 4 THEN m END AS f, m > 20 AND m % 3 > 0 AS newer FROM m),
        l AS (SELECT *, CASE WHEN newer THEN CASE WHEN m < 40 THEN m + 3 END ELSE f END AS g FROM n)
        SELECT o_custkey, count(*) FILTER (inc) AS total, count(*) FILTER (NOT inc) AS excluded, coalesce(sum(f) FILTER (inc), 0)::BIGINT AS baseline_minutes, count(f) FILTER (inc) AS baseline_captured, coalesce(sum(g) FILTER (inc), 0)::BIGINT AS latest_minutes,
          count(g) FILTER (inc) AS latest_captured, count(*) FILTER (inc AND g IS NULL) AS missing, count(*) FILTER (inc AND newer) AS refreshed FROM l GROUP BY o_custkey""",
    "extra_items": f"""WITH {_EXTRAS}, s AS (SELECT *, CASE WHEN class = 'INGESTION_FAILURE_EXTRA' THEN 'CRITICAL' WHEN class IN ('CONSOLIDATION_CARRIER', 'ADMIN_EXTRA', 'TEMPLATE_EXTRA') THEN 'INFO' ELSE 'REVIEW' END AS severity FROM e)
        SELECT class, severity, gate, CASE WHEN class = 'INGESTION_FAILURE_EXTRA' AND gate THEN 'FORCE_REINGEST' WHEN NOT gate THEN 'POLICY_EXEMPT' WHEN severity = 'INFO' OR class = 'SOURCE_ASSET_CARRIER' THEN 'INFORMATIONAL' ELSE 'REVIEW' END AS policy, count(*) AS items FROM s GROUP BY ALL""",
    "course_failures": f"""WITH {_EXTRAS}, p AS (SELECT p_partkey, p_size, p_type || '/' || p_partkey % 12 AS course FROM part), s AS (SELECT course, count(*) FILTER (p_size > 5) AS n FROM p GROUP BY course),
        t AS (SELECT course, count(*) FILTER (class NOT IN ('ADMIN_EXTRA', 'PLACEHOLDER_EXTRA', 'TEMPLATE_EXTRA') AND gate) AS m FROM e JOIN p USING (p_partkey) WHERE p.p_size BETWEEN 2 AND 4 GROUP BY course)
        SELECT course, n AS source_items, coalesce(m, 0) AS target_items, CASE WHEN n >= 5 AND coalesce(m, 0) = 0 THEN 'EMPTY' WHEN n >= 10 AND coalesce(m, 0) <= 1 THEN 'NEAR_EMPTY' ELSE '' END AS code FROM s LEFT JOIN t USING (course)""",
    "item_identities": r"""WITH i AS (SELECT CASE WHEN l_returnflag <> 'A' THEN 'item-' || sha256('["' || l_orderkey || '","p\"' || l_partkey % 3 || '","' || l_returnflag || '"]') END AS item_id FROM lineitem)
        SELECT item_id, count(*) AS items, item_id IS NOT NULL AND count(*) > 1 AS ambiguous FROM i GROUP BY item_id""",
    "canonical_values": r"""SELECT s_suppkey, '{"a":"x\"y","key":"' || s_suppkey || '","name":"' || s_name || '"}' AS json, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE greatest(0, floor(s_acctbal))::BIGINT END AS whole, 'a|' || s_name || '|z' AS names,
        CASE WHEN s_suppkey % 2 = 0 THEN 'DONE' ELSE 'OPEN' END AS state FROM supplier""",
    "physical_ids": f"""WITH {_BASE} SELECT l_orderkey, count(*) AS ids, min(id) AS first FROM ids GROUP BY l_orderkey""",
    "obsolete_guards": f"""WITH {_BASE}, k AS (SELECT l_orderkey, count(DISTINCT own) FILTER (made) AS n FROM b GROUP BY l_orderkey)
        SELECT o_orderkey AS l_orderkey, coalesce(o_orderkey % 3 <> 0 AND n = o_orderkey % 2 + 1, false) AS obsolete FROM orders LEFT JOIN k ON l_orderkey = o_orderkey""",
    "exact_replays": """SELECT n_chars % 3 <> 0 AND n_chars % 7 <> 1 AS replay, count(*) AS documents FROM documents GROUP BY ALL""",
}
