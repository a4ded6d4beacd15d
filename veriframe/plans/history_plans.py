"""Queries over versions, ledgers, sequences and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriframe.operators import duplicates, history, trees
from veriframe.sources.tables import table


def _snapshots(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    before = o.where("o_orderpriority != '1-URGENT'").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    moved = F.when(F.col("o_totalprice") > 400_000, "X").otherwise(F.col("o_orderstatus"))
    unseen = F.when(F.col("o_totalprice") >= 50_000, F.col("o_orderpriority"))
    after = o.where("o_orderstatus != 'F'").select("o_orderkey", moved.alias("status"), unseen.alias("priority"))
    return before, after


def snapshot_diff(spark, sf_dir: str) -> DataFrame:
    before, after = _snapshots(spark, sf_dir)
    return history.snapshot_diff(before, after, "o_orderkey", ["status", "priority"])


def snapshot_diff_summary(spark, sf_dir: str) -> DataFrame:
    return snapshot_diff(spark, sf_dir).groupBy("kind", "fields").agg(F.count("*").alias("items"))


def latest_audit(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return duplicates.latest(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


def _audits(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(
        F.col("o_custkey").alias("package_id"), F.col("o_orderkey").alias("id"), "o_orderdate", F.row_number().over(w).alias("generation"),
        F.col("o_orderstatus").alias("mode"), F.col("o_orderpriority").alias("summary"), F.floor(F.col("o_totalprice") / 1000).alias("input_hash"),
    )


def repeated_exports(spark, sf_dir: str) -> DataFrame:
    return history.repeated_exports(_audits(spark, sf_dir), [F.col("o_orderdate"), F.col("id")], ["mode", "summary"], "input_hash")


def lineage_breaks(spark, sf_dir: str) -> DataFrame:
    """Attempts whose base is not the attempt before: the base of an order is the last one of the same status."""
    w = Window.partitionBy("package_id").orderBy("generation")
    rows = _audits(spark, sf_dir).withColumn("previous", F.lag("id").over(w))
    same = Window.partitionBy("package_id", "mode").orderBy("generation")
    rows = rows.withColumn("base", F.lag("id").over(same)).where("previous is not null and not (base <=> previous)")
    return rows.groupBy("package_id").agg(F.count("*").alias("breaks"), F.min("id").alias("first"))


def _ledger(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("view", "click"), "stage").when(F.col("event_type") == "error", "note").otherwise("decision")
    events = e.select(F.col("user_id").alias("item_id"), F.col("event_id").alias("sequence"), kind.alias("kind"), F.col("event_type").alias("value"), F.pmod("event_id", F.lit(3)).alias("fingerprint"))
    current = e.select(F.col("user_id").alias("item_id")).distinct().union(spark.range(1).select(F.lit(-1).cast("long"))).select("item_id", F.pmod("item_id", F.lit(4)).alias("fingerprint"))
    return events, current


def event_ledger_fold(spark, sf_dir: str) -> DataFrame:
    return history.ledger_state(*_ledger(spark, sf_dir))


def edit_freshness(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    edits = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("edited_at"))
    reports = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("captured_at"), F.floor("value").alias("input_hash"))
    return history.freshness(edits, reports, "user_id").select("user_id", "state")


def interval_union(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    spans = e.select("event_type", start.alias("start"), (start + F.floor(F.col("value") * 60_000_000)).alias("stop"))
    return history.interval_union(spans, "event_type")


def role_runs(spark, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return history.islands(c, ["conv_id"], ["turn"], "role").select("conv_id", F.col("island").cast("long").alias("island"), "role", "first", "last", "n")


def event_runs(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return history.islands(e, ["user_id"], ["event_id"], "event_type").where("n >= 3").select("user_id", "event_type", "first", "last", "n")


def module_forward_fill(spark, sf_dir: str) -> DataFrame:
    """Purchases and signups carry down to the rows after them, as module and lesson lines do in a course sheet."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    seen = {"module": F.when(F.col("event_type") == "signup", F.col("event_id")), "lesson": F.when(F.col("event_type") == "purchase", F.col("event_id"))}
    rows = history.carried_forward(e, ["user_id"], ["event_id"], seen)
    return rows.groupBy("user_id", "module").agg(F.count("*").alias("items"), F.count_distinct("lesson").alias("lessons"), F.round(F.sum("value"), 2).alias("minutes"))


def text_budget(spark, sf_dir: str) -> DataFrame:
    """Documents that fit into each source's budget of characters, in order of id."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    rows = history.within_budget(d, ["source"], ["doc_id"], "n_chars", 60_000)
    return rows.groupBy("source").agg(F.count_if("kept").alias("kept"), F.count("*").alias("documents"), F.sum(F.when(F.col("kept"), F.col("n_chars"))).alias("chars"))


def chunk_reassembly(spark, sf_dir: str) -> DataFrame:
    return history.chunk_contiguity(table(spark, sf_dir, "conversations"), "conv_id", "turn")


def multiset_contract(spark, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag")
    return history.multiset_difference(li.where("l_returnflag != 'N'").select("l_partkey"), li.where("l_returnflag != 'R'").select("l_partkey"), ["l_partkey"])


def ordered_contract(spark, sf_dir: str) -> DataFrame:
    """Orders whose line numbers, sorted, skip or repeat."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lag("l_linenumber").over(w).alias("prior"))
    step = F.col("l_linenumber") - F.coalesce("prior", F.lit(0))
    return li.groupBy("l_orderkey").agg(F.count_if(step > 1).alias("skips"), F.count_if(step == 0).alias("repeats")).where("skips + repeats > 3")


def _nodes(spark, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.concat("r_name", F.when(F.col("r_regionkey") == 2, " Archive").otherwise("")).alias("title"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("title"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node_id"), F.concat(F.lit("n"), "s_nationkey").alias("parent_id"), F.col("s_name").alias("title"))
    return r.union(n).union(s)


def hierarchy_paths(spark, sf_dir: str) -> DataFrame:
    return trees.paths(_nodes(spark, sf_dir))


def tree_diagnostics(spark, sf_dir: str) -> DataFrame:
    """Nodes and leaves by depth, on and off administrative branches."""
    nodes = _nodes(spark, sf_dir)
    walked = trees.paths(nodes)
    children = nodes.groupBy("parent_id").agg(F.count("*").alias("children")).withColumnRenamed("parent_id", "node_id")
    return walked.join(children, "node_id", "left").groupBy("depth", "administrative").agg(
        F.count("*").alias("nodes"), F.count_if(F.col("children").isNull()).alias("leaves"), F.max(F.coalesce("children", F.lit(0))).alias("widest")
    )


def _edges(spark, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("src"), F.pmod(F.col("n_nationkey") * 2 + 1, F.lit(25)).alias("dst")).union(n.where("n_nationkey % 4 = 0").select("n_nationkey", F.pmod(F.col("n_nationkey") + 5, F.lit(25))))


def dependency_closure(spark, sf_dir: str) -> DataFrame:
    """What each node of a cyclic dependency graph reaches."""
    return trees.closure(_edges(spark, sf_dir)).groupBy("root").agg(F.count("*").alias("reached"), F.max("depth").alias("deepest"))


def json_props(spark, sf_dir: str) -> DataFrame:
    """Declared values of event properties; absent, null and present kept apart."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("events"), F.count(k).alias("declared"), F.sum(k).alias("total"), F.count_if(F.get_json_object("props", "$.missing").isNull()).alias("absent"))


QUERIES = {f.__name__: f for f in (
    snapshot_diff, snapshot_diff_summary, latest_audit, repeated_exports, lineage_breaks, event_ledger_fold, edit_freshness, interval_union, role_runs, event_runs,
    module_forward_fill, text_budget, chunk_reassembly, multiset_contract, ordered_contract, hierarchy_paths, tree_diagnostics, dependency_closure, json_props,
)}

_DIFF = """WITH b AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p FROM orders WHERE o_orderpriority <> '1-URGENT'),
    a AS (SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'X' ELSE o_orderstatus END AS s, CASE WHEN o_totalprice >= 50000 THEN o_orderpriority END AS p FROM orders WHERE o_orderstatus <> 'F'),
    j AS (SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, b.o_orderkey AS kb, a.o_orderkey AS ka,
        array_to_string(list_filter([CASE WHEN b.s <> a.s THEN 'status' END, CASE WHEN b.p <> a.p THEN 'priority' END], lambda x: x IS NOT NULL), ',') AS f FROM b FULL JOIN a ON a.o_orderkey = b.o_orderkey),
    d AS (SELECT o_orderkey, CASE WHEN kb IS NULL THEN 'AFTER_ONLY' WHEN ka IS NULL THEN 'BEFORE_ONLY' WHEN f <> '' THEN 'CHANGED' ELSE 'STABLE' END AS kind, CASE WHEN kb IS NOT NULL AND ka IS NOT NULL THEN f END AS fields FROM j)"""
_AUDITS = """WITH a AS (SELECT o_custkey AS package_id, o_orderkey AS id, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS generation,
    o_orderstatus AS mode, o_orderpriority AS summary, floor(o_totalprice / 1000)::BIGINT AS input_hash FROM orders)"""
_TREE = """WITH RECURSIVE n AS (SELECT 'r' || r_regionkey AS node_id, NULL AS parent_id, r_name || CASE WHEN r_regionkey = 2 THEN ' Archive' ELSE '' END AS title FROM region
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier),
    w AS (SELECT node_id, 0 AS depth, title AS path, contains(lower(title), 'archive') AS administrative FROM n WHERE parent_id IS NULL
      UNION ALL SELECT n.node_id, w.depth + 1, w.path || ' > ' || n.title, w.administrative OR contains(lower(n.title), 'archive') FROM w JOIN n ON n.parent_id = w.node_id)"""

ORACLE_SQL = {
    "snapshot_diff": f"{_DIFF} SELECT * FROM d",
    "snapshot_diff_summary": f"{_DIFF} SELECT kind, fields, count(*) AS items FROM d GROUP BY ALL",
    "latest_audit": "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "repeated_exports": f"""{_AUDITS}, l AS (SELECT *, lag(id) OVER w AS pid, lag(generation) OVER w AS pg, lag(mode) OVER w AS pm, lag(summary) OVER w AS ps, lag(input_hash) OVER w AS ph
        FROM a WINDOW w AS (PARTITION BY package_id ORDER BY o_orderdate, id))
        SELECT package_id, pid AS previous, id FROM l WHERE pid IS NOT NULL AND generation = pg + 1 AND mode IS NOT DISTINCT FROM pm AND summary IS NOT DISTINCT FROM ps AND input_hash <> ph""",
    "lineage_breaks": f"""{_AUDITS}, l AS (SELECT *, lag(id) OVER (PARTITION BY package_id ORDER BY generation) AS previous, lag(id) OVER (PARTITION BY package_id, mode ORDER BY generation) AS base FROM a)
        SELECT package_id, count(*) AS breaks, min(id) AS first FROM l WHERE previous IS NOT NULL AND base IS DISTINCT FROM previous GROUP BY package_id""",
    "event_ledger_fold": """WITH e AS (SELECT user_id AS item_id, event_id AS sequence, CASE WHEN event_type IN ('view', 'click') THEN 'stage' WHEN event_type = 'error' THEN 'note' ELSE 'decision' END AS kind, event_type AS value, event_id % 3 AS fp FROM events),
        c AS (SELECT item_id, ((item_id % 4) + 4) % 4 AS cfp FROM (SELECT DISTINCT user_id AS item_id FROM events UNION ALL SELECT -1))
        SELECT item_id, coalesce(arg_max(value, sequence) FILTER (kind = 'stage'), 'inventory') AS stage, coalesce(arg_max(value, sequence) FILTER (kind = 'decision' AND fp = cfp), 'open') AS decision,
          CASE WHEN count(sequence) > 0 AND count(*) FILTER (fp = cfp) = 0 THEN 'changed' ELSE 'current' END AS freshness, count(sequence) AS events FROM c LEFT JOIN e USING (item_id) GROUP BY item_id""",
    "edit_freshness": """WITH x AS (SELECT user_id, max(ts) AS edited FROM events WHERE event_type = 'purchase' GROUP BY user_id),
        r AS (SELECT user_id, ts, floor(value)::BIGINT AS h FROM events WHERE event_type = 'view'),
        s AS (SELECT x.user_id, arg_max(h, ts) FILTER (ts <= edited) AS old, arg_max(h, ts) FILTER (ts > edited) AS new FROM x LEFT JOIN r USING (user_id) GROUP BY x.user_id)
        SELECT user_id, CASE WHEN new IS NOT NULL AND new IS DISTINCT FROM old THEN 'CURRENT' ELSE 'PENDING' END AS state FROM s""",
    "interval_union": """WITH s AS (SELECT event_type, epoch_us(ts) AS start, epoch_us(ts) + floor(value * 60000000)::BIGINT AS stop FROM events),
        n AS (SELECT *, greatest(0, stop - greatest(start, coalesce(max(stop) OVER (PARTITION BY event_type ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start))) AS new FROM s)
        SELECT event_type, count(*) AS calls, sum(stop - start)::BIGINT AS summed, sum(new)::BIGINT AS covered, max(stop - start) AS slowest FROM n GROUP BY event_type""",
    "role_runs": """WITH m AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND lag(role) OVER w IS NOT DISTINCT FROM role THEN 0 ELSE 1 END AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        i AS (SELECT *, sum(b) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM m)
        SELECT conv_id, island, role, min(turn) AS first, max(turn) AS last, count(*) AS n FROM i GROUP BY conv_id, island, role""",
    "event_runs": """WITH m AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
        i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM m)
        SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM i GROUP BY user_id, island, event_type HAVING count(*) >= 3""",
    "module_forward_fill": """WITH f AS (SELECT user_id, value, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER w AS module, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER w AS lesson
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
        SELECT user_id, module, count(*) AS items, count(DISTINCT lesson) AS lessons, round(sum(value), 2) AS minutes FROM f GROUP BY user_id, module""",
    "text_budget": """WITH b AS (SELECT *, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n_chars <= 60000 AS kept FROM documents)
        SELECT source, count(*) FILTER (kept) AS kept, count(*) AS documents, sum(n_chars) FILTER (kept)::BIGINT AS chars FROM b GROUP BY source""",
    "chunk_reassembly": """SELECT conv_id, count(*) AS chunks, CASE WHEN count(DISTINCT turn) < count(*) THEN 'DUPLICATE_INDEX' WHEN min(turn) <> 0 OR max(turn) <> count(*) - 1 THEN 'NOT_CONTIGUOUS' ELSE 'COMPLETE' END AS state
        FROM conversations GROUP BY conv_id""",
    "multiset_contract": """WITH e AS (SELECT l_partkey, count(*) AS expected FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL), o AS (SELECT l_partkey, count(*) AS observed FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL),
        j AS (SELECT l_partkey, coalesce(expected, 0) AS expected, coalesce(observed, 0) AS observed FROM e FULL JOIN o USING (l_partkey))
        SELECT *, CASE WHEN observed = 0 THEN 'MISSING' WHEN expected = 0 THEN 'UNEXPECTED' ELSE 'COUNT' END AS kind FROM j WHERE expected <> observed""",
    "ordered_contract": """WITH s AS (SELECT l_orderkey, l_linenumber - coalesce(lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey), 0) AS step FROM lineitem)
        SELECT l_orderkey, count(*) FILTER (step > 1) AS skips, count(*) FILTER (step = 0) AS repeats FROM s GROUP BY l_orderkey HAVING count(*) FILTER (step > 1) + count(*) FILTER (step = 0) > 3""",
    "hierarchy_paths": f"{_TREE} SELECT * FROM w",
    "tree_diagnostics": f"""{_TREE}, c AS (SELECT parent_id AS node_id, count(*) AS children FROM n GROUP BY ALL)
        SELECT depth, administrative, count(*) AS nodes, count(*) FILTER (children IS NULL) AS leaves, max(coalesce(children, 0)) AS widest FROM w LEFT JOIN c USING (node_id) GROUP BY depth, administrative""",
    "dependency_closure": """WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 2 + 1) % 25 AS dst FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 5) % 25 FROM nation WHERE n_nationkey % 4 = 0),
        r AS (SELECT DISTINCT src AS root, src AS node, 0 AS depth, [src] AS seen FROM e UNION ALL SELECT r.root, e.dst, r.depth + 1, list_append(r.seen, e.dst) FROM r JOIN e ON e.src = r.node WHERE NOT list_contains(r.seen, e.dst)),
        m AS (SELECT root, node, min(depth) AS depth FROM r GROUP BY ALL) SELECT root, count(*) AS reached, max(depth) AS deepest FROM m GROUP BY root""",
    "json_props": "SELECT event_type, count(*) AS events, count(json_extract_string(props, '$.k')) AS declared, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS total, count(*) FILTER (json_extract_string(props, '$.missing') IS NULL) AS absent FROM events GROUP BY event_type",
}
