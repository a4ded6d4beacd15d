"""Queries that sum up, score and plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.functions import text
from veriframe.operators import duplicates, matching, summaries, work_queue
from veriframe.sources.tables import table

_META = ["owner", "status"]


def _records(spark, sf_dir: str) -> DataFrame:
    """Products as package records: the brand is the partner, the name the file."""
    p = table(spark, sf_dir, "part")
    size = F.pmod("p_size", F.lit(10))
    name = F.concat("p_name", F.when(size > 5, F.concat(F.lit(" ("), size.cast("string"), F.lit(")"))).otherwise(""), F.lit(".imscc"))
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("partner"), name.alias("file_name"), F.col("p_retailprice").alias("updated_at"),
        F.when(size != 3, F.col("p_retailprice") + F.col("p_size")).alias("scanned_at"),
        F.when(size == 1, " ").when(F.pmod("p_partkey", F.lit(17)) == 0, F.col("p_type")).otherwise("all").alias("owner"), F.when(size > 1, F.lower("p_brand")).alias("status"),
    )


def duplicate_plan(spark, sf_dir: str) -> DataFrame:
    return duplicates.duplicate_plan(_records(spark, sf_dir), _META)


def duplicate_merge(spark, sf_dir: str) -> DataFrame:
    return duplicates.merged_survivors(_records(spark, sf_dir), _META)


def duplicate_summary(spark, sf_dir: str) -> DataFrame:
    plan = duplicate_plan(spark, sf_dir)
    return plan.groupBy("conflicts").agg(F.count("*").alias("groups"), F.sum(F.col("members") - 1).alias("entries"), F.count_if("safe_to_merge").alias("safe"))


def partner_rollup(spark, sf_dir: str) -> DataFrame:
    """Sums by partner (nation) with a grand total."""
    n, c, o = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    spent = o.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("total"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(spent, c.c_custkey == spent.o_custkey, "left")
    return rows.rollup("n_name").agg(
        F.count("*").alias("packages"), F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"), F.round(F.sum("total"), 2).alias("total"),
        F.count_distinct("c_mktsegment").alias("owners"), F.floor(F.avg("c_acctbal") + 0.5).alias("average"),
    )


def _counts(spark, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    kind = F.pmod(F.col("l_partkey") + F.col("l_linenumber"), F.lit(7))
    names = ["webcontent", "assessments", "discussions", "weblinks", "lti", "unknown", "empty"]
    return li.groupBy("l_suppkey").agg(*(F.count_if(kind == i).alias(n) for i, n in enumerate(names)))


def portfolio_risk_index(spark, sf_dir: str) -> DataFrame:
    rows = summaries.workload_index(_counts(spark, sf_dir))
    return rows.withColumn("hours", summaries.labour_hours(F.col("ifs"), F.col("total_items"), F.col("lti"), F.col("empty"))).select("l_suppkey", "total_items", "ifs", "ifs_per_item", "is_boilerplate", "hours")


def preflight(spark, sf_dir: str) -> DataFrame:
    rows = _counts(spark, sf_dir).withColumns({"total_items": F.col("webcontent") + F.col("lti"), "core_empty": F.when(F.col("empty") % 3 == 0, 0).otherwise(F.col("empty"))})
    return summaries.preflight(rows).select("l_suppkey", "verdict")


def zscore_imbalance(spark, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("items"))
    return summaries.imbalance(sizes, "items").select("c_nationkey", "items", F.round("z", 9).alias("z"))


def snapshot_coherence(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus != 'F'").select(F.col("o_orderkey").alias("k"))
    return summaries.coherence(o, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


def coverage_summary(spark, sf_dir: str) -> DataFrame:
    """Observed, positive, negative and not observed labels by language: no label is not a zero."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy("lang").agg(
        F.count("*").alias("items"), F.count("quality").alias("observed"), F.count_if(F.col("quality") == 1).alias("positive"), F.count_if(F.col("quality") == 0).alias("negative"),
        F.round(F.avg("quality"), 9).alias("share"),
    )


def _results(spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    verdict = (
        F.when(F.col("quality").isNull(), "UNVERIFIED").when(F.col("quality") == 1, "VERIFIED").when(F.col("toxic") == 1, "CHANGED").when(F.col("n_chars") < 400, "MISSING").otherwise("DRIFT")
    )
    possible = F.when(F.col("quality").isNotNull(), F.least(F.col("n_chars"), F.lit(5000)))
    return d.select("doc_id", "source", verdict.alias("verdict"), (possible * F.col("quality")).alias("earned"), possible.alias("possible"), (F.col("quality") * 1.0).alias("coverage"))


def weighted_fidelity(spark, sf_dir: str) -> DataFrame:
    return summaries.fidelity_summary(_results(spark, sf_dir), "source")


def verdict_ladder(spark, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    verdict = summaries.text_verdict(F.col("l_quantity") * 10, F.col("l_extendedprice") / 200, F.col("l_discount") * 10 + 0.3, F.col("l_discount") * 9, F.col("l_tax") * 11)
    return li.groupBy("l_returnflag", verdict.alias("verdict")).agg(F.count("*").alias("items"))


def operating_policy(spark, sf_dir: str) -> DataFrame:
    """KEEP, REVIEW or REINGEST by counters of a source's results, with its first missing documents."""
    r = _results(spark, sf_dir)
    lost, open_ = F.count_if(F.col("verdict") == "MISSING"), F.count_if(F.col("verdict").isin("UNVERIFIED", "DRIFT"))
    grouped = r.groupBy("source").agg(F.count("*").alias("items"), lost.alias("lost"), open_.alias("open"))
    names = summaries.top_rows(r.where("verdict = 'MISSING'"), ["source"], [F.asc("doc_id")], 25).groupBy("source").agg(F.concat_ws(",", F.sort_array(F.collect_list("doc_id")).cast("array<string>")).alias("first_lost"))
    policy = F.when(F.col("lost") * 10 > F.col("items"), "REINGEST").when((F.col("lost") > 0) | (F.col("open") * 2 > F.col("items")), "REVIEW").otherwise("KEEP")
    return grouped.join(names, "source", "left").withColumn("policy", policy)


def work_queue_plan(spark, sf_dir: str) -> DataFrame:
    c, s, o = (table(spark, sf_dir, t) for t in ("customer", "supplier", "orders"))
    slots = c.select(F.col("c_custkey").alias("slot_id"), F.pmod("c_custkey", F.lit(120)).alias("key"), F.col("c_nationkey").alias("owner"))
    catalog = s.select(F.pmod(F.col("s_suppkey") * 3, F.lit(110)).alias("key"), F.col("s_suppkey").alias("catalog_id"), F.col("s_nationkey").alias("owner"), (F.col("s_acctbal") > 6000).alias("complete"))
    sources = table(spark, sf_dir, "part").where("p_size > 20").select(F.pmod("p_partkey", F.lit(90)).alias("catalog_id"))
    audits = o.select(F.pmod("o_custkey", F.lit(70)).alias("catalog_id"), F.col("o_orderdate").alias("audited_at"), F.col("o_orderkey").alias("audit_id"), F.col("o_orderstatus").alias("status"))
    return work_queue.build_queue(slots, catalog, sources, audits).select("slot_id", "catalog_status", "catalog_id", "action")


def work_queue_summary(spark, sf_dir: str) -> DataFrame:
    return work_queue_plan(spark, sf_dir).groupBy("catalog_status", "action").agg(F.count("*").alias("slots"))


def catalog_codes(spark, sf_dir: str) -> DataFrame:
    """Words of benchmark texts that stand in a document."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    keys = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[a-zA-Z]{4,}"), 0)).alias("code"))
    return work_queue.known_codes(b, keys, "text", r"[a-zA-Z]{4,}")


def unique_binding(spark, sf_dir: str) -> DataFrame:
    """Customers bound to suppliers by rounded balance where both are unique."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), F.floor(F.col("c_acctbal") / 10).cast("string").alias("k"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("target_id"), F.floor(F.col("s_acctbal") / 10).cast("string").alias("k"))
    return matching.unique_binding(c, s, "k").select("source_id", "status", "target_id", "candidates")


def _halves(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cheaper and dearer products as the items of two inventories."""
    p = table(spark, sf_dir, "part")
    form = lambda r, side: p.where(F.col("p_retailprice") < 950 if r == 0 else F.col("p_retailprice") >= 950).select(F.col("p_partkey").alias(f"{side}_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.concat(F.lit("root > "), "p_type").alias("path"), F.concat_ws("/", "p_brand", "p_size").alias("course"))
    return form(0, "source"), form(1, "target")


def global_match_plan(spark, sf_dir: str) -> DataFrame:
    """One-to-one plan between two inventories, course by course."""
    source, target = _halves(spark, sf_dir)
    return matching.match_plan(matching.blocked_edges(source, target, F.array("course")))


def match_edges(spark, sf_dir: str) -> DataFrame:
    """Scored edges between two inventories, paths not observed."""
    source, target = (df.withColumn("path", F.lit("")) for df in _halves(spark, sf_dir))
    return matching.blocked_edges(source, target, F.array("course")).select("source_id", "target_id", "exact_title", "compatible", "score_9")


def top_repeated_titles(spark, sf_dir: str) -> DataFrame:
    """The 20 most frequent product names."""
    p = table(spark, sf_dir, "part").groupBy(text.clean_name("p_name").alias("title")).agg(F.count("*").alias("n"))
    return p.orderBy(F.desc("n"), "title").limit(20)


def best_per_group(spark, sf_dir: str) -> DataFrame:
    """The three longest documents of each source, equal hashes once."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.md5("text").alias("h"))
    first = d.groupBy("source", "h").agg(F.min("doc_id").alias("doc_id"), F.max("n_chars").alias("n_chars"))
    return summaries.top_rows(first, ["source"], [F.desc("n_chars"), F.asc("doc_id")], 3).select("source", F.col("place").cast("long").alias("place"), "doc_id", "n_chars")


def tolerant_cells(spark, sf_dir: str) -> DataFrame:
    """Dates, minutes and counts read from loose cells."""
    o = table(spark, sf_dir, "orders")
    kind = F.pmod("o_orderkey", F.lit(5))
    cell = F.when(kind == 0, (F.pmod("o_orderkey", F.lit(3000)) + 40000).cast("string")).when(kind == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(kind == 2, "n/a").when(kind == 3, "2 of 5").otherwise("")
    rows = o.select("o_orderkey", summaries.excel_date(cell).alias("date"), summaries.minutes(cell).alias("minutes"), summaries.count_text(cell).alias("count"))
    return rows.select("o_orderkey", F.date_format("date", "yyyy-MM-dd").alias("date"), summaries.minutes_text(F.col("minutes")).alias("minutes"), "count")


def vector_top_pairs(spark, sf_dir: str) -> DataFrame:
    """The 100 most alike pairs of course vectors within a category (label) by cosine."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    rows = e.withColumn("norm", F.sqrt(dot(F.col("v"), F.col("v"))))
    a, b = rows.toDF("a", "label", "va", "na"), rows.toDF("b", "label", "vb", "nb")
    pairs = a.join(b, "label").where("a < b").select("label", "a", "b", F.round(dot(F.col("va"), F.col("vb")) / (F.col("na") * F.col("nb")), 6).alias("cosine"))
    return pairs.orderBy(F.desc("cosine"), "a", "b").limit(100)


QUERIES = {f.__name__: f for f in (
    duplicate_plan, duplicate_merge, duplicate_summary, partner_rollup, portfolio_risk_index, preflight, zscore_imbalance, snapshot_coherence, coverage_summary, weighted_fidelity,
    verdict_ladder, operating_policy, work_queue_plan, work_queue_summary, catalog_codes, unique_binding, global_match_plan, match_edges, top_repeated_titles, best_per_group, tolerant_cells, vector_top_pairs,
)}

_RECORDS = r"""WITH r AS (SELECT p_partkey AS id, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) AS partner_key, replace(p_name, ' ', '') AS semantic_key, p_size % 10 <= 5 AS unsuffixed, p_name || '.imscc' AS display,
    p_retailprice AS updated_at, coalesce(CASE WHEN p_size % 10 <> 3 THEN p_retailprice + p_size END, p_retailprice) AS scanned,
    CASE WHEN p_size % 10 = 1 THEN NULL WHEN p_partkey % 17 = 0 THEN p_type ELSE 'all' END AS owner, CASE WHEN p_size % 10 > 1 THEN lower(p_brand) END AS status,
    CASE WHEN p_size % 10 = 1 THEN ' ' WHEN p_partkey % 17 = 0 THEN p_type ELSE 'all' END AS owner_raw FROM part),
    g AS (SELECT partner_key, semantic_key, count(*) AS members, arg_min(id, {'a': NOT unsuffixed, 'b': updated_at, 'c': id}) AS survivor, arg_min(display, {'a': NOT unsuffixed, 'b': updated_at, 'c': id}) AS canonical_name,
      arg_max(id, {'a': scanned, 'b': id}) AS latest_scan,
      array_to_string(list_filter([CASE WHEN count(DISTINCT lower(owner)) > 1 THEN 'owner' END, CASE WHEN count(DISTINCT status) > 1 THEN 'status' END], lambda x: x IS NOT NULL), ',') AS conflicts
      FROM r GROUP BY ALL HAVING count(*) > 1), p AS (SELECT *, conflicts = '' AS safe_to_merge FROM g)"""
_COUNTS = "WITH c AS (SELECT l_suppkey, " + ", ".join(
    f"count(*) FILTER ((l_partkey + l_linenumber) % 7 = {i}) AS {n}" for i, n in enumerate(["webcontent", "assessments", "discussions", "weblinks", "lti", "unknown", "empty"])
) + " FROM lineitem GROUP BY l_suppkey)"
_RESULTS = """WITH r AS (SELECT d.doc_id, source, CASE WHEN quality IS NULL THEN 'UNVERIFIED' WHEN quality = 1 THEN 'VERIFIED' WHEN toxic = 1 THEN 'CHANGED' WHEN n_chars < 400 THEN 'MISSING' ELSE 'DRIFT' END AS verdict,
    CASE WHEN quality IS NOT NULL THEN least(n_chars, 5000) END AS possible, quality FROM documents d LEFT JOIN labels USING (doc_id))"""
_QUEUE = """WITH s AS (SELECT c_custkey AS slot_id, c_custkey % 120 AS key, c_nationkey AS owner FROM customer),
    c AS (SELECT (s_suppkey * 3) % 110 AS key, s_suppkey AS catalog_id, s_nationkey AS owner, s_acctbal > 6000 AS complete FROM supplier),
    k AS (SELECT key, count(*) AS n, min(catalog_id) AS any_id, count(*) FILTER (complete) AS n_complete, min(catalog_id) FILTER (complete) AS complete_id FROM c GROUP BY key),
    o AS (SELECT key, owner, count(*) AS n_owner, min(catalog_id) AS owner_id FROM c GROUP BY ALL),
    r AS (SELECT slot_id, CASE WHEN n IS NULL THEN 'NONE' WHEN n = 1 THEN 'ONE' WHEN n_owner = 1 THEN 'OWNER' WHEN n_complete = 1 THEN 'COMPLETE' ELSE 'AMBIGUOUS' END AS catalog_status, any_id, owner_id, complete_id
      FROM s LEFT JOIN k USING (key) LEFT JOIN o USING (key, owner)),
    t AS (SELECT *, CASE catalog_status WHEN 'ONE' THEN any_id WHEN 'OWNER' THEN owner_id WHEN 'COMPLETE' THEN complete_id END AS catalog_id FROM r),
    u AS (SELECT p_partkey % 90 AS catalog_id, count(*) AS sources FROM part WHERE p_size > 20 GROUP BY ALL),
    a AS (SELECT o_custkey % 70 AS catalog_id, count(*) AS audits, arg_max(o_orderstatus, {'a': o_orderdate, 'b': o_orderkey}) AS latest FROM orders GROUP BY ALL),
    q AS (SELECT slot_id, catalog_status, catalog_id, CASE WHEN catalog_status = 'AMBIGUOUS' THEN 'RESOLVE_CATALOG' WHEN catalog_status = 'NONE' THEN 'ADD_TO_CATALOG' WHEN sources IS NULL THEN 'UPLOAD_SOURCE'
      WHEN coalesce(audits, 0) = 0 THEN 'AUDIT' WHEN latest = 'F' THEN 'RESOLVE_BLOCKER' WHEN latest = 'P' THEN 'REVIEW' ELSE 'DONE' END AS action FROM t LEFT JOIN u USING (catalog_id) LEFT JOIN a USING (catalog_id))"""
_EDIT = "CASE WHEN a.n = b.n THEN 1.0::DOUBLE WHEN contains(a.n, b.n) OR contains(b.n, a.n) THEN 0.9 ELSE 1 - levenshtein(a.n, b.n)::DOUBLE / greatest(length(a.n), length(b.n)) END"

ORACLE_SQL = {
    "duplicate_plan": f"{_RECORDS} SELECT partner_key, semantic_key, members, survivor, canonical_name, latest_scan, conflicts, safe_to_merge FROM p",
    "duplicate_merge": f"""{_RECORDS} SELECT r.partner_key, r.semantic_key, survivor, arg_min(owner_raw, {{'a': id <> survivor, 'b': updated_at, 'c': id}}) FILTER (owner IS NOT NULL) AS owner,
        arg_min(status, {{'a': id <> survivor, 'b': updated_at, 'c': id}}) FILTER (status IS NOT NULL) AS status, count(*) - 1 AS archived FROM r JOIN p USING (partner_key, semantic_key) WHERE safe_to_merge GROUP BY ALL""",
    "duplicate_summary": f"{_RECORDS} SELECT conflicts, count(*) AS groups, sum(members - 1)::BIGINT AS entries, count(*) FILTER (safe_to_merge) AS safe FROM p GROUP BY conflicts",
    "partner_rollup": """WITH s AS (SELECT o_custkey, count(*) AS orders, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey)
        SELECT n_name, count(*) AS packages, coalesce(sum(orders), 0)::BIGINT AS orders, round(sum(total), 2) AS total, count(DISTINCT c_mktsegment) AS owners, floor(avg(c_acctbal) + 0.5)::BIGINT AS average
        FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN s ON c_custkey = o_custkey GROUP BY ROLLUP (n_name)""",
    "portfolio_risk_index": f"""{_COUNTS}, t AS (SELECT *, webcontent + assessments + discussions + weblinks + lti + unknown AS total_items FROM c),
        b AS (SELECT *, total_items > 0 AND total_items <= 5 AND assessments = 0 AND webcontent = 0 AS is_boilerplate FROM t),
        i AS (SELECT *, CASE WHEN total_items = 0 OR is_boilerplate THEN 100.0::DOUBLE ELSE lti * 10.0::DOUBLE + empty * 5 + unknown * 3 + assessments * 2 + discussions * 1.5::DOUBLE + weblinks + webcontent * 0.5::DOUBLE END AS ifs FROM b)
        SELECT l_suppkey, total_items, ifs, CASE WHEN total_items > 0 THEN round(ifs / total_items, 2) ELSE 100 END AS ifs_per_item, is_boilerplate,
          greatest(1, floor(greatest(0, ifs * 0.05::DOUBLE + total_items * 0.02::DOUBLE + lti * 1.5::DOUBLE + empty * 0.8::DOUBLE + 0.5::DOUBLE) * 0.85::DOUBLE
            + greatest(0, ifs * 0.01::DOUBLE + total_items * 0.05::DOUBLE + lti * 0.2::DOUBLE + empty * 0.1::DOUBLE + 0.1::DOUBLE) * 0.3::DOUBLE + 1.2::DOUBLE + 0.5::DOUBLE))::BIGINT AS hours FROM i""",
    "preflight": f"{_COUNTS} SELECT l_suppkey, CASE WHEN webcontent + lti = 0 OR (empty % 3 <> 0 AND empty > 0) OR lti > 50 THEN 'BLOCKED' ELSE 'CLEARED TO INGEST' END AS verdict FROM c",
    "zscore_imbalance": """WITH c AS (SELECT c_nationkey, count(*) AS items FROM customer GROUP BY ALL), m AS (SELECT avg(items) AS mean, stddev_pop(items) AS sd FROM c)
        SELECT c_nationkey, items, round((items - mean) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 9) AS z FROM c, m""",
    "snapshot_coherence": """WITH a AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'F'), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem),
        s AS (SELECT (SELECT count(*) FROM a) AS left_ids, (SELECT count(*) FROM b) AS right_ids, (SELECT count(*) FROM a SEMI JOIN b USING (k)) AS "both") SELECT *, round("both"::DOUBLE / least(left_ids, right_ids), 9) AS share FROM s""",
    "coverage_summary": """SELECT lang, count(*) AS items, count(quality) AS observed, count(*) FILTER (quality = 1) AS positive, count(*) FILTER (quality = 0) AS negative, round(avg(quality), 9) AS share
        FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""",
    "weighted_fidelity": f"""{_RESULTS}, s AS (SELECT source, count(*) AS items, count(*) FILTER (verdict = 'VERIFIED') AS verified, count(*) FILTER (verdict = 'DRIFT') AS drift, count(*) FILTER (verdict = 'CHANGED') AS changed,
        count(*) FILTER (verdict = 'MISSING') AS missing, count(*) FILTER (verdict = 'UNVERIFIED') AS unverified, CASE WHEN sum(possible) > 0 THEN round(sum(possible * quality)::DOUBLE / sum(possible)::DOUBLE * 100, 6) END AS fidelity,
        round(avg(quality::DOUBLE), 6) AS coverage FROM r GROUP BY source)
        SELECT *, CASE WHEN missing > 0 THEN 'BLOCKED' WHEN unverified > 0 OR drift > 0 OR items = 0 THEN 'REVIEW' ELSE 'NO_BLOCKERS_OBSERVED' END AS headline FROM s""",
    "verdict_ladder": """WITH v AS (SELECT l_returnflag, l_quantity * 10 AS s, l_extendedprice / 200 AS t, l_discount * 10 + 0.3::DOUBLE AS c, l_discount * 9 AS l, l_tax * 11 AS g FROM lineitem),
        w AS (SELECT *, l * 0.58::DOUBLE + g * 0.42::DOUBLE AS m, least(s, t) / greatest(s, t, 1) AS r FROM v)
        SELECT l_returnflag, CASE WHEN s < 80 THEN 'NOT_APPLICABLE' WHEN t < 40 THEN 'UNVERIFIED' WHEN c < 0.75::DOUBLE THEN 'UNVERIFIED' WHEN m >= 0.74::DOUBLE AND (r >= 0.55::DOUBLE OR m >= 0.9::DOUBLE) THEN 'VERIFIED'
          WHEN m >= 0.46::DOUBLE AND r >= 0.3::DOUBLE THEN 'DRIFT' WHEN r < 0.3::DOUBLE THEN 'UNVERIFIED' WHEN c >= 0.85::DOUBLE AND l < 0.22::DOUBLE AND g < 0.3::DOUBLE THEN 'CHANGED' ELSE 'UNVERIFIED' END AS verdict, count(*) AS items FROM w GROUP BY ALL""",
    "operating_policy": f"""{_RESULTS}, g AS (SELECT source, count(*) AS items, count(*) FILTER (verdict = 'MISSING') AS lost, count(*) FILTER (verdict IN ('UNVERIFIED', 'DRIFT')) AS open FROM r GROUP BY source),
        f AS (SELECT source, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS first_lost FROM (SELECT source, doc_id FROM r WHERE verdict = 'MISSING' QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 25) GROUP BY source)
        SELECT source, items, lost, open, first_lost, CASE WHEN lost * 10 > items THEN 'REINGEST' WHEN lost > 0 OR open * 2 > items THEN 'REVIEW' ELSE 'KEEP' END AS policy FROM g LEFT JOIN f USING (source)""",
    "work_queue_plan": f"{_QUEUE} SELECT * FROM q",
    "work_queue_summary": f"{_QUEUE} SELECT catalog_status, action, count(*) AS slots FROM q GROUP BY ALL",
    "catalog_codes": """WITH k AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-zA-Z]{4,}')) AS code FROM documents), b AS (SELECT item_id AS id, regexp_extract_all(text, '[a-zA-Z]{4,}') AS w FROM benchmark),
        e AS (SELECT id, unnest(w) AS code, generate_subscripts(w, 1) - 1 AS place FROM b) SELECT id, code, min(place)::BIGINT AS place FROM e JOIN k USING (code) GROUP BY id, code""",
    "unique_binding": """WITH c AS (SELECT c_custkey, floor(c_acctbal / 10)::BIGINT AS k, count(*) OVER (PARTITION BY floor(c_acctbal / 10)::BIGINT) AS n FROM customer),
        s AS (SELECT floor(s_acctbal / 10)::BIGINT AS k, count(*) AS m, min(s_suppkey) AS t FROM supplier GROUP BY ALL)
        SELECT c_custkey AS source_id, CASE WHEN m IS NULL THEN 'NO_TARGET' WHEN n > 1 OR m > 1 THEN 'AMBIGUOUS' ELSE 'BOUND' END AS status, CASE WHEN n = 1 AND m = 1 THEN t END AS target_id, coalesce(m, 0) AS candidates
        FROM c LEFT JOIN s USING (k)""",
    "global_match_plan": f"""WITH RECURSIVE p AS (SELECT p_partkey, p_retailprice < 950 AS cheap, replace(p_name, ' ', '') AS n, p_brand || '/' || p_size AS course, lower(p_type) AS t FROM part),
        e AS (SELECT course, a.p_partkey AS source_id, b.p_partkey AS target_id, a.n = b.n AS exact_title, a.t = b.t AS compatible, {_EDIT} AS title, CASE WHEN a.t = b.t THEN 1.0::DOUBLE ELSE 0.35::DOUBLE * {_EDIT.replace('.n', '.t')} END AS path FROM p a JOIN p b USING (course) WHERE a.cheap AND NOT b.cheap),
        s AS (SELECT *, title * 0.76::DOUBLE + path * 0.14::DOUBLE + CASE WHEN compatible THEN 1 ELSE 0.15::DOUBLE END * 0.1::DOUBLE AS c FROM e),
        f AS (SELECT course, source_id, target_id, exact_title, compatible, round(path, 9) AS path_9, CASE WHEN title < 0.5 THEN 0 WHEN title >= 0.98::DOUBLE AND c < 0.82::DOUBLE THEN 0.82::DOUBLE ELSE c END AS score FROM s),
        g AS (SELECT * EXCLUDE (score), round(score, 9) AS score_9, count(*) OVER (PARTITION BY source_id, exact_title, compatible, round(score, 9), path_9) AS m, count(*) OVER (PARTITION BY target_id, exact_title, compatible, round(score, 9), path_9) AS n FROM f WHERE score >= 0.78),
        open AS (SELECT source_id, target_id FROM g WHERE m > 1 OR n > 1),
        h AS (SELECT *, row_number() OVER (PARTITION BY course ORDER BY exact_title DESC, compatible DESC, score_9 DESC, path_9 DESC, source_id, target_id) AS i FROM g WHERE source_id NOT IN (SELECT source_id FROM open) AND target_id NOT IN (SELECT target_id FROM open)),
        steps AS (SELECT course, 0::BIGINT AS i, []::BIGINT[] AS ss, []::BIGINT[] AS ts, false AS took FROM (SELECT DISTINCT course FROM h)
          UNION ALL SELECT x.course, h.i, CASE WHEN list_contains(ss, source_id) OR list_contains(ts, target_id) THEN ss ELSE list_append(ss, source_id) END, CASE WHEN list_contains(ss, source_id) OR list_contains(ts, target_id) THEN ts ELSE list_append(ts, target_id) END,
            NOT (list_contains(ss, source_id) OR list_contains(ts, target_id)) FROM steps x JOIN h ON h.course = x.course AND h.i = x.i + 1)
        SELECT source_id, target_id, exact_title, compatible, score_9, path_9, CASE WHEN exact_title THEN 'EXACT_TITLE' WHEN compatible THEN 'TYPE_COMPATIBLE' ELSE 'FUZZY' END AS method FROM steps JOIN h USING (course, i) WHERE took""",
    "match_edges": f"""WITH p AS (SELECT p_partkey, p_retailprice < 950 AS cheap, replace(p_name, ' ', '') AS n, p_brand, p_size, lower(p_type) AS t FROM part),
        e AS (SELECT a.p_partkey AS source_id, b.p_partkey AS target_id, a.n = b.n AS exact_title, a.t = b.t AS compatible, {_EDIT} AS title FROM p a JOIN p b USING (p_brand, p_size) WHERE a.cheap AND NOT b.cheap),
        s AS (SELECT *, title * 0.9::DOUBLE + CASE WHEN compatible THEN 1 ELSE 0.15::DOUBLE END * 0.1::DOUBLE AS c FROM e),
        f AS (SELECT source_id, target_id, exact_title, compatible, CASE WHEN title < 0.5 THEN 0 WHEN title >= 0.98::DOUBLE AND c < 0.82::DOUBLE THEN 0.82::DOUBLE ELSE c END AS score FROM s)
        SELECT source_id, target_id, exact_title, compatible, round(score, 9) AS score_9 FROM f WHERE score >= 0.78""",
    "top_repeated_titles": "SELECT lower(p_name) AS title, count(*) AS n FROM part GROUP BY ALL ORDER BY n DESC, title LIMIT 20",
    "best_per_group": """WITH f AS (SELECT source, md5(text) AS h, min(doc_id) AS doc_id, max(n_chars) AS n_chars FROM documents GROUP BY ALL)
        SELECT source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place, doc_id, n_chars FROM f QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 3""",
    "tolerant_cells": """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(DATE '1899-12-30' + ((o_orderkey % 3000) + 40000)::INTEGER, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date,
        CASE o_orderkey % 5 WHEN 0 THEN (((o_orderkey % 3000) + 40000) // 60)::VARCHAR || ' h' || CASE WHEN ((o_orderkey % 3000) + 40000) % 60 = 0 THEN '' ELSE ' ' || (((o_orderkey % 3000) + 40000) % 60) || ' min' END ELSE 'not observed' END AS minutes,
        CASE o_orderkey % 5 WHEN 0 THEN (o_orderkey % 3000) + 40000 WHEN 1 THEN 1 WHEN 3 THEN 1 ELSE 0 END AS count FROM orders""",
    "vector_top_pairs": """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)
        SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id ORDER BY cosine DESC, a, b LIMIT 100""",
}
