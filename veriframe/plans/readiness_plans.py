"""Queries over behaviour, evidence dimensions, stages, losses, findings, repairs and deliverables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions import behavior
from veriframe.operators import readiness
from veriframe.sources.tables import table


def _mod(column: str):
    return lambda n: F.pmod(F.col(column), F.lit(n))


def _some(*choices: tuple[Column, str]) -> Column:
    """The texts whose condition holds."""
    return F.array_compact(F.array(*(F.when(when, F.lit(value)) for when, value in choices)))


def runtime_signals(spark, sf_dir: str) -> DataFrame:
    """Products as package resources: their runtimes, and whether a target could run them."""
    k = _mod("p_partkey")
    kind = F.when(k(13) == 0, "ADLCP:sco").when(k(13) == 1, "aicc_au").otherwise("webcontent")
    paths = _some((k(2) == 0, "A\\Story.html"), (k(3) == 0, "x/scorm/a.js"), (k(5) < 2, "player.html"), (k(7) < 3, "b/lms/launch.js"), (k(11) == 0, "q.practice.json"))
    address = F.when(k(17) == 0, "x/tincan.xml")
    s = table(spark, sf_dir, "part").select("p_partkey", behavior.interactive_signals(kind, paths, address).alias("s"))
    target = F.when(k(4) == 0, " Ungraded  Plugin").otherwise("Reading")
    rows = s.withColumn("review", behavior.runtime_review(F.col("s.detected"), target, F.when(k(6) == 1, F.array(F.lit("https://a/LAUNCH?x"))), F.array(F.lit("a.pdf"))))
    families = F.array_join(behavior.merged_families(F.col("s.families"), F.when(k(19) == 0, F.array(F.lit("AICC"), F.lit("")))), ",")
    return rows.groupBy("s.confidence", families.alias("families"), "review.status", "review.carrier").agg(F.count("*").alias("items"))


def stated_behaviors(spark, sf_dir: str) -> DataFrame:
    """Orders as exported assignments: what their text says of submissions, attempts and points."""
    k = _mod("o_orderkey")
    parts = (
        F.when(k(4) == 0, "<b>Assignment</b>").otherwise("Page"), F.when(k(3) == 0, "Submit <i>a</i> file").when(k(3) == 1, "inline-text"),
        F.when(k(5) == 0, "Attempts: unlimited").when(k(5) == 1, F.concat(F.lit("submissions="), k(9).cast("string"))), F.when(k(7) == 0, "Points 7.5").when(k(7) == 1, "viewpoints 3"),
    )
    text = behavior.stated_behavior(F.when(k(8) == 1, "imsdt_assignment"), F.concat_ws("\n", *parts))
    rows = table(spark, sf_dir, "orders").select(text.alias("b"))
    return rows.groupBy(*(F.col(f"b.{c}").alias(c) for c in ("observed", "file_upload", "text_submission", "attempts", "points"))).agg(F.count("*").alias("items"))


def quiz_behaviors(spark, sf_dir: str) -> DataFrame:
    """Orders as quizzes by what their settings say."""
    k = _mod("o_orderkey")
    words = F.when(k(3) == 0, "An UNGRADED quiz").when(k(3) == 1, "This is not an ungraded quiz")
    quiz = behavior.quiz_behavior(words, k(4) - 1, F.when(k(5) == 0, True), F.when(k(7) == 0, True), F.when(k(7) < 3, k(7)), F.when(k(11) < 4, k(11).cast("double")), F.when(k(2) == 0, k(11) != 3))
    rows = table(spark, sf_dir, "orders").select(quiz.alias("q"))
    return rows.groupBy(*(F.col(f"q.{c}").alias(c) for c in ("observed", "graded", "conflict", "attempts", "minutes"))).agg(F.count("*").alias("quizzes"))


def behavior_changes(spark, sf_dir: str) -> DataFrame:
    """Orders as pairs of an item and its target by the settings that differ."""
    k = _mod("o_orderkey")

    def side(n: int) -> Column:
        at = lambda m: F.pmod(F.col("o_orderkey") + n, F.lit(m))
        return F.struct(
            (at(4) == 0).alias("file_upload"), (at(5) == 0).alias("text_submission"), (at(6) == 0).alias("ai_graded"),
            F.when(at(3) == 0, "Unlimited tries").when(at(3) == 1, F.concat(F.lit("0"), at(2).cast("string"), F.lit(" tries"))).alias("attempts"), F.when(at(7) < 4, at(7) < 2).alias("graded"),
            F.when(at(8) < 3, at(8).cast("double")).alias("passing"), F.when(at(9) < 2, at(9).cast("double")).alias("points"), F.lit(None).cast("double").alias("minutes"), (at(13) == 0).alias("conflict"),
        )

    kind = F.when(k(2) == 0, "Quiz").otherwise("Reading")
    rows = table(spark, sf_dir, "orders").select(behavior.compare_behavior(kind, F.when(k(10) != 9, side(0)), F.when(k(10) != 8, side(12))).alias("b"))
    return rows.groupBy("b.status", F.array_join("b.issues", ",").alias("issues")).agg(F.count("*").alias("items"))


def dimension_gates(spark, sf_dir: str) -> DataFrame:
    """Products as results: verdicts after their dimensions of evidence."""
    k = _mod("p_partkey")
    status = F.map_from_entries(F.array(F.struct(F.lit("structure"), F.lit("VERIFIED")), F.struct(F.lit("content"), F.when(k(3) == 0, "PARTIAL").otherwise("TRANSFORMED")), F.struct(F.lit("behavior"), F.when(k(5) == 0, "MUTATED").otherwise("VERIFIED"))))
    facts = table(spark, sf_dir, "part").select(
        F.when(k(7) == 0, "MISSING").otherwise("VERIFIED").alias("verdict"), status.alias("status"), F.lit(None).cast("boolean").alias("comparable"), (k(4) == 0).alias("structured"), (k(2) == 0).alias("has_text"), (k(6) - 3).alias("assets"),
        k(2).alias("links"), F.when(k(6) == 5, 1).alias("assets_missing"), F.lit(0).alias("assets_open"), F.when(k(8) == 0, "Quiz").alias("kind"), (k(9) == 0).alias("behaves"), F.lit(False).alias("runs"), F.when(k(12) == 0, False).alias("answers_apply"), F.lit(0.995).alias("answer_share"),
    )
    gate = facts.select("verdict", readiness.dimension_gate(F.col("verdict"), readiness.evidence_dimensions(facts)).alias("g"))
    return gate.groupBy(F.col("verdict").alias("before"), F.col("g.verdict").alias("after"), F.array_join("g.failed", ",").alias("failed"), F.array_join("g.unverified", ",").alias("unverified")).agg(F.count("*").alias("items"))


def snapshot_stages(spark, sf_dir: str) -> DataFrame:
    """Customers as courses whose orders are items: published if filled, not known if in part."""
    k = _mod("c_custkey")
    asked = F.when(k(5) == 0, "Live").when(k(5) == 1, "raw-ingestion").when(k(5) == 2, "prepared").when(k(5) == 3, "other")
    courses = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("course"), asked.alias("requested"), F.when(k(2) == 0, True).alias("report"))
    items = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("course"), F.when(F.col("o_orderstatus") != "P", (F.col("o_orderstatus") == "F") & (F.pmod("o_custkey", F.lit(3)) > 0)).alias("published"))
    return readiness.snapshot_stage(courses, items, "course")


def proven_losses(spark, sf_dir: str) -> DataFrame:
    """Products as results: proven losses, and recommendations after what the target's findings are."""
    k = _mod("p_partkey")
    issues = _some((k(2) == 0, "MISSING_ASSET"), (k(3) == 0, "CONTENT_CHANGED"), (k(7) == 0, "ASSESSMENT_CHANGED"), (k(11) == 0, "SI_UNRESOLVED_SOURCE_ASSET"))
    split = F.when(k(5) < 2, F.struct((k(20) / 20).alias("payload"), (k(10) / 10).alias("text")))
    code = F.when(k(4) == 0, "KEEP").when(k(4) == 1, "REVIEW").otherwise("REINGEST")
    after = readiness.readiness_recommendation(code, F.when(k(6) == 0, 1), F.when(k(8) == 0, 2), F.lit(None).cast("int"), F.when(k(9) == 0, 1).otherwise(0))
    rows = table(spark, sf_dir, "part").select("p_brand", readiness.proven_loss(issues, split, F.when(k(13) > 0, k(13) * 10)).alias("lost"), after.alias("recommendation"))
    return rows.groupBy("p_brand", "recommendation").agg(F.count("*").alias("items"), F.count_if("lost").alias("lost"))


def open_findings(spark, sf_dir: str) -> DataFrame:
    """Order lines as findings of orders; returned lines have an action, and so has each order's first line."""
    li = table(spark, sf_dir, "lineitem")
    line = F.col("l_linenumber")
    severity = F.when(line % 4 == 0, "CRITICAL").when(line % 4 == 1, "REVIEW").when(line % 4 == 2, "EVIDENCE").otherwise("INFO")
    item = F.when(line % 3 != 0, F.col("l_partkey").cast("string"))
    findings = li.select("l_orderkey", F.pmod("l_suppkey", F.lit(3)).alias("code"), item.alias("item"), severity.alias("severity"), F.when(line == 5, True).alias("exempt"))
    actions = li.where("l_returnflag = 'R' or l_linenumber = 1").select("l_orderkey", F.pmod("l_suppkey", F.lit(3)).alias("code"), item.alias("item"))
    return readiness.headline(readiness.open_findings(findings, actions, "l_orderkey"), "l_orderkey")


def media_presence(spark, sf_dir: str) -> DataFrame:
    """Products as references of their brand's package, parts of it as entries."""
    k = _mod("p_partkey")
    p = table(spark, sf_dir, "part")
    ref = (
        F.when(k(6) == 0, "https://host/a.png").when(k(6) == 1, "#top").when(k(6) == 2, F.concat(F.lit("./img/"), k(40).cast("string"), F.lit(".png?v=1")))
        .when(k(6) == 3, F.concat(F.lit("../other/"), k(40).cast("string"), F.lit(".PNG"))).otherwise(F.concat(F.lit("no%20where/"), k(40).cast("string"), F.lit(".gif#x")))
    )
    refs = p.select(F.col("p_brand").alias("package"), F.lit("quiz/q.xml").alias("file"), ref.alias("ref"))
    at = F.when(k(2) == 0, "quiz/img/").otherwise("spare/")
    entries = p.where("p_size > 25").select(F.col("p_brand").alias("package"), F.concat(at, k(40).cast("string"), F.lit(".png")).alias("path"))
    return readiness.media_presence(refs, entries).groupBy("package", "path", "status", "candidates").agg(F.count("*").alias("refs"))


def lineage_repairs(spark, sf_dir: str) -> DataFrame:
    """Orders as audits; lines with an even product are repairs of them, in order of their number."""
    audits = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(1).alias("generation"))
    repairs = table(spark, sf_dir, "lineitem").where("l_partkey % 2 = 0").select(F.col("l_orderkey").alias("run_id"), (F.col("l_suppkey") % 5).cast("int").alias("to_generation"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("position"))
    return readiness.with_lineage_repairs(audits, repairs).groupBy("generation", "repaired").agg(F.count("*").alias("audits"))


def deliverable_members(spark, sf_dir: str) -> DataFrame:
    """Orders as revisions of deliverables of their customers, their lines as members by supplier."""
    member = F.struct("l_linenumber", F.pmod("l_suppkey", F.lit(4)).cast("string").alias("item"), F.col("l_linenumber").cast("string").alias("member"), F.when(F.col("l_returnflag") == "A", "omit").otherwise("keep").alias("action"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(member)).alias("members"))
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rows = o.select("o_custkey", F.col("o_orderpriority").alias("deliverable"), F.pmod("o_orderkey", F.lit(3)).alias("revision"), F.col("o_orderkey").alias("position"), "members")
    return readiness.deliverable_members(rows, "o_custkey")


def declared_changes(spark, sf_dir: str) -> DataFrame:
    """Orders as ledger events of customers, by priority as platform."""
    seen = F.when(F.pmod("o_orderkey", F.lit(3)) == 0, F.date_add("o_orderdate", 30))
    events = table(spark, sf_dir, "orders").select(
        "o_custkey", F.col("o_orderpriority").alias("platform"), F.col("o_orderkey").alias("event"), F.when(F.col("o_orderstatus") == "F", "changed").otherwise("kept").alias("decision"),
        F.col("o_orderdate").alias("recorded_at"), seen.alias("observed_at"), F.col("o_orderkey").alias("position"),
    )
    return readiness.declared_changes(events, "o_custkey")


def interaction_keys(spark, sf_dir: str) -> DataFrame:
    """Products by the key of their name as an interaction and in a snapshot."""
    k = _mod("p_partkey")
    name = F.concat(F.when(k(3) == 0, "Graded Discussion: ").when(k(3) == 1, "Topic ").otherwise(""), "p_name")
    key = readiness.lifecycle_key(F.when(k(4) == 0, F.col("p_partkey").cast("string")).when(k(4) == 1, ""), F.upper("p_name"), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", readiness.interaction_key(name).alias("interaction"), key.alias("lifecycle"))


_FUNCTIONS = (
    runtime_signals, stated_behaviors, quiz_behaviors, behavior_changes, dimension_gates, snapshot_stages, proven_losses, open_findings, media_presence, lineage_repairs, deliverable_members,
    declared_changes, interaction_keys,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_CHECK = "CASE WHEN {0} IS NULL THEN NULL WHEN {1} IS NULL THEN '{2}_UNVERIFIED' WHEN {0} = {1} THEN 'SAME' ELSE '{2}_CHANGED' END"
_SIDE = """k % 4 = 0 AS up, k % 5 = 0 AS tx, k % 6 = 0 AS ai, CASE k % 3 WHEN 0 THEN 'UNLIMITED' WHEN 1 THEN (k % 2)::VARCHAR END AS att, CASE WHEN k % 7 < 4 THEN k % 7 < 2 END AS gr,
        CASE WHEN k % 8 < 3 THEN k % 8 END AS pa, CASE WHEN k % 9 < 2 THEN k % 9 END AS po, k % 13 = 0 AS cf"""

ORACLE_SQL = {
    "runtime_signals": """WITH s AS (SELECT p_partkey AS k, p_partkey % 13 = 0 AS sco, p_partkey % 13 = 1 AS aicc, p_partkey % 17 = 0 AS tin, p_partkey % 2 = 0 AS story, p_partkey % 11 = 0 AS practice,
          (p_partkey % 3 = 0)::INT + (p_partkey % 5 < 2)::INT + (p_partkey % 7 < 3)::INT AS n FROM part),
        r AS (SELECT k, CASE WHEN sco OR aicc OR tin OR story THEN 'HIGH' WHEN n = 3 OR practice THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
          concat_ws(',', CASE WHEN sco THEN 'SCORM' END, CASE WHEN aicc THEN 'AICC' END, CASE WHEN tin THEN 'TINCAN_XAPI' END, CASE WHEN story THEN 'STORYLINE' END, CASE WHEN practice THEN 'D2L_PRACTICE_RUNTIME' END, CASE WHEN k % 19 = 0 AND NOT aicc THEN 'AICC' END) AS families FROM s)
        SELECT confidence, families, CASE WHEN confidence = 'LOW' THEN 'NOT_APPLICABLE' ELSE 'REVIEW' END AS status, confidence <> 'LOW' AND (k % 4 = 0 OR k % 6 = 1) AS carrier, count(*) AS items FROM r GROUP BY ALL""",
    "stated_behaviors": """WITH b AS (SELECT o_orderkey AS k, o_orderkey % 4 = 0 OR o_orderkey % 8 = 1 AS a FROM orders),
        c AS (SELECT a AND k % 3 = 0 AS file_upload, a AND k % 3 = 1 AS text_submission, CASE k % 5 WHEN 0 THEN 'unlimited' WHEN 1 THEN (k % 9)::VARCHAR END AS attempts, CASE WHEN k % 7 = 0 THEN 7.5 END AS points FROM b)
        SELECT file_upload OR text_submission OR attempts IS NOT NULL OR points IS NOT NULL AS observed, *, count(*) AS items FROM c GROUP BY ALL""",
    "quiz_behaviors": """WITH q AS (SELECT o_orderkey AS k, o_orderkey % 4 > 1 OR o_orderkey % 5 = 0 AS linked, o_orderkey % 3 = 0 AS un, CASE WHEN o_orderkey % 11 < 4 THEN o_orderkey % 11 END AS m FROM orders),
        r AS (SELECT *, CASE WHEN un <> linked THEN linked END AS graded, un AND linked AS conflict, CASE WHEN k % 7 = 0 THEN 'UNLIMITED' WHEN k % 7 < 3 THEN (k % 7)::VARCHAR END AS attempts, CASE WHEN k % 2 = 1 OR m <> 3 THEN m END AS minutes FROM q)
        SELECT graded IS NOT NULL OR attempts IS NOT NULL OR m IS NOT NULL AS observed, graded, conflict, attempts, minutes::DOUBLE AS minutes, count(*) AS quizzes FROM r GROUP BY ALL""",
    "behavior_changes": f"""WITH a AS (SELECT k AS id, {_SIDE} FROM (SELECT o_orderkey AS k FROM orders)), z AS (SELECT k - 12 AS id, {_SIDE} FROM (SELECT o_orderkey + 12 AS k FROM orders)),
        c AS (SELECT a.id, z.cf, [CASE WHEN a.up THEN CASE WHEN z.up THEN 'SAME' WHEN z.ai OR z.tx THEN 'FILE_UPLOAD_REPLACED' ELSE 'FILE_UPLOAD_UNVERIFIED' END END,
          CASE WHEN a.tx THEN CASE WHEN z.tx THEN 'SAME' WHEN z.up AND NOT z.ai THEN 'TEXT_SUBMISSION_REPLACED' ELSE 'TEXT_SUBMISSION_UNVERIFIED' END END,
          {_CHECK.format("a.att", "z.att", "ATTEMPTS")}, {_CHECK.format("a.gr", "z.gr", "GRADED_STATE")}, CASE WHEN NOT a.gr AND z.pa > 0 THEN 'PASSING_THRESHOLD_ON_UNGRADED_SOURCE' ELSE {_CHECK.format("a.pa", "z.pa", "PASSING_THRESHOLD")} END,
          {_CHECK.format("a.po", "z.po", "POINTS")}] AS s FROM a JOIN z USING (id)),
        l AS (SELECT id, cf, list_filter(s, lambda x: x IS NOT NULL) AS s FROM c),
        d AS (SELECT *, list_filter(s, lambda x: x <> 'SAME' AND x NOT LIKE '%_UNVERIFIED') AS bad, list_filter(s, lambda x: x LIKE '%_UNVERIFIED') AS open FROM l),
        r AS (SELECT CASE WHEN id % 10 = 9 THEN CASE WHEN id % 2 = 0 THEN 'UNVERIFIED' ELSE 'NOT_APPLICABLE' END WHEN id % 10 = 8 THEN 'UNVERIFIED' WHEN len(bad) > 0 THEN 'MUTATED' WHEN len(open) > 0 OR len(s) = 0 OR cf THEN 'UNVERIFIED' ELSE 'VERIFIED' END AS status,
          CASE WHEN id % 10 = 9 THEN CASE WHEN id % 2 = 0 THEN 'BEHAVIOR_SOURCE_UNVERIFIED' ELSE '' END WHEN id % 10 = 8 THEN 'BEHAVIOR_DESTINATION_UNVERIFIED'
            ELSE coalesce(array_to_string(list_concat(bad, open, CASE WHEN cf THEN ['NATIVE_GRADING_OBSERVATIONS_CONFLICT'] ELSE [] END), ','), '') END AS issues FROM d)
        SELECT status, issues, count(*) AS items FROM r GROUP BY ALL""",
    "dimension_gates": """WITH f AS (SELECT p_partkey AS k FROM part), d AS (SELECT k, k % 4 > 0 AND (k % 2 = 0 OR FALSE) AS txt, k % 6 > 3 AS ast, k % 2 = 1 AS lnk, k % 4 = 0 AS ques, k % 8 = 0 OR k % 9 = 0 AS beh FROM f),
        g AS (SELECT k, CASE WHEN k % 7 = 0 THEN 'MISSING' ELSE 'VERIFIED' END AS before, concat_ws(',', CASE WHEN txt AND k % 3 = 0 THEN 'learner_text' END, CASE WHEN ast AND k % 6 = 5 THEN 'required_assets' END, CASE WHEN beh AND k % 5 = 0 THEN 'behavior' END) AS failed,
          concat_ws(',', CASE WHEN ast AND k % 6 = 4 THEN 'required_assets' END, CASE WHEN lnk THEN 'links_media' END, CASE WHEN ques THEN 'assessment_questions' END) AS unverified FROM d)
        SELECT before, CASE WHEN before = 'MISSING' THEN before WHEN contains(failed, 'behavior') THEN 'BEHAVIOR_MUTATION' WHEN failed <> '' THEN 'PARTIAL' WHEN unverified <> '' THEN 'UNVERIFIED' ELSE before END AS after, failed, unverified, count(*) AS items FROM g GROUP BY ALL""",
    "snapshot_stages": """WITH i AS (SELECT o_custkey AS course, count(*) AS n, count(*) FILTER (o_orderstatus = 'F' AND o_custkey % 3 > 0) AS p FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey),
        c AS (SELECT c_custkey AS course, CASE c_custkey % 5 WHEN 0 THEN 'published' WHEN 1 THEN 'raw' WHEN 2 THEN 'ops' ELSE 'auto' END AS asked, c_custkey % 2 = 0 AS rep, coalesce(n, 0) AS n, coalesce(p, 0) AS p FROM customer LEFT JOIN i ON course = c_custkey),
        s AS (SELECT *, rep AND n >= 3 AND p = 0 AS r, n >= 3 AND 10 * p >= 9 * n AS l FROM c)
        SELECT course, asked, n AS observed, p AS published, CASE WHEN asked = 'raw' OR (asked = 'auto' AND r) THEN 'RAW_INGESTION' ELSE 'OPS_CURRENT' END AS mode,
          CASE WHEN asked = 'raw' OR (asked = 'auto' AND r) THEN 'RAW_UNPUBLISHED' WHEN asked = 'published' OR (asked = 'auto' AND l) THEN 'PUBLISHED' ELSE 'OPS_PREPARED_UNPUBLISHED' END AS stage,
          CASE WHEN asked <> 'auto' THEN 1.0 WHEN r THEN 0.97 WHEN l THEN 0.94 ELSE 0.72 END AS confidence FROM s""",
    "proven_losses": """WITH p AS (SELECT p_brand, p_partkey AS k, p_partkey % 5 < 2 AS split, CASE p_partkey % 4 WHEN 0 THEN 'KEEP' WHEN 1 THEN 'REVIEW' ELSE 'REINGEST' END AS c FROM part),
        r AS (SELECT p_brand, CASE WHEN c <> 'REINGEST' AND k % 6 = 0 THEN 'MANUAL_REMEDIATION' WHEN c = 'KEEP' AND (k % 8 = 0 OR k % 9 = 0) THEN 'REVIEW' ELSE c END AS recommendation,
          CASE WHEN k % 11 = 0 THEN FALSE WHEN k % 7 = 0 THEN TRUE WHEN k % 2 = 0 THEN NOT split OR k % 20 >= 17 WHEN k % 3 = 0 THEN (NOT split OR k % 10 >= 8) AND k % 13 >= 8 ELSE FALSE END AS lost FROM p)
        SELECT p_brand, recommendation, count(*) AS items, count(*) FILTER (lost) AS lost FROM r GROUP BY ALL""",
    "open_findings": """WITH f AS (SELECT l_orderkey, l_suppkey % 3 AS code, CASE WHEN l_linenumber % 3 <> 0 THEN l_partkey END AS item, l_linenumber AS n, l_returnflag = 'R' OR l_linenumber = 1 AS act FROM lineitem),
        o AS (SELECT * FROM f WHERE n <> 5 AND n % 4 < 3 AND NOT EXISTS (SELECT 1 FROM f a WHERE a.act AND a.l_orderkey = f.l_orderkey AND a.code = f.code AND (f.item IS NULL OR a.item = f.item)))
        SELECT l_orderkey, count(*) FILTER (n % 4 = 0) AS critical, count(*) FILTER (n % 4 = 1) AS review, count(*) FILTER (n % 4 = 2) AS evidence, CASE WHEN count(*) FILTER (n % 4 = 0) > 0 THEN 'BLOCKED' ELSE 'REVIEW' END AS status FROM o GROUP BY l_orderkey""",
    "media_presence": """WITH e AS (SELECT DISTINCT p_brand AS package, CASE WHEN p_partkey % 2 = 0 THEN 'quiz/img/' ELSE 'spare/' END AS dir, p_partkey % 40 AS n FROM part WHERE p_size > 25),
        r AS (SELECT p_brand AS package, p_partkey % 6 AS m, p_partkey % 40 AS n FROM part), c AS (SELECT package, n, count(*) AS same FROM e GROUP BY ALL),
        j AS (SELECT r.*, c.same, EXISTS (SELECT 1 FROM e WHERE e.package = r.package AND e.n = r.n AND e.dir = 'quiz/img/') AS here FROM r LEFT JOIN c ON c.package = r.package AND c.n = r.n)
        SELECT package, CASE WHEN m = 2 THEN 'quiz/img/' || n || '.png' WHEN m = 3 THEN 'other/' || n || '.PNG' WHEN m > 3 THEN 'quiz/no where/' || n || '.gif' END AS path,
          CASE WHEN m < 2 THEN 'EXTERNAL_OR_EMBEDDED' WHEN m = 2 AND here THEN 'PRESENT_AT_REFERENCE' WHEN m < 4 AND same > 0 THEN 'PRESENT_DIFFERENT_PATH' ELSE 'NOT_IN_PACKAGE' END AS status,
          CASE WHEN m = 2 AND here THEN 1 WHEN m IN (2, 3) THEN coalesce(same, 0) ELSE 0 END AS candidates, count(*) AS refs FROM j GROUP BY ALL""",
    "lineage_repairs": """WITH l AS (SELECT l_orderkey, arg_max(l_suppkey % 5, (l_linenumber, l_partkey, l_suppkey)) AS g FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY l_orderkey)
        SELECT coalesce(g, 1)::INT AS generation, g IS NOT NULL AS repaired, count(*) AS audits FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY ALL""",
    "deliverable_members": """WITH o AS (SELECT o_custkey, o_orderpriority AS deliverable, o_orderkey % 3 AS revision, o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
        w AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey, deliverable ORDER BY revision DESC, o_orderkey) = 1),
        m AS (SELECT o_custkey, deliverable, revision, l_suppkey % 4 AS i, l_linenumber AS n, l_returnflag FROM w JOIN lineitem ON l_orderkey = o_orderkey QUALIFY row_number() OVER (PARTITION BY o_custkey, deliverable, l_suppkey % 4 ORDER BY l_linenumber, l_returnflag = 'A') = 1)
        SELECT o_custkey, i::VARCHAR AS item, deliverable, revision, n::VARCHAR AS member, CASE WHEN l_returnflag = 'A' THEN 'removed' ELSE 'included' END AS state FROM m""",
    "declared_changes": """SELECT o_custkey, o_orderpriority AS platform, count(*) AS declarations, arg_max(o_orderkey, (o_orderdate + CASE WHEN o_orderkey % 3 = 0 THEN INTERVAL 30 DAY ELSE INTERVAL 0 DAY END, o_orderkey)) AS latest
        FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL""",
    "interaction_keys": """SELECT p_partkey, array_to_string(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda w: w NOT IN ('forum', 'activity', 'activities', 'discussion', 'prompt', 'graded', 'ungraded', 'topic', 'exercise')), ' ') AS interaction,
        CASE WHEN p_partkey % 4 = 0 THEN 'id:' || p_partkey ELSE 'name:' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) || '|path:' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) END AS lifecycle FROM part""",
}
