"""Queries over captured quizzes, banks, questions, report claims and recorded work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.operators import captures
from veriframe.sources.tables import table

# What texts say, and what is to be read from them: the statements below repeat the second part only.
_DECLARED = (
    ("The exam has <b>25</b> multiple-choice, short answer and essay questions.", 25), ("Answer 5 of 20 questions", None), ("twelve (12) questions; 12 questions in all", 12), ("ten (12) questions", None),
    ("30 questions from 100 questions", 30), ("7 questions and 8 questions", None), ("0 questions", None), ("A pool of 40 questions, 9 true / false questions", 9),
)
_CLAIMS = (
    ("Set the passing score to null because the rubric is silent", False, ""), ("Left passing threshold unspecified (null), and created a rubric.", True, ""), ("The grader type was chosen", True, ""),
    ("The attachment could not be uploaded.", False, "UNRESOLVED_SOURCE_ASSET"), ("A file without an asset id; plain text stays", False, "UNRESOLVED_SOURCE_ASSET"), ("Tables are not allowed inside lists and were converted.", False, "CONTENT_MARKUP_ADAPTATION"),
    ("The document is missing from the graded unit", True, "UNRESOLVED_SOURCE_ASSET"), ("All is well; nothing to say", False, ""),
)


def _one_of(key: Column, texts) -> Column:
    return F.get(F.array(*map(F.lit, texts)), key.cast("int"))


def quiz_captures(spark, sf_dir: str) -> DataFrame:
    """Order lines as quizzes of their orders."""
    li = table(spark, sf_dir, "lineitem")
    k = lambda n: F.pmod("l_partkey", F.lit(n))
    asked = F.when(k(9) == 0, "PARTIAL").when(k(9) == 1, "UNAVAILABLE").when(k(9) == 2, "CAPTURED")
    captured = F.when(k(5) == 0, 0).when(k(5) == 1, 25).when(k(5) == 2, 12)
    rows = li.select("l_orderkey", asked.alias("asked"), captured.alias("captured"), _one_of(k(8), [t for t, _ in _DECLARED]).alias("description"), F.when(k(7) == 0, False).alias("verified"))
    return captures.quiz_captures(rows, "l_orderkey")


def assignment_behaviors(spark, sf_dir: str) -> DataFrame:
    """Orders as assignments by their kind of submission."""
    k = lambda n: F.pmod("o_orderkey", F.lit(n))
    b = captures.assignment_behavior(F.when(k(7) < 6, k(7)), F.when(k(3) == 0, F.lit(10.0)))
    rows = table(spark, sf_dir, "orders").select(b.alias("b"))
    return rows.groupBy(*(F.col(f"b.{c}").alias(c) for c in ("observed", "file_upload", "text_submission", "on_paper", "in_person", "points"))).agg(F.count("*").alias("items"))


def question_dimensions(spark, sf_dir: str) -> DataFrame:
    """Turns of conversations as questions against the first turn of theirs, by whole texts."""
    c = table(spark, sf_dir, "conversations").na.fill({"text": "", "turn": 0})
    first = c.groupBy("conv_id").agg(F.min_by(F.struct("turn", "role", "text"), F.struct("turn", "role", "text")).alias("f"))

    def question(turn: Column, role: Column, body: Column) -> Column:
        kind = F.when(role == "user", "essay").when(role == "assistant", "regex")
        return F.struct(
            body.alias("prompt"), kind.alias("type"), F.split(body, "\n").alias("options"), F.array(role).alias("answers"), (turn % 2 == 0).alias("keyed"), F.length(body).alias("feedback"), (turn % 3 == 0).alias("feedback_captured"),
            F.when(turn % 5 == 4, F.array(F.lit("Prompt truncated"))).alias("limitations"),
        )

    pair = captures.question_dimensions(question(F.col("f.turn"), F.col("f.role"), F.col("f.text")), question(F.col("turn"), F.col("role"), F.col("text")))
    rows = c.join(first, "conv_id").select(pair.alias("q"))
    states = F.array_join(F.transform(F.slice("q.dimensions", 1, 5), lambda d: F.substring(d["status"], 1, 1)), "")
    return rows.groupBy("q.status", states.alias("states")).agg(F.count("*").alias("questions"))


def bank_coverage(spark, sf_dir: str) -> DataFrame:
    """Documents as questions of the bank of their source."""
    k = lambda n: F.pmod("doc_id", F.lit(n))
    feedback = F.when(k(4) == 0, "CAPTURED").when(k(4) == 1, "NONE_AUTHORED")
    rows = table(spark, sf_dir, "documents").select("source", F.col("text").alias("prompt"), (k(3) == 0).alias("cut"), F.when(k(5) > 0, k(5) > 1).alias("options_reliable"), F.when(k(2) == 0, "CAPTURED").alias("answer_coverage"), (k(6) > 1).alias("answers_reliable"), feedback.alias("feedback_coverage"))
    return captures.bank_coverage(rows, "source")


def work_metrics(spark, sf_dir: str) -> DataFrame:
    """Order lines as records of their orders."""
    n = F.col("l_linenumber")
    kind = F.when(n % 4 == 0, "item-review").when(n % 4 == 1, "audit").otherwise("operations")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", kind.alias("kind"), F.when(n % 4 == 2, "item-lifecycle").otherwise("evidence-input").alias("type"), F.pmod("l_partkey", F.lit(9)).alias("events"), F.when(F.col("l_suppkey") % 2 == 0, 1).alias("mapping_reviews"))
    return captures.work_metrics(rows, "l_orderkey")


def report_claims(spark, sf_dir: str) -> DataFrame:
    """Products as claims of reports."""
    claim = _one_of(F.pmod("p_partkey", F.lit(len(_CLAIMS))), [t for t, *_ in _CLAIMS])
    rows = table(spark, sf_dir, "part").select("p_brand", captures.generated_behavior(claim).alias("generated"), captures.asset_event(claim).alias("event"))
    return rows.groupBy("p_brand", "generated", "event").agg(F.count("*").alias("claims"))


def asset_predicates(spark, sf_dir: str) -> DataFrame:
    """Products as files: those that exist for sure, and those whose name is too general; launch addresses."""
    k = lambda n: F.pmod("p_partkey", F.lit(n))
    none = F.lit(None).cast("string")
    name = F.when(k(4) == 0, "Final_Rubric-v2.1.PDF").when(k(4) == 1, "IG.docx").otherwise(F.concat("p_name", F.lit(".pdf")))
    concrete = captures.is_concrete_asset(F.when(k(3) == 0, F.sha2("p_name", 256)).otherwise("ab"), none, F.when(k(5) == 0, ""), F.when(k(7) == 0, k(2)), F.when(k(11) == 0, "HTTP://x").otherwise("ftp://x"))
    url = F.when(k(3) == 0, " https://Host?a=/b").when(k(3) == 1, "http://host/").otherwise("host#x")
    rows = table(spark, sf_dir, "part").select("p_brand", concrete.alias("concrete"), captures.has_generic_name(name).alias("generic"), captures.launch_key(url).alias("launch"))
    return rows.groupBy("p_brand", "concrete", "generic", "launch").agg(F.count("*").alias("files"))


def item_minutes(spark, sf_dir: str) -> DataFrame:
    """Products as rows of an export by the rule that gives their minutes."""
    k = lambda n: F.pmod("p_partkey", F.lit(n))
    tool = _one_of(k(9), ["Reading", "learningcurve", "ALVIN", "assessment", "short-form-writing", "url", "", "other", "staticfile"])
    name = _one_of(k(7), ["* Part IV here", "Chapter 3", "Chapter 3 review", "The Quiz", "Homework", "Rubric", "Instructor notes"])
    m = captures.item_minutes(F.pmod("p_size", F.lit(4)), name, F.when(k(5) == 0, "item").when(k(5) == 1, "Folder"), tool)
    rows = table(spark, sf_dir, "part").select("p_type", m.alias("m"))
    return rows.groupBy("p_type").agg(F.sum("m.minutes").alias("minutes"), F.count_if("m.counted").alias("counted"), F.array_join(F.array_sort(F.collect_set("m.rule")), ",").alias("rules"))


def course_features(spark, sf_dir: str) -> DataFrame:
    """Suppliers as courses by what their lines are, with their features rounded."""
    n = lambda rest, name: F.count_if(F.col("l_linenumber") == rest).alias(name)
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(*(n(i + 1, name) for i, name in enumerate(captures.FEATURES[:7])), F.count_if(F.col("l_returnflag") == "R").alias("orphans"))
    rows = li.withColumns({"runtimes": F.lit(-3), "total": F.when(F.col("l_suppkey") % 2 == 0, 5)})
    vector = captures.course_features(rows)
    return rows.select("l_suppkey", *(F.round(F.get(vector, i), 6).alias(name) for i, name in enumerate(captures.FEATURES)))


def interaction_candidates(spark, sf_dir: str) -> DataFrame:
    """Products as discussions: even ones are looked for among the odd ones of their brand, by the first words of a type."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("course"), F.col("p_partkey").alias("id"), F.concat(F.when(F.col("p_size") % 2 == 0, "Graded Discussion ").otherwise("Forum: "), "p_type").alias("name"))
    return captures.interaction_candidates(p.where("id % 2 = 0"), p.where("id % 2 = 1"), "course")


def text_qualities(spark, sf_dir: str) -> DataFrame:
    """Documents as extracted pages of their source, some with notes or a viewer's lines."""
    k = F.pmod("doc_id", F.lit(7))
    page = (
        F.when(k == 0, "Loading...\n / 12\n50.5%").when(k == 1, F.concat(F.lit("[PAGE 3]\n"), "text")).when(k == 2, "[GAP | none]\n\u200b").when(k == 3, F.concat(F.lit("/ 3\r\n10%\r\n"), "text")).otherwise(F.col("text"))
    )
    rows = table(spark, sf_dir, "documents").select("source", captures.text_quality(page).alias("t"))
    return rows.groupBy("source", "t.readable", "t.placeholder", "t.viewer").agg(F.count("*").alias("pages"))


def merged_questions(spark, sf_dir: str) -> DataFrame:
    """Order lines as questions of two files, some in both."""
    n = F.col("l_linenumber")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("file"), F.when(n % 2 == 0, F.pmod("l_suppkey", F.lit(3))).alias("ordinal"), F.lit(None).cast("string").alias("id"), F.col("l_linestatus").alias("prompt"), "l_linenumber")
    incoming = li.where(n > 2).withColumn("prompt", F.concat(F.lit("  "), F.lower("prompt")))
    return captures.merged_questions(li.where(n < 4), incoming, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("questions"), F.count("ordinal").alias("placed"))


def precisions(spark, sf_dir: str) -> DataFrame:
    """Products by the precision that they ask for, with the hash of an encoded name."""
    words = _one_of(F.pmod("p_partkey", F.lit(5)), ["Hundred-Thousandth", " tenth", "3 decimal places", "7 decimal places", "million"])
    return table(spark, sf_dir, "part").select("p_partkey", captures.decimal_places(words).alias("places"), captures.encoded_sha256(F.when(F.col("p_size") > 5, F.base64(F.encode("p_name", "utf-8"))).otherwise("*")).alias("sha"))


def topic_scores(spark, sf_dir: str) -> DataFrame:
    """Products against the next one as topic."""
    p = table(spark, sf_dir, "part")
    topics = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("topic"), F.col("p_brand").alias("topic_brand"), F.col("p_type").alias("topic_type"))
    score = captures.topic_score(F.when(F.col("p_partkey") % 9 == 0, F.upper("topic")).when(F.col("p_partkey") % 9 > 1, F.col("p_name")), F.col("topic"), F.col("p_brand"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")), F.col("p_type") == F.col("topic_type"))
    return p.join(topics, "p_partkey").select("p_partkey", F.round(score, 6).alias("score"))


_FUNCTIONS = (quiz_captures, assignment_behaviors, question_dimensions, bank_coverage, work_metrics, report_claims, asset_predicates, item_minutes, course_features, interaction_candidates, text_qualities, merged_questions, precisions, topic_scores)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_LENGTHS = ", ".join("NULL" if n is None else str(n) for _, n in _DECLARED)
_TOLD = ", ".join(str(g).upper() for _, g, _ in _CLAIMS)
_EVENTS = ", ".join(f"'{e}'" for *_, e in _CLAIMS)

ORACLE_SQL = {
    "quiz_captures": f"""WITH q AS (SELECT l_orderkey, l_partkey AS k, CASE l_partkey % 5 WHEN 1 THEN 25 WHEN 2 THEN 12 ELSE 0 END AS n, ([{_LENGTHS}])[l_partkey % 8 + 1] AS d FROM lineitem)
        SELECT l_orderkey, count(*) AS quizzes, sum(n)::BIGINT AS definitions, count(*) FILTER (k % 9 < 2 OR n = 0 OR coalesce(d <> n, false) OR k % 7 = 0) AS gaps FROM q GROUP BY l_orderkey""",
    "assignment_behaviors": """WITH a AS (SELECT o_orderkey % 7 AS t, CASE WHEN o_orderkey % 3 = 0 THEN 10.0 END AS points FROM orders)
        SELECT t < 5 OR points IS NOT NULL AS observed, t IN (0, 4) AS file_upload, t IN (1, 4) AS text_submission, t = 2 AS on_paper, t = 3 AS in_person, points, count(*) AS items FROM a GROUP BY ALL""",
    "question_dimensions": """WITH c AS (SELECT conv_id, coalesce(turn, 0) AS turn, role, coalesce(text, '') AS text FROM conversations), f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) = 1),
        d AS (SELECT CASE WHEN a.text = '' OR b.text = '' OR a.turn % 5 = 4 OR b.turn % 5 = 4 THEN 'U' WHEN a.text = b.text THEN 'V' ELSE 'D' END AS p, CASE WHEN a.role NOT IN ('user', 'assistant') OR b.role NOT IN ('user', 'assistant') THEN 'U' WHEN a.role = b.role THEN 'V' ELSE 'D' END AS t,
          CASE WHEN a.text = b.text THEN 'V' ELSE 'D' END AS o, CASE WHEN a.turn % 2 <> 0 OR b.turn % 2 <> 0 THEN 'U' WHEN a.role = b.role THEN 'V' ELSE 'D' END AS n, CASE WHEN a.turn % 3 <> 0 OR b.turn % 3 <> 0 THEN 'U' WHEN length(a.text) = length(b.text) THEN 'V' ELSE 'D' END AS g FROM f a JOIN c b USING (conv_id))
        SELECT CASE WHEN contains(p || t || o || n || g, 'D') THEN 'DIFFERENT' ELSE 'UNVERIFIED' END AS status, p || t || o || n || g AS states, count(*) AS questions FROM d GROUP BY ALL""",
    "bank_coverage": """SELECT source, count(*) AS total, count(*) FILTER (text <> '' AND doc_id % 3 > 0 AND doc_id % 5 > 1) AS texts, count(*) FILTER (doc_id % 2 = 0 AND doc_id % 6 > 1) AS answers,
        count(*) FILTER (doc_id % 4 < 2) AS feedback, count(*) FILTER (doc_id % 4 = 1) AS no_feedback FROM documents GROUP BY source""",
    "work_metrics": """WITH r AS (SELECT l_orderkey, l_linenumber % 4 AS n, l_partkey % 9 AS e, (l_suppkey % 2 = 0)::INT AS m FROM lineitem), c AS (SELECT l_orderkey, count(*) FILTER (n = 0) AS reviews, count(*) FILTER (n = 1) AS comparisons, count(*) FILTER (n = 3) AS intakes,
          coalesce(sum(e) FILTER (n = 2), 0)::BIGINT AS events, coalesce(sum(m) FILTER (n = 2), 0)::BIGINT AS mapping_reviews FROM r GROUP BY l_orderkey)
        SELECT *, CASE WHEN comparisons > 0 THEN reviews / comparisons END AS reviews_per_comparison FROM c""",
    "report_claims": f"""SELECT p_brand, ([{_TOLD}])[p_partkey % {len(_CLAIMS)} + 1] AS generated, ([{_EVENTS}])[p_partkey % {len(_CLAIMS)} + 1] AS event, count(*) AS claims FROM part GROUP BY ALL""",
    "asset_predicates": """SELECT p_brand, p_partkey % 3 = 0 OR (p_partkey % 7 = 0 AND p_partkey % 2 = 1) OR p_partkey % 11 = 0 AS concrete, p_partkey % 4 < 2 AS generic,
        CASE p_partkey % 3 WHEN 0 THEN 'https://Host/?a=/b' WHEN 1 THEN 'http://host/' ELSE 'host#x' END AS launch, count(*) AS files FROM part GROUP BY ALL""",
    "item_minutes": """WITH p AS (SELECT p_type, p_size % 4 AS l, p_partkey % 9 AS t, p_partkey % 7 AS n, p_partkey % 5 AS d FROM part),
        r AS (SELECT p_type, CASE WHEN l <= 1 THEN 'module-root' WHEN n = 6 THEN 'instructor-support-excluded' WHEN d = 1 OR (d > 1 AND t = 6) THEN 'container' WHEN t = 0 THEN CASE n WHEN 0 THEN 'reading-navigation-part' WHEN 1 THEN 'reading-navigation-chapter' WHEN 2 THEN 'reading-review' ELSE 'reading-section' END
          WHEN t = 1 THEN 'learningcurve-quiz' WHEN t = 2 THEN 'video' WHEN t IN (3, 4) THEN CASE WHEN n = 3 THEN 'assessment-quiz' WHEN n = 4 THEN 'assessment-activity' WHEN t = 4 THEN 'short-form-writing' ELSE 'assessment-default' END
          WHEN t IN (5, 8) THEN CASE WHEN n = 5 THEN 'reference-rubric-report' ELSE 'reference-file-url' END ELSE 'unknown-leaf-default' END AS rule FROM p),
        m AS (SELECT *, CASE rule WHEN 'reading-review' THEN 3 WHEN 'reading-section' THEN 8 WHEN 'learningcurve-quiz' THEN 10 WHEN 'assessment-quiz' THEN 10 WHEN 'video' THEN 5 WHEN 'assessment-activity' THEN 15 WHEN 'short-form-writing' THEN 15 WHEN 'assessment-default' THEN 15
          WHEN 'reference-rubric-report' THEN 2 WHEN 'reference-file-url' THEN 5 WHEN 'unknown-leaf-default' THEN 5 ELSE 0 END AS minutes FROM r)
        SELECT p_type, sum(minutes)::BIGINT AS minutes, count(*) FILTER (rule NOT IN ('module-root', 'instructor-support-excluded')) AS counted, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM m GROUP BY p_type""",
    "course_features": """WITH c AS (SELECT l_suppkey, count(*) FILTER (l_linenumber = 1) AS a, count(*) FILTER (l_linenumber = 2) AS b, count(*) FILTER (l_linenumber = 3) AS c, count(*) FILTER (l_linenumber = 4) AS d, count(*) FILTER (l_linenumber = 5) AS e,
          count(*) FILTER (l_linenumber = 6) AS f, count(*) FILTER (l_linenumber = 7) AS g, count(*) FILTER (l_returnflag = 'R') AS o FROM lineitem GROUP BY l_suppkey)
        SELECT l_suppkey, round(ln(1 + a), 6) AS webcontent, round(ln(1 + b), 6) AS assessments, round(ln(1 + c), 6) AS discussions, round(ln(1 + d), 6) AS weblinks, round(ln(1 + e), 6) AS lti, round(ln(1 + f), 6) AS empty,
          round(ln(1 + g), 6) AS "unknown", round(ln(1 + o), 6) AS orphans, 0.0 AS runtimes, round(ln(1 + CASE WHEN l_suppkey % 2 = 0 THEN 5 ELSE a + b + c + d + e + g END), 6) AS total FROM c""",
    "interaction_candidates": """WITH p AS (SELECT p_brand AS course, p_partkey AS id, lower(p_type) AS key FROM part), t AS (SELECT course, key, count(*) AS n, min(id) AS o FROM p WHERE id % 2 = 1 GROUP BY ALL)
        SELECT course, id, key, coalesce(n, 0) AS candidates, CASE WHEN n = 1 THEN o END AS candidate FROM p LEFT JOIN t USING (course, key) WHERE id % 2 = 0""",
    "text_qualities": r"""WITH d AS (SELECT source, doc_id % 7 AS k, coalesce(regexp_matches(text, '\S'), false) AS words FROM documents)
        SELECT source, k NOT IN (0, 2) AND words AS readable, k = 0 OR (k = 3 AND NOT words) AS placeholder, k = 0 OR k = 3 AS viewer, count(*) AS pages FROM d GROUP BY ALL""",
    "merged_questions": """WITH q AS (SELECT l_orderkey, l_linenumber AS n, (l_returnflag, lower(l_linestatus), CASE WHEN l_linenumber % 2 = 0 THEN (l_suppkey % 3)::VARCHAR ELSE '' END) AS k, l_linenumber % 2 = 0 AS placed FROM lineitem),
        i AS (SELECT DISTINCT l_orderkey, k, placed FROM q WHERE n > 2 AND NOT EXISTS (SELECT 1 FROM q b WHERE b.n < 4 AND b.l_orderkey = q.l_orderkey AND b.k = q.k)), u AS (SELECT l_orderkey, placed FROM q WHERE n < 4 UNION ALL SELECT l_orderkey, placed FROM i)
        SELECT l_orderkey, count(*) AS questions, count(*) FILTER (placed) AS placed FROM u GROUP BY l_orderkey""",
    "precisions": """SELECT p_partkey, ([5, 1, 3, NULL, -6])[p_partkey % 5 + 1]::INT AS places, CASE WHEN p_size > 5 THEN sha256(p_name) END AS sha FROM part""",
    "topic_scores": """WITH p AS (SELECT a.p_partkey, a.p_partkey % 9 AS k, regexp_replace(lower(a.p_name), '[^a-z0-9]', '', 'g') AS x, regexp_replace(lower(b.p_name), '[^a-z0-9]', '', 'g') AS y, a.p_type = b.p_type AS t FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
        s AS (SELECT *, CASE WHEN k = 0 OR x = y THEN 0.82 WHEN contains(x, y) OR contains(y, x) THEN 0.9 * 0.65 ELSE (1 - levenshtein(x, y) / greatest(length(x), length(y))) * 0.65 END AS base FROM p)
        SELECT p_partkey, CASE WHEN k = 1 THEN 0 ELSE round(least(1, base + CASE WHEN p_partkey % 2 = 0 THEN 0.18 ELSE 0 END + CASE WHEN t THEN 0.1 ELSE 0 END), 6) END::DOUBLE AS score FROM s""",
}
