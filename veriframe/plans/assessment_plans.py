"""Queries over questions, assessments and pairs of items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.functions import questions as q
from veriframe.operators import assessment
from veriframe.plans import sql
from veriframe.sources.tables import table

_RAW_TYPES = (
    "Multiple Choice", "Select multiple answers", "True / False", "Regex", "Numeric", "short answer", "Manual-graded file upload", "Long Answer", " ", "Drag & Drop!", "reflective text answer", "Checkbox grid",
)


def _raw_types(spark, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, _RAW_TYPES))
    pick = lambda c: F.get(names, F.pmod(F.col(c), F.lit(len(_RAW_TYPES))).cast("int"))
    return table(spark, sf_dir, "lineitem").select(pick("l_partkey").alias("a"), pick("l_suppkey").alias("b"))


def question_types(spark, sf_dir: str) -> DataFrame:
    """Pairs of raw types by their keys and whether they are alike."""
    keys = _raw_types(spark, sf_dir).groupBy("a", "b").agg(F.count("*").alias("pairs")).select(q.type_key("a").alias("a"), q.type_key("b").alias("b"), "pairs")
    return keys.groupBy("a", "b").agg(F.sum("pairs").alias("pairs")).withColumn("alike", q.types_alike(F.col("a"), F.col("b")))


def option_keys(spark, sf_dir: str) -> DataFrame:
    """Labels with and without units, powers and notes on points, by their keys."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").cast("string").alias("n"), F.col("l_linenumber").alias("k"), F.col("l_returnflag").alias("flag"))
    label = (
        F.when(F.col("k") == 1, F.concat("n", F.lit(" cm^2"))).when(F.col("k") == 2, F.concat(F.lit("−"), F.col("n"), F.lit(" M"))).when(F.col("k") == 3, F.concat(F.lit("\\frac{"), F.col("n"), F.lit("}{8} in")))
        .when(F.col("k") == 4, F.concat(F.lit("Option "), F.col("flag"), F.lit(" (0.25 pts per answer)"))).when(F.col("k") == 5, F.concat("n", F.lit("%"))).otherwise(F.concat(F.lit("Answer-"), F.col("n")))
    )
    return li.select(q.label_key(label).alias("key")).groupBy("key").agg(F.count("*").alias("labels"))


def _parts(spark, sf_dir: str) -> DataFrame:
    """Products with numbers that vary their questions."""
    mod = lambda n: F.pmod("p_partkey", F.lit(n)).cast("int")
    flag = F.substring(F.lit("ARN"), mod(3) + 1, F.lit(1))
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_size").alias("n"), (mod(7) + 1).alias("k"), (mod(11) > 5).alias("moved"), mod(9).alias("edit"), flag.alias("flag"), mod(5).alias("declared"))


def _question(side: str) -> dict:
    """A question made of a product, as its source or its target has it."""
    n, k, edit, target = F.col("n"), F.col("k"), F.col("edit"), side == "target"
    none = F.lit(None).cast("string")
    option = lambda i, right: F.struct(F.concat((n + i).cast("string"), F.lit(" cm")).alias("label"), none.alias("description"), F.lit("").alias("text"), F.lit(right).alias("correct"))
    options = F.array(option(1, True), option(2, False))
    if target:
        moved = F.array(option(F.when(F.col("moved"), 2 * 10).otherwise(1), True), option(2, False))
        options = F.when(edit > 6, F.array(option(2, False), option(1, True), option(3, False))).otherwise(moved)
    asked = F.concat(F.lit("How long is the line number "), k.cast("string"))
    kind = F.when(F.col("flag") == "A", "Multiple choice").when(F.col("flag") == "R", "true/false" if target else "radio").otherwise("essay form" if target else "numeric")
    return {
        "type": kind, "prompt": F.when(edit > 0, asked).otherwise("") if target else asked, "options": F.when(k < 6, options), "answers": F.array((n + 1).cast("string")),
        "points": F.when(k > 2, k + (edit > 7).cast("int") * int(target)),
    }


def _questions(spark, sf_dir: str, side: str) -> DataFrame:
    rows = _parts(spark, sf_dir).select("p_partkey", "p_brand", "declared", *(c.alias(n) for n, c in _question(side).items()))
    return assessment.normal_questions(rows)


def question_scores(spark, sf_dir: str) -> DataFrame:
    """Products as questions of a source, compared with what a target has of them."""
    form = lambda side: _questions(spark, sf_dir, side).select("p_partkey", F.struct("prompt", "type", "options", "answers", "points").alias(side))
    rows = assessment.compared_questions(form("source").join(form("target"), "p_partkey"))
    return rows.select("p_partkey", "score", "coverage", "mismatches")


def assessment_summary(spark, sf_dir: str) -> DataFrame:
    """Brands as assessments of their products."""
    return assessment.assessment_summary(_questions(spark, sf_dir, "target"), ["p_brand"], "declared")


def count_differences(spark, sf_dir: str) -> DataFrame:
    """What parts and order lines say about the number of questions."""
    li = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    code = assessment.count_difference(
        F.col("l_returnflag") != "A", F.when(F.col("l_tax") > 0.01, n), F.when(F.col("l_discount") > 0.01, F.pmod("l_suppkey", F.lit(9)).cast("int")), F.when(F.col("l_tax") > 0.01, n),
        F.when(F.col("l_quantity") > 45, n + F.pmod("l_partkey", F.lit(2)).cast("int")), F.col("l_quantity") < 5,
    )
    return li.select(code.alias("difference")).groupBy("difference").agg(F.count("*").alias("items"))


def pair_features(spark, sf_dir: str) -> DataFrame:
    """Each product against the next one, as a pair for the advisory model."""
    sha = F.when(F.col("p_size") < 30, F.sha2("p_brand", 256)).otherwise("none")
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.concat("p_brand", F.lit(" > "), "p_type").alias("path"), F.when(F.col("p_size") > 5, F.col("p_type")).alias("type"), sha.alias("hash"))
    a, b = (p.select((F.col("p_partkey") + step).alias("k"), *(F.col(c).alias(f"{side}_{c}") for c in ("title", "path", "type", "hash"))) for side, step in (("source", 0), ("target", -1)))
    rows = assessment.pair_features(a.join(b, "k"))
    return rows.select("k", *(F.round(F.get("features", F.lit(i)), 9).alias(f"f{i}") for i in range(9)))


def template_prompts(spark, sf_dir: str) -> DataFrame:
    """Unfilled places of templates in texts made of product names."""
    p = table(spark, sf_dir, "part")
    said = F.concat(F.lit("Welcome to [insert "), F.col("p_name"), F.lit("] by [Include your biography here] and [see 3] "), F.when(F.col("p_size") > 25, "[brief description of assignment 12][Add x]").otherwise("[insert ab] [Enter the date]"), F.lit(" [insert "), F.col("p_name"), F.lit("]"))
    return p.select("p_partkey", F.array_join(q.template_prompts(said), "|").alias("prompts"))


QUERIES = {f.__name__: f for f in (question_types, option_keys, question_scores, assessment_summary, count_differences, pair_features, template_prompts)}

_TYPE = r"""CASE WHEN trim({0}) = '' THEN 'unknown' WHEN regexp_matches({0}, 'select multiple|checkbox') THEN 'multiple-select' WHEN regexp_matches({0}, 'multiple choice|radio') THEN 'single-select'
    WHEN regexp_matches({0}, 'true\s*/\s*false') THEN 'true-false' WHEN {0} = 'regex' THEN 'regex' WHEN {0} IN ('numeric', 'short answer') THEN 'text-entry' WHEN {0} = 'reflective text answer' THEN 'essay'
    WHEN {0} = 'manual-graded file upload' THEN 'file-upload' WHEN regexp_matches({0}, 'essay|long answer') THEN 'essay' ELSE trim(regexp_replace({0}, '[^a-z0-9]+', '-', 'g'), '-') END"""
_TYPES_SQL = "[" + ", ".join(f"'{t.lower()}'" for t in _RAW_TYPES) + "]"

ORACLE_SQL = {
    "question_types": f"""WITH r AS (SELECT {_TYPES_SQL} AS t, l_partkey % 12 + 1 AS i, l_suppkey % 12 + 1 AS j FROM lineitem), k AS (SELECT {_TYPE.format('t[i]')} AS a, {_TYPE.format('t[j]')} AS b FROM r)
        SELECT a, b, count(*) AS pairs, a = b OR (a || '/' || b) IN ('single-select/true-false', 'true-false/single-select', 'regex/text-entry', 'text-entry/regex') AS alike FROM k GROUP BY a, b""",
    "option_keys": r"""WITH l AS (SELECT l_quantity::INT::VARCHAR AS n, l_linenumber AS k, l_returnflag AS f FROM lineitem)
        SELECT CASE k WHEN 1 THEN 'math:number:' || n || ':cm:2' WHEN 2 THEN 'math:number:-' || n || ':m:' WHEN 3 THEN 'math:fraction::' || n || '/8:in' WHEN 4 THEN 'option ' || lower(f) WHEN 5 THEN 'math:number:' || n || ':%:' ELSE 'answer ' || n END AS key, count(*) AS labels
        FROM l GROUP BY ALL""",
    "question_scores": """WITH l AS (SELECT p_partkey, p_partkey % 7 + 1 AS k, p_partkey % 7 < 5 AS chosen, p_partkey % 9 > 6 AS three, p_partkey % 11 > 5 AS moved, CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE 1 END AS prompt, p_partkey % 3 = 2 AS other, p_partkey % 7 > 1 AS scored, p_partkey % 9 > 7 AS raised FROM part),
        p AS (SELECT *, CASE WHEN three THEN 2.0::DOUBLE / 3 ELSE 1.0 END AS n_share, CASE WHEN three THEN 2.0::DOUBLE / 3 WHEN moved THEN 0.5 ELSE 1 END AS o_share, NOT three AND moved AND chosen AS wrong FROM l),
        s AS (SELECT *, 35.0::DOUBLE * prompt + CASE WHEN other THEN 0 ELSE 15 END + CASE WHEN chosen THEN 10 * n_share + 10 * o_share ELSE 0 END + 10 + CASE WHEN wrong THEN 0 ELSE 15 END + CASE WHEN scored AND NOT raised THEN 5 ELSE 0 END AS earned,
          35 + 15 + 25 + CASE WHEN chosen THEN 20 ELSE 0 END + CASE WHEN scored THEN 5 ELSE 0 END AS possible FROM p)
        SELECT p_partkey, round(earned / possible, 9) AS score, possible / 100.0::DOUBLE AS coverage, array_to_string(list_filter([CASE WHEN prompt = 0 THEN 'PROMPT' END, CASE WHEN other THEN 'TYPE' END, CASE WHEN chosen AND three THEN 'OPTION_COUNT' END,
          CASE WHEN chosen AND o_share < 0.72 THEN 'OPTIONS' END, CASE WHEN wrong THEN 'CORRECT_ANSWER' END, CASE WHEN scored AND raised THEN 'POINTS' END], lambda x: x IS NOT NULL), ',') AS mismatches FROM s""",
    "assessment_summary": """SELECT p_brand, count(*) AS questions, CASE WHEN max(p_partkey % 5) >= 1 THEN max(p_partkey % 5) ELSE count(*) END AS declared, count(*) FILTER (p_partkey % 3 <> 2 OR p_partkey % 7 < 5) AS answerable,
        count(*) FILTER (p_partkey % 3 <> 2 OR p_partkey % 7 < 5) AS answer_evidence FROM part GROUP BY p_brand""",
    "count_differences": """WITH l AS (SELECT l_returnflag <> 'A' AS direct, CASE WHEN l_tax > 0.01 THEN l_linenumber END AS e, CASE WHEN l_discount > 0.01 THEN l_suppkey % 9 END AS a, CASE WHEN l_quantity > 45 THEN l_linenumber + l_partkey % 2 END AS r, l_quantity < 5 AS sel FROM lineitem),
        w AS (SELECT *, coalesce(r, e) AS w FROM l)
        SELECT CASE WHEN NOT direct THEN 'NOT_MAPPED' WHEN w IS NULL THEN 'SOURCE_UNKNOWN' WHEN a IS NULL THEN 'TARGET_UNKNOWN' WHEN r IS NOT NULL AND e IS NOT NULL AND e <> w THEN 'REFERENCE_DIFFERS' WHEN sel THEN 'SELECTION' WHEN w = a THEN 'EQUAL'
          WHEN w > a THEN 'FEWER:' || (w - a) ELSE 'MORE:' || (a - w) END AS difference, count(*) AS items FROM w GROUP BY ALL""",
    "pair_features": f"""WITH p AS (SELECT p_partkey AS k, {sql.name('p_name')} AS t, {sql.name("p_brand || ' > ' || p_type")} AS d, CASE WHEN p_size > 5 THEN {sql.name('p_type')} ELSE '' END AS y, CASE WHEN p_size < 30 THEN sha256(p_brand) ELSE '' END AS h FROM part),
        x AS (SELECT a.k, a.t AS t, b.t AS u, a.d AS d, b.d AS e, a.y AS y, b.y AS z, a.h AS h, b.h AS i, list_distinct(string_split(a.t, ' ')) AS ta, list_distinct(string_split(b.t, ' ')) AS tb, list_distinct(string_split(a.d, ' ')) AS da, list_distinct(string_split(b.d, ' ')) AS db FROM p a JOIN p b ON b.k = a.k + 1)
        SELECT k, round({sql.overlap('ta', 'tb')}, 9) AS f0, round({sql.overlap('da', 'db')}, 9) AS f1, (t <> '' AND t = u)::INT::DOUBLE AS f2, (y <> '' AND y = z)::INT::DOUBLE AS f3, (h <> '' AND h = i)::INT::DOUBLE AS f4, (t <> '' AND u <> '')::INT::DOUBLE AS f5,
          (d <> '' AND e <> '')::INT::DOUBLE AS f6, (y <> '' AND z <> '')::INT::DOUBLE AS f7, (h <> '' AND i <> '')::INT::DOUBLE AS f8 FROM x""",
    "template_prompts": """SELECT p_partkey, '[insert ' || p_name || ']|[Include your biography here]|' || CASE WHEN p_size > 25 THEN '[brief description of assignment 12]' ELSE '[Enter the date]' END AS prompts FROM part""",
}
