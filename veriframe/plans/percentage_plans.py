"""Queries over percentage questions made of order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.functions import percentages
from veriframe.sources.tables import table


def answer_checks(spark, sf_dir: str) -> DataFrame:
    """Lines as questions in several forms, with choices of which one, none or two are right and a key that may be another."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_quantity").cast("int").alias("q"), "l_linenumber")
    k = lambda n: F.pmod("l_partkey", F.lit(n)).cast("int")
    rows = li.groupBy(k(8).alias("form"), (k(20) + 1).alias("r"), F.col("q"), k(3).alias("c"), k(4).alias("key")).agg(F.count("*").alias("questions"))
    q, r = F.col("q").cast("string"), F.col("r").cast("string")
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    form = F.col("form")
    prompt = (
        F.when(form == 0, said("What is ", r, "% of ", q, "?")).when(form == 1, said("What percent of 40 is ", q, "?")).when(form == 2, said(q, " is what percentage of 40.")).when(form == 3, said(q, " is ", r, "% of 100"))
        .when(form == 4, said(q, " is 25% of what number?")).when(form == 5, said("What percent of 8 is ", q, "? Round your answer to the nearest whole percent")).when(form == 6, said("About ", r, "% of ", q)).otherwise(said("Calculate ", r, "% of ", q, " roughly"))
    )
    # Hundredths of the right value, and the unit of its choices.
    cents = F.when(form == 0, F.col("q") * F.col("r")).when(form.isin(1, 2), F.col("q") * 250).when(form == 4, F.col("q") * 400).otherwise(F.col("q") * 1250)
    unit = F.when(form.isin(1, 2, 5), "%").otherwise("")
    choice = lambda c: said(F.format_string("%d.%02d", F.floor(c / 100), c % 100), unit)
    options = F.when(form == 3, F.array(F.lit("True"), F.lit("False"))).when(F.col("c") == 0, F.array(choice(cents + 100), choice(cents))).when(F.col("c") == 1, F.array(choice(cents), choice(cents + 100), choice(cents))).otherwise(F.array(choice(cents + 100), F.lit("none of these")))
    kind = F.when(form == 3, "true/false").otherwise("choice")
    check = percentages.answer_check(prompt, kind, options, F.when(F.col("key") < 3, F.col("key")))
    return rows.withColumn("a", check).select("form", "r", "q", "c", "key", "questions", "a.outcome", "a.value", "a.selected", "a.comparison")


QUERIES = {"answer_checks": answer_checks}

_TEXT = "regexp_replace(regexp_replace(printf('%d.%02d', {0} // 100, {0} % 100), '0+$', ''), '[.]$', '')"
ORACLE_SQL = {
    "answer_checks": f"""WITH g AS (SELECT (l_partkey % 8)::INT AS form, (l_partkey % 20 + 1)::INT AS r, l_quantity::INT AS q, (l_partkey % 3)::INT AS c, (l_partkey % 4)::INT AS key, count(*) AS questions FROM lineitem GROUP BY ALL),
        v AS (SELECT *, CASE WHEN form = 0 THEN q * r WHEN form IN (1, 2) THEN q * 250 WHEN form = 4 THEN q * 400 WHEN form = 5 THEN q * 1250 END::BIGINT AS cents, form = 3 AS truth, form = 5 AND q % 2 = 1 AND q * 1250 % 100 = 50 AS half FROM g),
        o AS (SELECT *, CASE WHEN form > 5 THEN 'UNKNOWN' WHEN half THEN 'HALFWAY' WHEN truth THEN 'CALCULATED' WHEN c = 0 THEN 'CALCULATED' WHEN c = 1 THEN 'SEVERAL_CHOICES' ELSE 'CHOICES' END AS outcome FROM v),
        s AS (SELECT *, CASE WHEN outcome <> 'CALCULATED' THEN NULL WHEN truth THEN CASE WHEN q = r THEN 0 ELSE 1 END ELSE 1 END AS selected FROM o)
        SELECT form, r, q, c, key, questions, outcome, CASE WHEN form > 5 OR half THEN NULL WHEN truth THEN (q = r)::VARCHAR ELSE {_TEXT.format('cents')} || CASE WHEN form IN (1, 2, 5) THEN '%' ELSE '' END END AS value, selected,
          CASE WHEN selected IS NULL THEN NULL WHEN key = 3 THEN 'NO_KEY' WHEN key = selected THEN 'AGREES' ELSE 'CONFLICT' END AS comparison FROM s""",
}
