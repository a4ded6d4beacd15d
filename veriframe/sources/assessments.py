"""Question banks: interchange XML and line-based bank files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriframe.sources.archives import parse_xml

_QUESTIONS = "array<struct<question_id:string,prompt:string,kind:string,options:array<struct<ident:string,text:string,correct:boolean>>>>"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _first(element, name: str):
    return next((e for e in element.iter() if _local(e.tag) == name), None)


def _said(element) -> str:
    return " ".join(" ".join(element.itertext()).split()) if element is not None else ""


def _questions(content: str | None) -> list[dict]:
    root, _ = parse_xml(content or "")
    out = []
    for item in (e for e in (root.iter() if root is not None else ()) if _local(e.tag) == "item"):
        presentation = _first(item, "presentation")
        right: set[str] = set()
        for condition in (e for e in item.iter() if _local(e.tag) == "conditionvar"):
            refused = {id(x) for n in condition.iter() if _local(n.tag) == "not" for x in n.iter()}
            right |= {(e.text or "").strip() for e in condition.iter() if _local(e.tag) == "varequal" and id(e) not in refused}
        labels = [e for e in item.iter() if _local(e.tag) == "response_label"]
        marked = bool(right)  # without an answer key correctness is unknown, not false
        options = [{"ident": e.get("ident"), "text": _said(e), "correct": (e.get("ident") in right) if marked else None} for e in labels]
        kind = "choice" if labels else "text"
        if presentation is not None and any(_local(e.tag) == "response_lid" and e.get("rcardinality", "").lower() == "multiple" for e in presentation.iter()):
            kind = "multiple"
        prompt = _said(_first(presentation, "mattext")) if presentation is not None else ""
        out.append({"question_id": item.get("ident"), "prompt": prompt, "kind": kind, "options": options})
    return out


def qti_questions(documents: DataFrame, text_column: str = "text") -> DataFrame:
    """``documents`` with one row per question of their XML: question_id, prompt, kind, options(ident, text, correct).
    An answer under a negation is never a correct one."""

    @F.pandas_udf(_QUESTIONS)
    def read(texts):
        import pandas as pd

        return pd.Series([_questions(t) for t in texts])

    keep = [c for c in documents.columns if c != text_column]
    return documents.select(*keep, F.explode(read(F.col(text_column))).alias("q")).select(*keep, "q.*")


def bank_questions(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Questions of line banks: lines(keys, place, line) with NewQuestion, QuestionText and Option fields, comma-separated,
    quoted where they must be; a text that isn't quoted goes on to the end of its line, less the format that ends
    it. One row per question: kind, prompt, options (text, weight) in order, how many are right, its gaps and state.
    A question runs to the next NewQuestion; one with gaps is INCOMPLETE."""
    cells = F.from_csv("line", F.lit("field string, first string, second string"), {"mode": "PERMISSIVE"})
    after = lambda c: F.trim(F.regexp_replace(c, r"^[^,]*,", ""))  # noqa: E731  what follows the first field
    ended = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r",+\s*$", ""), r"(?i),\s*(?:html|text)\s*$", ""))
    rows = lines.select(*keys, "place", cells.alias("c"), after(F.col("line")).alias("first"), after(after(F.col("line"))).alias("second")).withColumn("field", F.trim("c.field"))
    w = Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("question", F.sum((F.col("field") == "NewQuestion").cast("int")).over(w)).where("question > 0")
    text = lambda n: F.trim(F.when(F.startswith(n, F.lit('"')), F.col(f"c.{n}")).otherwise(ended(F.col(n))))
    option = F.struct("place", text("second").alias("text"), F.trim("c.first").try_cast("double").alias("weight"))
    grouped = rows.groupBy(*keys, "question").agg(
        F.max(F.when(F.col("field") == "NewQuestion", F.trim("c.first"))).alias("kind"), F.max(F.when(F.col("field") == "QuestionText", text("first"))).alias("prompt"),
        F.sort_array(F.collect_list(F.when(F.col("field") == "Option", option))).alias("listed"),
    )
    options = F.transform("listed", lambda o: F.struct(o["text"].alias("text"), o["weight"].alias("weight")))
    gaps = F.array_compact(F.array(F.when(F.coalesce("prompt", F.lit("")) == "", "PROMPT"), F.when(F.size("listed") < 2, "OPTIONS"), F.when(F.exists("listed", lambda o: o["weight"].isNull()), "WEIGHT")))
    out = grouped.select(*keys, "question", "kind", "prompt", options.alias("options"), gaps.alias("gaps"))
    right = F.size(F.filter("options", lambda o: o["weight"] == 100)).cast("long")
    return out.select(*keys, "question", "kind", "prompt", "options", right.alias("right"), F.array_join("gaps", ",").alias("gaps"), F.when(F.size("gaps") == 0, "COMPLETE").otherwise("INCOMPLETE").alias("state"))
