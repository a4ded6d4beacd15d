"""Percentage questions: whole prompts of a few forms become exact expressions, and choices and keys are held against their value.

A prompt is read only if all of it fits a form; what fits none stays unknown. Choices are compared exactly: no rounding is
assumed that the prompt doesn't ask for, and no unit is dropped.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriframe.functions.exact import evaluate, rounded
from veriframe.functions.text import clean_text, let

# Forms of prompts, the expression each stands for, what is stated (for true or false), and whether the answer is a percentage.
_N = r"([+-]?(?:\d+(?:\.\d+)?|\.\d+))"
FORMS = (
    (rf"(?i)^(?:What is |Calculate )?{_N}% of {_N}(?: is what)?$", "$1% * $2", None, False),
    (rf"(?i)^What (?:percent|percentage) of {_N} is {_N}$", "$2 / $1", None, True),
    (rf"(?i)^{_N} is what (?:percent|percentage) of {_N}$", "$1 / $2", None, True),
    (rf"(?i)^{_N} is {_N}% of {_N}$", "$2% * $3", "$1", False),
    (rf"(?i)^{_N} is {_N}% of what(?: number)?$", "$1 / ($2%)", None, False),
)
ROUNDING = r"(?i)^(.+?)[?.]? (?:Express|Round) (?:your |the )?answer to the nearest (whole percent|tenth of a percent|hundredth of a percent)$"
TRUE_FALSE = r"(?i)true.?false"
UNDECIDED = r"(?i)blanks|essay|matching|multiple.?response|multi.?select"
MOST_PROMPT, MOST_OPTIONS = 1200, 200

_READ = "struct<expression:string,stated:string,percent:boolean,places:int>"
_CHECKED = T.StructType([
    T.StructField("value", T.StringType()), T.StructField("truth", T.BooleanType()), T.StructField("states", T.ArrayType(T.IntegerType())), T.StructField("problem", T.StringType()),
])


def read_prompt(c: Column | str) -> Column:
    """struct(expression, stated, percent, places) of a prompt in one of the forms, else null; ``places`` are the decimals its percentage is to
    be rounded to, null for none. An instruction given twice is not read."""
    plain = F.trim(F.regexp_replace(F.translate(clean_text(c), "−–", "--"), r"[?.]$", ""))

    def forms(p: Column, places: Column) -> Column:
        out = F.lit(None).cast(_READ)
        for pattern, expression, stated, percent in reversed(FORMS):
            told = F.regexp_replace(p, pattern, stated) if stated else F.lit(None).cast("string")
            read = F.struct(F.regexp_replace(p, pattern, expression).alias("expression"), told.alias("stated"), F.lit(percent).alias("percent"), places.alias("places"))
            out = F.when(p.rlike(pattern) & (F.lit(percent) | places.isNull()), read).otherwise(out)
        return out

    def either(p: Column) -> Column:
        kind = F.lower(F.regexp_extract(p, ROUNDING, 2))
        places = F.when(F.contains(kind, F.lit("whole")), 0).when(F.contains(kind, F.lit("hundredth")), 2).otherwise(1)
        rest = F.regexp_replace(p, ROUNDING, "$1")
        once = F.when(rest.rlike(r"(?i)\b(?:Express|Round)\b"), F.lit(None).cast(_READ)).otherwise(forms(rest, places))
        return F.when(p.rlike(ROUNDING), once).otherwise(forms(p, F.lit(None).cast("int")))

    return let(plain, either)


def _number(value: Fraction) -> str:
    """A whole or ended decimal number, else a fraction."""
    for places in range(13):
        if (value * 10**places).denominator == 1:
            return rounded(value, places)
    return f"{value.numerator}/{value.denominator}"


def _check(expression: str | None, stated: str | None, percent: bool, places, options) -> tuple:
    if expression is None:
        return None, None, None, "UNKNOWN"
    value = evaluate(expression)
    if value is None:
        return None, None, None, "UNSUPPORTED"
    if stated is not None:
        return None, evaluate(stated) == value, None, None
    if places is not None and places == places:  # neither null nor not a number
        text = rounded(value * 100, int(places))
        if text is None:
            return None, None, None, "HALFWAY"
        value = Fraction(text) / 100
    said = f"{_number(value * 100)}%" if percent else _number(value)
    states = []
    for option in options if options is not None else ():
        plain = (option or "").strip()
        found = evaluate(plain) if plain.endswith("%") or not percent else None
        states.append(-1 if found is None else int(found == value))
    return said, None, states, None


def checked_value(read: Column, options: Column) -> Column:
    """struct(value, truth, states, problem): the exact answer of a read prompt as text, or whether what it states is true; of each option 1
    if it has that value, 0 if another, -1 if it is no number of the kind asked for. The problem of a prompt that was not read is UNKNOWN."""

    @F.pandas_udf(_CHECKED)
    def run(forms, choices):
        import pandas as pd

        columns = (forms[c] for c in ("expression", "stated", "percent", "places"))
        rows = [_check(e, s, e is not None and bool(p), n, o) for e, s, p, n, o in zip(*columns, choices, strict=True)]
        return pd.DataFrame(rows, columns=_CHECKED.names).astype({"truth": "boolean"})

    return run(read, options)


def answer_check(prompt: Column, kind: Column, options: Column, key: Column) -> Column:
    """struct(outcome, value, selected, comparison) of a question: ``options`` are texts, ``key`` the place of the right one by its source, from 0,
    or null. The outcome is CALCULATED, or says why it isn't; ``comparison`` is AGREES, CONFLICT or NO_KEY where an option was selected."""
    read = F.when((F.length(F.coalesce(prompt, F.lit(""))) <= MOST_PROMPT) & (F.size(F.coalesce(options, F.array().cast("array<string>"))) <= MOST_OPTIONS) & ~F.coalesce(kind, F.lit("")).rlike(UNDECIDED), read_prompt(prompt))
    choices = F.coalesce(options, F.array().cast("array<string>"))
    found = checked_value(read, choices)
    is_truth = F.coalesce(kind, F.lit("")).rlike(TRUE_FALSE)
    labels = F.transform(choices, lambda o: F.lower(F.trim(o)))
    both = (F.size(labels) == 2) & F.array_contains(labels, "true") & F.array_contains(labels, "false")

    def outcome(v: Column) -> Column:
        hits = F.size(F.filter(v["states"], lambda s: s == 1))
        state = (
            F.when(v["problem"].isNotNull(), v["problem"]).when(v["truth"].isNotNull() != is_truth, "OTHER_TYPE").when(is_truth & ~both, "LABELS")
            .when(is_truth | (F.size(choices) == 0), "CALCULATED").when(F.array_contains(v["states"], -1), "CHOICES").when(hits == 0, "NO_CHOICE").when(hits > 1, "SEVERAL_CHOICES").otherwise("CALCULATED")
        )
        place = F.when(is_truth, F.array_position(labels, v["truth"].cast("string"))).otherwise(F.array_position(v["states"], 1))
        selected = F.when((state == "CALCULATED") & (place > 0), (place - 1).cast("int"))
        value = F.when(is_truth & v["truth"].isNotNull(), v["truth"].cast("string")).otherwise(v["value"])
        comparison = F.when(selected.isNull(), F.lit(None).cast("string")).when(key.isNull(), "NO_KEY").when(key == selected, "AGREES").otherwise("CONFLICT")
        return F.struct(state.alias("outcome"), value.alias("value"), selected.alias("selected"), comparison.alias("comparison"))

    return let(found, outcome)
