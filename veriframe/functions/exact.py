"""Exact arithmetic on short expressions. Built-in decimals end at 38 digits and round; sums of fractions do
neither here, so this is one of the few places where a Python function works row by row (in Arrow batches)."""

from __future__ import annotations

import ast
import operator
import re
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_CHARS, MAX_DEPTH, MAX_POWER, MAX_DIGITS = 600, 20, 12, 500
# Signs that stand for the plain operators.
_SIGNS = str.maketrans({"−": "-", "–": "-", "×": "*", "·": "*", "÷": "/", " ": " "})
_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv}


def _value(node: ast.expr, source: str, depth: int = 0) -> Fraction:
    if depth > MAX_DEPTH:
        raise ValueError("too deep")
    if isinstance(node, ast.Constant):
        return Fraction(ast.get_source_segment(source, node))
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub | ast.UAdd):
        inner = _value(node.operand, source, depth + 1)
        return -inner if isinstance(node.op, ast.USub) else inner
    if not isinstance(node, ast.BinOp):
        raise ValueError("not arithmetic")
    left, right = (_value(x, source, depth + 1) for x in (node.left, node.right))
    if isinstance(node.op, ast.Pow):
        if right.denominator != 1 or abs(right) > MAX_POWER or (left == 0 and right <= 0):
            raise ValueError("power")
        out = left ** int(right)
    else:
        out = _BINARY[type(node.op)](left, right)
    if max(len(str(out.numerator)), len(str(out.denominator))) > MAX_DIGITS:
        raise ValueError("too large")
    return out


def evaluate(text: str | None) -> Fraction | None:
    """Value of an expression of numbers, + - * / ^ %, and brackets; None for anything else, so that what is not
    understood stays unknown."""
    plain = (text or "").translate(_SIGNS).strip()
    if not plain or len(plain) > MAX_CHARS or re.search(r"[^\d.\s()+*/^%-]", plain) or "**" in plain or "//" in plain:
        return None
    source = re.sub(r"(\d+(?:\.\d+)?|\.\d+|\))\s*%", r"\1/100", plain) if "%" in plain else plain
    source = re.sub(r"(?<![\d.])0+(?=\d)", "", source).replace("^", "**")
    try:
        return _value(ast.parse(source, mode="eval").body, source)
    except (SyntaxError, ValueError, KeyError, ZeroDivisionError):
        return None


def rounded(value: Fraction, places: int) -> str | None:
    """Text with ``places`` decimals; None half-way between two, where conventions differ."""
    scaled = abs(value) * 10**places
    whole, rest = divmod(scaled.numerator, scaled.denominator)
    if rest * 2 == scaled.denominator:
        return None
    digits = str(whole + (rest * 2 > scaled.denominator)).rjust(places + 1, "0")
    sign = "-" if value < 0 and digits.strip("0") else ""
    return sign + (f"{digits[:-places]}.{digits[-places:]}" if places else digits)


_FIELDS = T.StructType([T.StructField("numerator", T.StringType()), T.StructField("denominator", T.StringType()), T.StructField("text", T.StringType())])


def exact(expression: Column, places: int = 4) -> Column:
    """struct(numerator, denominator, text) of an expression, all null if it is not understood."""

    @F.pandas_udf(_FIELDS)
    def run(texts):
        import pandas as pd

        values = [evaluate(t) for t in texts]
        return pd.DataFrame([(None, None, None) if v is None else (str(v.numerator), str(v.denominator), rounded(v, places)) for v in values], columns=_FIELDS.names)

    return run(expression)
