"""Licence scans: ordered signature rules behind a keyword prefilter.

A rule's regex runs only on texts that hold one of its keywords (one automaton pass finds them all).
A detection whose interval lies inside one of a rule with a better priority is suppressed, so a specific signature
hides the general ones it contains. Runs of blanks, line ends among them, count as one blank; spans are those of
the text as it is. Time grows with a text's length and the number of its places, whatever there are of them.

Edge cases: a null text is empty; texts without words give zero counts, null positions, empty label
lists and score 0; repeated rows give repeated results; other columns pass through unread.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import cache
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, table
from .license_rules import Rule, rules

#: Base phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
BASE_WEIGHT = 0.75
_WORDS = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


@cache
def _matcher():
    import ahocorasick

    by_keyword: dict[str, list[Rule]] = {}
    for rule in rules():
        for word in rule.keywords:
            by_keyword.setdefault(word, []).append(rule)
    automaton = ahocorasick.Automaton()
    for word, own in by_keyword.items():
        automaton.add_word(word, own)
    automaton.make_automaton()
    return automaton, {r.priority: re.compile(r.pattern) for r in rules()}


class _Reach:
    """The largest end among the detections of rules before a given one (a Fenwick tree over rules)."""

    def __init__(self, n: int):
        self.ends = [-1] * (n + 1)

    def put(self, rule: int, end: int) -> None:
        rule += 1
        while rule < len(self.ends):
            self.ends[rule] = max(self.ends[rule], end)
            rule += rule & -rule

    def before(self, rule: int) -> int:
        most = -1
        while rule > 0:
            most = max(most, self.ends[rule])
            rule -= rule & -rule
        return most


def detections(text: str) -> list[tuple[int, int, Rule]]:
    """(start, end, rule) of the signatures kept in the whole ASCII-lower-cased ``text`` with single blanks, best rule
    first. A detection inside any of a better rule is left out; one sweep by start, as a better detection around a
    suppressed one lies in what suppressed that."""
    automaton, compiled = _matcher()
    open_rules = {rule.priority: rule for _, own in automaton.iter(text) for rule in own}
    spans = [(m.start(), p, m.end()) for p in open_rules for m in compiled[p].finditer(text) if m.end() > m.start()]
    reach, kept = _Reach(1 + max(open_rules, default=0)), []
    for start, priority, end in sorted(spans):
        if reach.before(priority) < end:
            kept.append((priority, start, end))
        reach.put(priority, end)
    return [(start, end, open_rules[p]) for p, start, end in sorted(kept)]


def _in_original(spans: list[tuple[int, int, Rule]], text: str) -> list[tuple[int, int, Rule]]:
    """Spans of the text with single blanks as spans of ``text``."""
    starts = [m.span() for m in re.finditer(r"\S+", text)]
    places = [0, *accumulate(b - a + 1 for a, b in starts)]

    def at(place: int) -> int:
        word = min(bisect_right(places, place) - 1, len(starts) - 1)
        return starts[word][0] + place - places[word]

    return [(at(a), at(b), rule) for a, b, rule in spans]


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(word, label) of the base phrases; blanks are counted once along the text."""
    joined = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in BASE_PHRASES.items():
        needle = f" {phrase} ".encode()
        at = joined.find(needle)
        while at >= 0:
            found.append((at, label))
            at = joined.find(needle, at + 1)
    places, seen, last = [], 0, 0
    for at, label in sorted(found):
        seen, last = seen + joined.count(b" ", last, at), at
        places.append((seen, label))
    return places


def scan(text: str | None) -> tuple:
    lowered = (text or "").translate(_ASCII_LOWER)
    words = lowered.encode("utf-8", "surrogatepass").translate(_WORDS).split()
    places = base_places(words) if "license" in lowered else []
    kept = detections(" ".join(lowered.split()))
    kept = _in_original(kept, lowered) if kept else kept
    base = {label for _, label in places}
    missed = 1.0
    for weight in [BASE_WEIGHT] * bool(places) + [rule.weight for _, _, rule in kept]:
        missed *= 1 - weight
    starts = [p for p, _ in places]
    return (
        len(words), len(places), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(base | {rule.label for _, _, rule in kept})), 1 - missed,
        [(a, b, rule.kind, rule.label) for a, b, rule in kept],
    )


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("label", T.StringType())])
_FIELDS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")]
    + [T.StructField(n, T.StringType()) for n in ("base_labels", "labels")]
    + [T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(_SPAN))]
)


def scan_licenses(documents: DataFrame, text_column: str = "text", into: str = "licenses") -> DataFrame:
    """``documents`` with a struct of counts, labels, score and kept spans; one pass, no shuffle."""

    @F.pandas_udf(_FIELDS)
    def scanned(texts):
        import pandas as pd

        out = pd.DataFrame([scan(t) for t in texts], columns=_FIELDS.names)
        out["spans"] = [[dict(zip(("start", "end", "kind", "label"), s, strict=True)) for s in row] for row in out["spans"]]
        return out.astype({"first_word": "Int64", "last_word": "Int64"})

    return documents.withColumn(fresh(documents, into), scanned(F.col(text_column)))


def op4_license_scans(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *(f"licenses.{c}" for c in _FIELDS.names[:-1]))
