"""Where in a text another one stands: the best of its segments, and the best window of its words.

Windows of six sizes around the wanted text's length move over the whole source. What a window is scored by (distinct words and pairs of
words with meaning, distinct words of any kind, character trigrams) is kept as multisets that words enter and leave, so the
work for a size is linear in the source, whatever the window's length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.functions.text import MORE_STOP_WORDS, SPACE, STOP_WORDS
from veriframe.operators.similarity import directional_coverage

# Sizes of windows as shares of the wanted text, weights of a score, what a result needs.
SIZES = (0.72, 0.90, 1.08, 1.30, 1.58, 1.95)
LEAST_WINDOW, LEAST_STEP, MOST_STEP = 24, 6, 48
WEIGHTS = {"tokens": 0.38, "forward": 0.22, "reverse": 0.07, "lexical": 0.13, "grams": 0.10, "length": 0.10}
CONFIDENCE = {"score": 0.50, "tokens": 0.32, "forward": 0.10, "length": 0.08}
LEAST_TOKENS, LEAST_SCORE, LEAST_DISTINCT = 0.34, 0.40, 8
SHORT, FEW = 80, 12  # texts and token lists below are too small for a direction

_SPACES = re.compile(SPACE + "+")
_WORD = re.compile(r"(?<![A-Za-z0-9_])[a-z0-9]+(?![A-Za-z0-9_])")
_NAME = re.compile(r"[^a-z0-9]+")


def _tidy(text: str | None) -> str:
    return _SPACES.sub(" ", text or "").strip(" ")


def _name(text: str) -> str:
    return _NAME.sub(" ", text.lower()).strip()


class Bag:
    """A multiset of the window's values, against those of the wanted text."""

    def __init__(self, values: list, wanted: Counter):
        self.values, self.wanted, self.held = values, wanted, {}
        self.low = self.high = self.shared = self.dot = self.square = 0

    def move(self, low: int, high: int) -> None:
        """To values[low:high]; neither end moves back."""
        for v in self.values[self.high : high]:
            n = self.held.get(v, 0)
            w = self.wanted.get(v, 0)
            self.held[v] = n + 1
            self.square += 2 * n + 1
            self.dot += w
            self.shared += n == 0 and w > 0
        self.high = max(self.high, high)
        for v in self.values[self.low : low]:
            n = self.held[v]
            w = self.wanted.get(v, 0)
            if n == 1:
                del self.held[v]
                self.shared -= w > 0
            else:
                self.held[v] = n - 1
            self.square -= 2 * n - 1
            self.dot -= w
        self.low = max(self.low, low)


def _starts(n: int, size: int, step: int) -> list[int]:
    out = list(range(0, n - size + 1, step))
    return out if out and out[-1] == n - size else [*out, max(0, n - size)]


def _ends(parts: list[list]) -> list[int]:
    out = [0]
    for p in parts:
        out.append(out[-1] + len(p))
    return out


def best_window(source: str | None, target: str | None) -> dict | None:
    """The words of ``source`` that say most of what ``target`` says: kind EXACT if it stands there, WINDOW with its place and
    scores, or NONE with the scores of the best one; null if the texts don't allow a search or are of one size already."""
    source, target = _tidy(source), _tidy(target)
    meaning = lambda words: [w for w in words if len(w) > 2 and w not in MORE_STOP_WORDS]
    wanted = meaning(_WORD.findall(target.lower()))
    distinct = Counter(wanted)
    if len(source) < 100 or len(target) < 40 or len(distinct) < LEAST_DISTINCT:
        return None
    name = _name(target)
    if len(name) >= 40 and name in _name(source):
        return {"kind": "EXACT", "start": None, "size": None, "score": 1.0, "tokens": 1.0, "confidence": 1.0}
    words, size_wanted = source.split(" "), len(target.split(" "))
    n = len(words)
    if n < LEAST_WINDOW or size_wanted < 10 or n <= max(size_wanted * 1.45, size_wanted + 45):
        return None
    parts = [_WORD.findall(w.lower()) for w in words]
    senses = [meaning(p) for p in parts]
    told = [t for s in senses for t in s]
    stream = [w for p in parts for w in p if w not in STOP_WORDS]
    lower = source.lower()
    wanted_words = set(_WORD.findall(target.lower())) - set(STOP_WORDS)
    wanted_pairs = Counter(zip(wanted, wanted[1:], strict=False))
    grams = Counter(target.lower()[i : i + 3] for i in range(len(target) - 2))
    norm = sum(v * v for v in grams.values())
    of_sense, of_word = _ends(senses), _ends([[w for w in p if w not in STOP_WORDS] for p in parts])
    of_char = [0]
    for w in words:
        of_char.append(of_char[-1] + len(w) + 1)
    step = max(LEAST_STEP, min(MOST_STEP, size_wanted // 5 or LEAST_STEP))
    best = None
    for size in dict.fromkeys(max(LEAST_WINDOW, min(n, int(size_wanted * m + 0.5))) for m in SIZES):
        tokens, lexical = Bag(told, distinct), Bag(stream, Counter(wanted_words))
        pairs, chars = Bag(list(zip(told, told[1:], strict=False)), wanted_pairs), Bag([lower[i : i + 3] for i in range(len(lower) - 2)], grams)
        for start in _starts(n, size, step):
            a, z = of_sense[start], of_sense[start + size]
            c, d = of_char[start], of_char[start + size] - 1
            tokens.move(a, z)
            pairs.move(a, max(a, z - 1))
            lexical.move(of_word[start], of_word[start + size])
            chars.move(c, max(c, d - 2))
            if d - c < SHORT:
                continue
            gram = chars.dot / (chars.square * norm) ** 0.5 if chars.square and norm else 0.0
            forward = reverse = 0.0
            if len(target) >= SHORT:
                inside = len(tokens.held) == tokens.shared and len(reversed_ := _name(source[c:d])) >= SHORT and reversed_ in name
                if len(wanted) >= FEW and z - a >= FEW:
                    forward = 0.42 * tokens.shared / len(distinct) + 0.43 * (pairs.shared / len(wanted_pairs) if wanted_pairs else 0) + 0.15 * gram
                    reverse = 0.42 * tokens.shared / len(tokens.held) + 0.43 * (pairs.shared / len(pairs.held) if pairs.held else 0) + 0.15 * gram
                reverse = 1.0 if inside else reverse
            found = {
                "tokens": tokens.shared / len(distinct), "forward": min(1.0, forward), "reverse": min(1.0, reverse), "grams": gram,
                "lexical": lexical.shared / (len(lexical.held) + len(wanted_words) - lexical.shared) if lexical.held and wanted_words else 0.0,
                "length": min(len(target), d - c) / max(len(target), d - c),
            }
            score = sum(found[k] * w for k, w in WEIGHTS.items())
            if best is None or round(score, 12) > round(best["score"], 12):
                best = {"score": score, "start": start, "size": size, **found}
    if best is None:
        return None
    kind = "WINDOW" if best["tokens"] >= LEAST_TOKENS and best["score"] >= LEAST_SCORE else "NONE"
    confidence = max(0.0, min(1.0, sum(best[k] * w for k, w in CONFIDENCE.items()))) if kind == "WINDOW" else 0.0
    return {"kind": kind, "start": best["start"], "size": best["size"], "score": round(best["score"], 9), "tokens": round(best["tokens"], 9), "confidence": round(confidence, 9)}


_RESULT = [("kind", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("score", pa.float64()), ("tokens", pa.float64()), ("confidence", pa.float64())]


def best_windows(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, start, size, score, tokens, confidence) of pairs(keys, source, target) of texts that allow a search: ``size`` words
    from word ``start`` on, both null for an exact place."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, target = (batch.column(batch.schema.get_field_index(c)) for c in ("source", "target"))
            found = [best_window(s.as_py(), t.as_py()) for s, t in zip(source, target, strict=True)]
            some = pa.array([f is not None for f in found], pa.bool_())
            columns = [batch.column(i).filter(some) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([f[n] for f in found if f], t) for n, t in _RESULT)], [*keys, *(n for n, _ in _RESULT)])

    schema = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys)
    return pairs.select(*keys, "source", "target").mapInArrow(search, f"{schema}, kind string, start long, size long, score double, tokens double, confidence double")


def best_segments(pairs: DataFrame, segments: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, target_id, page, score, forward, reverse): of every pair(doc_id, target_id) the segment(doc_id, page, text) of the
    document that has most in common with the target(id, text) in either direction, the first of equals."""
    page = segments.withColumn("id", F.struct("doc_id", "page"))
    both = pairs.join(page.select("doc_id", "id"), "doc_id").select(F.col("id").alias("source_id"), "target_id")
    forward = directional_coverage(both, page.select("id", "text"), targets)
    reverse = directional_coverage(both.toDF("target_id", "source_id").select("source_id", "target_id"), targets, page.select("id", "text"))
    rows = forward.withColumnRenamed("score", "forward").join(reverse.select(F.col("source_id").alias("target_id"), F.col("target_id").alias("source_id"), F.col("score").alias("reverse")), ["source_id", "target_id"])
    rows = rows.select(F.col("source_id.doc_id").alias("doc_id"), "target_id", F.col("source_id.page").alias("page"), F.greatest("forward", "reverse").alias("score"), "forward", "reverse")
    best = F.min(F.struct((-F.col("score")).alias("order"), "page", "score", "forward", "reverse")).alias("b")
    return rows.groupBy("doc_id", "target_id").agg(best).select("doc_id", "target_id", "b.page", "b.score", "b.forward", "b.reverse")
