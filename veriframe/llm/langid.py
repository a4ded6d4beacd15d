"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter holds the characteristic byte n-grams of all languages: each of its
positions stores one bit per language (a word for every 64), so the AND of an n-gram's k positions is the
mask of all languages that contain it. Per-language popcounts over a document, corrected for each language's
false-positive rate, decide.

Edge cases: a null text or one without a letter is ``und`` with score 0; null languages are never
learned from; with no learned language every text is ``und``; a text in which no n-gram is known gets
the language with most training documents, score 0; other columns pass through unread.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, id_crc_mod, materialize, table

UNDETERMINED = "und"
#: A word of a mask has one bit for each of so many languages.
WORD_LANGUAGES = 64
#: Bytes in an n-gram (with one space on either side of each word).
GRAM = 4
#: The filter gets as many positions as keep the share that one language fills below this.
MAX_FILL = 0.25
#: A text shows its language if the n-grams met exceed the false ones expected by so many standard deviations.
MARGIN = 3.0
#: An n-gram belongs to a language if this share of its documents have it ...
MIN_DOCUMENT_SHARE = 0.002
#: ... and no other language has it in more than this multiple of that share.
MAX_RIVAL = 2.0
SLOT_BITS = 18
#: N-grams that a task adds up before it gives out their counts.
HELD_GRAMS = 2_000_000
HASHES = 3
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], dtype=np.uint32)

_KEEP = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def byte_grams(text: str) -> np.ndarray:
    """All n-grams of the whole lower-cased text as little-endian 32-bit numbers."""
    words = text.lower().encode("utf-8", "replace").translate(_KEEP).split()
    b = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    if len(b) < GRAM:
        return np.zeros(0, np.uint32)
    g = b[: len(b) - 3].astype(np.uint32)
    for i in (1, 2, 3):
        g |= b[i : len(b) - 3 + i].astype(np.uint32) << np.uint32(8 * i)
    return g


def slots(grams: np.ndarray, i: int, bits: int = SLOT_BITS) -> np.ndarray:
    mixed = (grams ^ (grams >> np.uint32(15 + i))) * _MULTIPLIERS[i]
    return (mixed ^ (mixed >> np.uint32(13))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - bits)


@dataclass(frozen=True)
class LanguageFilter:
    languages: tuple[str, ...]
    table: np.ndarray  # uint64[words, 2 ** bits], bit l of every word w: language 64 w + l
    false_positive: np.ndarray
    fallback: int
    bits: int = SLOT_BITS

    def masks(self, grams: np.ndarray, word: int = 0) -> np.ndarray:
        """For each n-gram the set of all languages that contain it, of those of one word."""
        out = self.table[word][slots(grams, 0, self.bits)]
        for i in range(1, HASHES):
            out &= self.table[word][slots(grams, i, self.bits)]
        return out

    def hits(self, grams: np.ndarray) -> np.ndarray:
        out = []
        for word in range(len(self.table)):
            kinds, counts = np.unique(self.masks(grams, word), return_counts=True)
            shifts = np.arange(min(WORD_LANGUAGES, len(self.languages) - word * WORD_LANGUAGES), dtype=np.uint64)
            out.append((((kinds[:, None] >> shifts) & np.uint64(1)) * counts[:, None].astype(np.uint64)).sum(0).astype(float))
        return np.concatenate(out)

    def decide(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, and whether the text shows it: its n-grams are more than false positives."""
        if not self.languages or text is None or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, False
        grams = byte_grams(text)
        hits = self.hits(grams)
        false = len(grams) * self.false_positive
        real = np.maximum(0.0, (hits - false) / (1 - self.false_positive))
        if real.sum() <= 0:
            return self.languages[self.fallback], 0.0, False
        best = int(real.argmax())
        shown = hits[best] - false[best] > MARGIN * np.sqrt(false[best] * (1 - self.false_positive[best]))
        return self.languages[best], float(real[best] / real.sum()), bool(shown)

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.decide(text)[:2]


def build_filter(entries: dict[str, np.ndarray], documents: dict[str, int], bits: int | None = None) -> LanguageFilter:
    """``bits`` are by default as many as the largest language needs, SLOT_BITS at least."""
    languages = tuple(sorted(entries))
    if bits is None:
        most = max((len(x) for x in entries.values()), default=0)
        bits = max(SLOT_BITS, int(np.ceil(np.log2(max(1, HASHES * most / MAX_FILL)))))
    words = np.zeros((-(-len(languages) // WORD_LANGUAGES), 1 << bits), np.uint64)
    fill = []
    for i, language in enumerate(languages):
        word, bit = words[i // WORD_LANGUAGES], np.uint64(1 << i % WORD_LANGUAGES)
        for k in range(HASHES):
            word[slots(entries[language].astype(np.uint32), k, bits)] |= bit
        fill.append(float(((word & bit) > 0).mean()))
    order = [documents.get(x, 0) for x in languages]
    return LanguageFilter(languages, words, np.minimum(np.array(fill) ** HASHES, 0.99), int(np.argmax(order)) if order else 0, bits)


def gram_document_counts(training: DataFrame) -> DataFrame:
    """(lang, gram, n): in how many documents of a language an n-gram occurs; gram -1 counts documents.
    Every task adds its documents up before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = defaultdict(list)
        size = 0

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                for i in range(0, len(g), 50_000):
                    s = slice(i, i + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g[s])), pa.array(g[s]), pa.array(n[s])], ["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held[lang].append(np.append(np.unique(byte_grams(text.as_py())).astype(np.int64), -1))
                size += len(held[lang][-1])
                if size > HELD_GRAMS:  # what is held is given out, whatever there is of languages and n-grams
                    yield from counted()
                    held.clear()
                    size = 0
        yield from counted()

    rows = training.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    return rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(training: DataFrame) -> LanguageFilter:
    """Counts cover all rows of ``training``, and all its languages are learned. The driver gets of each language at
    most 1 / MIN_DOCUMENT_SHARE times the n-grams of a mean document."""
    counts = materialize(gram_document_counts(training), "langid-counts")
    sizes = counts.where("gram = -1").select("lang", F.col("n").alias("docs"))
    documents = {r["lang"]: r["docs"] for r in sizes.collect()}
    shares = counts.where("gram >= 0").join(F.broadcast(sizes), "lang").withColumn("share", F.col("n") / F.col("docs"))
    shares = shares.where(F.col("share") >= MIN_DOCUMENT_SHARE)
    most = shares.groupBy("gram").agg(F.max("share").alias("most"))
    kept = shares.join(most, "gram").where(F.col("most") <= MAX_RIVAL * F.col("share"))
    got = kept.select("lang", "gram").toPandas()
    return build_filter({k: got.loc[got["lang"] == k, "gram"].to_numpy() for k in documents}, documents)


def identify(documents: DataFrame, model: LanguageFilter, lang_column: str = "lang_pred", score_column: str = "lang_score") -> DataFrame:
    """``documents`` with the predicted language and its share of the corrected n-gram counts; no shuffle."""
    both = fresh(documents, "identified")

    @F.pandas_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predicted(texts):
        import pandas as pd

        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang", "score"])

    out = documents.withColumn(both, predicted(F.col("text")))
    return out.withColumns({lang_column: F.col(f"{both}.lang"), score_column: F.col(f"{both}.score")}).drop(both)


def keep_identified(documents: DataFrame, model: LanguageFilter, shown: bool = False) -> DataFrame:
    """The documents with a language, with their own columns only; with ``shown`` those alone that show it."""
    if shown:

        @F.pandas_udf(T.BooleanType())
        def shows(texts):
            import pandas as pd

            return pd.Series([model.decide(t)[2] for t in texts], dtype=bool)

        return documents.where(shows("text"))
    lang, score = fresh(documents, "identified_lang"), fresh(documents, "identified_score")
    return identify(documents, model, lang, score).where(F.col(lang) != UNDETERMINED).select(*documents.columns)


def training_rows(documents: DataFrame) -> DataFrame:
    return documents.where(id_crc_mod("doc_id", 4) != 2)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = learn(training_rows(documents))
    return identify(documents.select("doc_id", "text"), model, "lang_pred", "score").select(
        "doc_id", F.coalesce(id_crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
