"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into words where no piece of the model can cross (checked against the model). The distinct
words of all texts are exploded into their substrings of bounded length, equi-joined to the piece table and
grouped by word again: that is a word's lattice. A higher-order ``aggregate`` folds it into the set of
boundaries that remain, one bit each:

* unigram models: Viterbi, the best sum of scores over the positions from left to right;
* BPE models: scores are merge ranks, not log-probabilities, and the path with their best sum is not what
  such a model's encoder gives, so that the fold applies the lattice's merges in order of rank, leftmost
  first, as long as one applies.

Words over ``LONG_WORD`` characters have no room in 64 bits; an agenda of merges (or the Viterbi table in
numpy) in an Arrow function encodes them. Texts are dealt in the order they are read to parts of about
``PART_CHARACTERS``; a part gets the cuts of its own words back, not those of the corpus, so that a group holds a
part's texts and words, however large a partition of the input is. A text longer than that is a part of its own.

Edge cases: a null or empty text has no pieces; characters without a piece become byte pieces; repeated
rows (and null ids) are encoded each for itself; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriframe.functions.text import let

from .common import table, unpacker

SPACE = "▁"
LONG_WORD = 60
#: Characters of text that are joined with the cuts of their words in one group.
PART_CHARACTERS = 32_000_000
#: Stands for a line end in a cut; no piece of a text is written so.
LINE_END = "<0x0A>"
#: Chunks whose ids a task keeps at hand.
REMEMBERED = 500_000
UNKNOWN_PENALTY = 10.0  # below the worst score: the score of a character without a piece in a unigram model

_MARKS = r"\W\d_²³¹¼½¾"  # what isn't taken for a letter
_BY_LETTERS = rf"{SPACE}*(?:[^{_MARKS}]+|(?:[^\w{SPACE}\n]|[{_MARKS[2:]}])+)|{SPACE}+|\n"
_BY_SPACES = rf"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n"
_WHOLE = r"(?s).+"


class _Parts:
    """Numbers of the parts that the texts of a partition are dealt to, in the order they are read."""

    def __init__(self):
        from pyspark import TaskContext

        self.number, self.size = TaskContext.get().partitionId() << 20, 0

    def of(self, text: str | None) -> int:
        if self.size > PART_CHARACTERS:
            self.number, self.size = self.number + 1, 0
        self.size += len(text or "")
        return self.number


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _PieceIds(dict):
    """Piece -> its id, or the ids of the bytes of a character without one, as little-endian unsigned 32-bit numbers."""

    def __init__(self, ids: dict[str, int], byte_ids: np.ndarray):
        super().__init__((p, np.array([i], "<u4").tobytes()) for p, i in ids.items())
        self.byte_ids = byte_ids
        self[LINE_END] = self["\n"]

    def __missing__(self, piece: str) -> bytes:
        self[piece] = got = self.byte_ids[list(piece.encode("utf-8", "surrogatepass"))].astype("<u4").tobytes()
        return got


class _Cuts(dict):
    """Word -> its cut; words that the lattice left out (one character, no edge, too long) are cut when met."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> str:
        self[word] = got = self.model.cut_alone(word)
        return got


class PieceModel:
    """Pieces, scores and bytes of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = len(model)
        skip = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
        self.ids = {model.id_to_piece(i): i for i in range(n) if not skip[i]}
        self.scores = {p: model.get_score(i) for p, i in self.ids.items()}
        self.bytes = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.uint32)
        self.unknown_score = min(self.scores.values()) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.ids))
        self.text = [model.id_to_piece(i).replace(SPACE, " ").encode() if not skip[i] else b"" for i in range(n)]
        for b, i in enumerate(self.bytes.tolist()):
            self.text[i] = bytes([b])
        self._bytes = np.frombuffer(b"".join(self.text), np.uint8)
        self._length = np.array([len(t) for t in self.text])
        self._offset = np.cumsum(self._length) - self._length
        self.unigram = _model_type(path) == 1
        self.cut = re.compile(self._cut_rule())
        self.piece_ids = _PieceIds(self.ids, self.bytes)

    def _cut_rule(self) -> str:
        """The finest of three cuts that no piece crosses."""
        for rule in (_BY_LETTERS, _BY_SPACES):
            if all(len(re.findall(rule, p)) == 1 for p in self.ids):
                return rule
        return _WHOLE

    def chunks(self, text: str | None) -> list[str]:
        """A text in parts between its single spaces; where spaces stand together or first, one part that begins
        with the mark for a space."""
        if not text:
            return []
        if self.cut.pattern == _WHOLE or "  " in text or text[0] == " " or SPACE in text:
            return [SPACE + text.replace(" ", SPACE)]
        return text.split(" ")

    def words(self, chunk: str) -> list[str]:
        """The words of a chunk, cut where no piece crosses; letters alone are one word under every rule."""
        if chunk.isalpha():
            return [SPACE + chunk]
        return self.cut.findall(chunk if chunk[:1] == SPACE else SPACE + chunk)

    def from_cut(self, pieces: str) -> bytes:
        """Ids of text given as its pieces with line ends between them."""
        return b"".join(map(self.piece_ids.__getitem__, pieces.split("\n")))

    def cut_alone(self, word: str) -> str:
        """The cut of one word without the lattice tables; for words of any length."""
        if word == "\n":
            return LINE_END
        return "\n".join(self._viterbi(word) if self.unigram else self._merged(word)) if len(word) > 1 else word

    def _merged(self, word: str) -> list[str]:
        parts: list[str | None] = list(word)
        nxt, prv = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        agenda: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            both = parts[a] + parts[b]
            if both in self.scores:
                heapq.heappush(agenda, (-self.scores[both], a, b, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while agenda:
            _, a, b, both = heapq.heappop(agenda)
            if parts[a] is None or parts[b] is None or nxt[a] != b or parts[a] + parts[b] != both:
                continue
            parts[a], parts[b], nxt[a] = both, None, nxt[b]
            if nxt[b] < len(parts):
                prv[nxt[b]] = a
                offer(a, nxt[a])
            if prv[a] >= 0:
                offer(prv[a], a)
        return [p for p in parts if p is not None]

    def _viterbi(self, word: str) -> list[str]:
        best, back = [0.0], [0]
        for j in range(1, len(word) + 1):
            steps = [(best[i] + self.scores[word[i:j]], i) for i in range(max(0, j - self.longest), j) if word[i:j] in self.scores]
            if word[j - 1] not in self.scores:
                steps.append((best[j - 1] + self.unknown_score, j - 1))
            top = max(steps, key=lambda x: (x[0], -x[1]))
            best.append(top[0]), back.append(top[1])
        out, j = [], len(word)
        while j:
            out.append(word[back[j] : j])
            j = back[j]
        return out[::-1]

    def decoded(self, ids: np.ndarray) -> bytes:
        """Bytes of the pieces one after the other, the space before the first word included."""
        length = self._length[ids]
        ends = np.cumsum(length)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self._offset[ids] - (ends - length), length)
        return self._bytes[at].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decoded(ids).removeprefix(b" ").decode("utf-8", "replace")


def _model_type(path: str) -> int:
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    return proto.trainer_spec.model_type


@cache
def piece_model(path: str) -> PieceModel:
    """Read once per Python worker."""
    return PieceModel(path)


def piece_table(spark: SparkSession, model: PieceModel) -> DataFrame:
    """(piece, rank, score), best score first; as many rows as the model has pieces, tens of thousands for any
    vocabulary file."""
    ranked = sorted(model.scores.items(), key=lambda x: -x[1])
    return spark.createDataFrame([(p, i, s) for i, (p, s) in enumerate(ranked)], "piece string, rank long, score double")


def lattice(words: DataFrame, pieces: DataFrame, longest: int, shortest: int = 1) -> DataFrame:
    """(word, start, stop, rank, score) for all substrings of ``words`` that are pieces. Keeps the partitioning
    of ``words`` by word."""
    n = F.length("word")
    starts = (words if shortest < 3 else words.where(n >= shortest)).select("word", F.explode(F.sequence(F.lit(0), n - shortest)).alias("start"))
    cuts = starts.select("word", "start", F.explode(F.sequence(F.col("start") + shortest, F.least(F.col("start") + longest, n))).alias("stop"))
    cuts = cuts.withColumn("part", F.substr("word", F.col("start") + 1, F.col("stop") - F.col("start")))
    table = F.broadcast(pieces.withColumn("key", F.xxhash64("piece")))  # the model's pieces: a fixed number of short rows
    same = F.startswith(F.col("part"), F.col("piece")) & F.startswith(F.col("piece"), F.col("part"))  # not as an equality, so that the key stays one number
    return cuts.join(table, (F.xxhash64("part") == F.col("key")) & same).drop("part", "piece", "key")


def _bit(n: Column | int) -> Column:
    return F.expr("1L") if isinstance(n, int) else F.call_function("shiftleft", F.lit(1).cast("long"), n)


def merge_bounds(codes: Column, word: Column) -> Column:
    """Bits of the boundaries left when merges are applied in order of rank, leftmost first. ``codes`` are the
    sorted rank << 12 | start << 6 | stop of the edges."""
    start, stop = (lambda e: F.shiftright(e, 6).bitwiseAND(F.lit(63)).cast("int")), (lambda e: e.bitwiseAND(F.lit(63)).cast("int"))
    slim = F.transform(codes, lambda e: F.struct((_bit(start(e)) + _bit(stop(e))).alias("ends"), (_bit(stop(e)) - _bit(start(e) + 1)).alias("inner")))
    applies = lambda m, e: (m.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(m.bitwiseAND(e["inner"])) == 1)
    first = lambda m, es: F.get(F.filter(es, lambda e: applies(m, e)), F.lit(0))["inner"]
    state = F.struct((_bit(F.length(word) + 1) - F.lit(1).cast("long")).alias("m"), slim.alias("es"))
    folded = F.aggregate(
        F.sequence(F.lit(1), F.least(F.length(word) - 1, F.size(codes))),
        state,
        lambda s, _: F.struct(s["m"].bitwiseAND(F.bitwise_not(F.coalesce(first(s["m"], s["es"]), F.lit(0).cast("long")))).alias("m"), s["es"].alias("es")),
    )
    return folded["m"]


def viterbi_bounds(edges: Column, word: Column, unknown_score: float) -> Column:
    """Bits of the boundaries on the path with the best sum of scores, ties to the longer last piece."""
    long = lambda c: c.cast("long")
    start = F.array(F.struct(F.lit(0.0).alias("score"), long(F.lit(1)).alias("bounds")))

    def step(paths: Column, j: Column) -> Column:
        into = F.filter(edges, lambda e: e["stop"] == j)
        known = F.exists(into, lambda e: e["start"] == j - 1)
        unknown = F.when(~known, F.array(F.struct((F.get(paths, j - 1)["score"] + unknown_score).alias("score"), (-(j - 1)).alias("back"))))
        steps = F.concat(
            F.transform(into, lambda e: F.struct((F.get(paths, e["start"])["score"] + e["score"]).alias("score"), (-e["start"]).alias("back"))),
            F.coalesce(unknown, F.array().cast("array<struct<score:double,back:int>>")),
        )
        top = F.array_max(steps)
        return F.concat(paths, F.array(F.struct(top["score"].alias("score"), (F.get(paths, -top["back"])["bounds"] + _bit(j)).alias("bounds"))))

    return F.element_at(F.aggregate(F.sequence(F.lit(1), F.length(word)), start, step), -1)["bounds"]


def cut_words(words: DataFrame, model: PieceModel) -> DataFrame:
    """(word, cut) of distinct words of at most LONG_WORD characters that have an edge: cut has a line end
    between the word's pieces."""
    pieces = piece_table(words.sparkSession, model)
    if model.unigram:
        edge = F.struct("stop", "start", "score")
        found = lattice(words, pieces, model.longest).groupBy("word").agg(F.collect_list(edge).alias("edges"))
        bounds = viterbi_bounds(F.col("edges"), F.col("word"), model.unknown_score)
    else:
        code = F.shiftleft("rank", 12) + F.col("start") * 64 + F.col("stop")
        merges = lattice(words, pieces.where(F.length("piece") > 1).drop("score"), model.longest, 2)
        found = merges.groupBy("word").agg(F.sort_array(F.collect_list(code)).alias("codes"))
        bounds = merge_bounds(F.col("codes"), F.col("word"))
    return found.select("word", let(bounds, lambda b: _cut(F.col("word"), b)).alias("cut"))


def _cut(word: Column, bounds: Column) -> Column:
    at = F.filter(F.sequence(F.lit(0), F.length(word)), lambda i: F.getbit(bounds, i) == 1)
    step = lambda s, i: F.struct(F.concat(s["text"], F.when(s["at"] > 0, "\n").otherwise(""), F.substr(word, s["at"] + 1, i - s["at"])).alias("text"), i.alias("at"))
    return F.aggregate(F.slice(at, 2, LONG_WORD), F.struct(F.lit("").alias("text"), F.lit(0).alias("at")), step)["text"]


def encode(documents: DataFrame, model_path: str | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded_crc32[, ids]) per row of ``documents``: crc32 of the ids as
    little-endian unsigned 32-bit numbers and of the UTF-8 bytes of the text decoded from them."""
    path = model_path or default_model()
    model = piece_model(path)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts, chunks, now = piece_model(path), _Parts(), set(), None

        def done() -> Iterator[pa.RecordBatch]:
            words = list({w for c in chunks for w in own.words(c) if 1 < len(w) <= LONG_WORD})
            for i in range(0, len(words), 100_000):
                some = words[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([now] * len(some), pa.int64())], ["word", "part"])

        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                part = parts.of(text)
                if part != now:
                    yield from done()
                    chunks, now = set(), part
                chunks.update(own.chunks(text))
        yield from done()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        parts, packer = _Parts(), zstandard.ZstdCompressor(1)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            small = [None if t is None else packer.compress(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(small, pa.binary()), pa.array(list(map(parts.of, texts)), pa.int64())], ["doc_id", "packed", "part"])

    wanted = documents.select("text").mapInArrow(cut, "word string, part long").where("word is not null and length(word) > 1").repartition("word")
    # reading ``part`` here too lets Spark use the one shuffle of ``wanted`` for both sides of the join
    distinct = wanted.groupBy("word").agg(F.min("part").alias("first")).where("first is not null").select("word")
    own_words = wanted.join(cut_words(distinct, model), "word").select("part", "cut")
    schema = T.StructType([documents.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("n_pieces", "ids_crc32", "decoded_crc32"))])
    if with_ids:
        schema.add("ids", T.ArrayType(T.IntegerType()))

    def join(texts: pa.Table, words: pa.Table) -> pa.Table:
        own, unpack = piece_model(path), unpacker()
        known = _Cuts(own)
        known.update((c.replace("\n", ""), c) for c in words.column("cut").to_pylist())

        class Ids(dict):
            def __missing__(self, chunk: str) -> bytes:
                if len(self) >= REMEMBERED:
                    self.clear()  # what is met again is made again
                self[chunk] = got = own.from_cut("\n".join(map(known.__getitem__, own.words(chunk))))
                return got

        ids_of = Ids()
        columns: list[list] = [[], [], [], []]
        for text in texts.column("packed"):
            chunks = own.chunks(unpack(text.as_py()).decode("utf-8", "surrogatepass"))
            raw = b"".join(map(ids_of.__getitem__, chunks))
            decoded = own.decoded(np.frombuffer(raw, "<u4")).removeprefix(b" ")
            for column, value in zip(columns, (len(raw) // 4, zlib.crc32(raw), zlib.crc32(decoded)), strict=False):
                column.append(value)
            if with_ids:
                columns[3].append(np.frombuffer(raw, "<u4").astype(np.int32))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        rest = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)][: len(schema) - 1]
        return pa.Table.from_arrays([texts.column("doc_id"), *rest], schema.names)

    packed_schema = T.StructType([documents.schema["doc_id"], T.StructField("packed", T.BinaryType()), T.StructField("part", T.LongType())])
    texts = documents.select("doc_id", "text").mapInArrow(pack, packed_schema)
    return texts.groupBy("part").cogroup(own_words.groupBy("part")).applyInArrow(join, schema)


def decode(encoded: DataFrame, ids_column: str = "ids", into: str = "text", model_path: str | None = None) -> DataFrame:
    """``encoded`` with the text of its ids; null ids give a null text."""
    path = model_path or default_model()

    @F.pandas_udf(T.StringType())
    def text(ids):
        import pandas as pd

        own = piece_model(path)
        return pd.Series([None if x is None else own.decode(np.asarray(x)) for x in ids])

    return encoded.withColumn(into, text(F.col(ids_column)))


def op10_piece_encoding(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), with_ids=False)
