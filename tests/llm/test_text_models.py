import math
import zlib
from collections import Counter

import numpy as np
import pytest

from veriframe.llm import langid, licenses, packing, pieces, quality, tokens
from veriframe.llm.license_rules import rules

from . import data

NAMES = {"score": "taken", "rank": "taken"}


def labels(spark, rows):
    return spark.createDataFrame([(d, q, 0, "x") for d, q in rows], "doc_id long, quality int, toxic int, text string")


def held_out(doc_id, mod, rest):
    return zlib.crc32(str(doc_id).encode()) % mod == rest


# ---- quality classifier


def test_quality_edges_have_scores_and_columns_stay(spark):
    docs = data.documents(spark)
    model = quality.fit(docs, labels(spark, [(0, 1), (1, 1), (12, 0), (13, 0), (None, 1), (3, None), (4, 1), (4, 0)]))
    rows = quality.score_documents(docs, model, "fresh").collect()
    assert len(rows) == docs.count() and all(0 <= r.fresh <= 1 for r in rows) and {r.score for r in rows} == {0.5}
    empties = {r.fresh for r in rows if not (r.text or "").split()}
    assert len(empties) == 1
    assert quality.accept(docs, model).columns == docs.columns
    assert quality.score_documents(data.empty(spark), model, "fresh").collect() == []


def test_quality_without_labels_scores_half_way(spark):
    docs = data.documents(spark)
    for found in ([], [(0, 1)]):
        model = quality.fit(docs, labels(spark, found))
        assert {round(r.s, 9) for r in quality.score_documents(docs, model, "s").collect()} == {0.5}


def test_quality_never_learns_from_held_out_rows(spark):
    rows = [(i, 1) for i in range(100)]
    kept = {r.doc_id for r in quality.training_sample(labels(spark, rows)).collect()}
    assert kept == {i for i in range(100) if not held_out(i, 5, 0)}
    assert quality.training_sample(labels(spark, rows), 7).count() == 7


def test_pairwise_fit_orders_and_thresholds():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] - 2 * x[:, 2] + rng.normal(0, 0.1, 600) > -1).astype(int)
    model = quality.fit_bradley_terry(x, y, pairs=20_000)
    strength, score = model.strength(x), model.score(x)
    assert (np.argsort(strength) == np.argsort(score)).mean() > 0.99
    assert ((score >= quality.ACCEPT_SCORE) == (y == 1)).mean() > 0.95
    assert abs((score < quality.ACCEPT_SCORE).mean() - (y == 0).mean()) < 0.01


def brute_ranking(features, labels, weights, ridge=1e-3):
    """Loss over all pairs of a label-1 and a label-0 row, not over drawn ones, and its slope."""
    z = (features - features.mean(0)) / np.where(features.std(0) < 1e-9, 1, features.std(0))
    d = (z[labels == 1][:, None] - z[labels == 0][None]).reshape(-1, features.shape[1])
    m = d @ weights
    return np.mean(np.log1p(np.exp(-m))) + ridge / 2 * weights @ weights, ridge * weights - d.T @ (1 / (1 + np.exp(m))) / len(d)


def test_drawn_pairs_find_the_optimum_of_all_pairs():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 3))
    y = (x[:, 0] + rng.normal(0, 1, 120) > 0).astype(int)
    w = quality.fit_bradley_terry(x, y, pairs=400_000).weights
    loss, slope = brute_ranking(x, y, w)
    assert np.abs(slope).max() < 0.02 and all(loss <= brute_ranking(x, y, w + d)[0] + 1e-4 for d in rng.normal(0, 0.3, (20, 3)))


def test_quality_query_has_its_contract(spark, tmp_path):
    rng = np.random.default_rng(5)
    good = lambda: " ".join("word%d" % rng.integers(3000) for _ in range(120)) + "."
    bad = lambda: " ".join(rng.choice(["$$$ BUY!!!", "click #1", "@@ ~~"], 40))
    rows = [(i, good() if i % 2 else bad()) for i in range(200)] + [(7, good()), (500, None), (501, ""), (None, good())]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, [(i, i % 2) for i in range(200)]).write.parquet(f"{tmp_path}/labels.parquet")
    got = quality.op5_quality_classifier(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and held_out(r.doc_id, 5, 0)) for r in got)
    assert np.mean([r.predicted == r.doc_id % 2 for r in got if r.held_out and r.doc_id < 200]) > 0.95
    assert len({r.score for r in got if r.doc_id in (500, 501)}) == 1


# ---- language identification


def languages(n=60):
    rng = np.random.default_rng(2)
    parts = {"aa": ["tion", "the", "ing", "er"], "bb": ["schn", "ung", "keit", "über"], "cc": ["ción", "ando", "os", "la"]}
    return [(i, " ".join("".join(rng.choice(parts[k], 2)) for _ in range(40)), k) for i, k in ((j, "abc"[j % 3] * 2) for j in range(n))]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, k, "s", 1, 0.0) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long, lang_score double")


def test_language_held_out_accuracy_and_edges(spark):
    rows = languages()
    odd = [(900, None, "aa"), (901, "", "bb"), (902, "12 34 --", "cc"), (903, "ing" * 30_000, None), (None, "the the the ing", None), (904, "日本語", None)]
    docs = frame(spark, rows + odd)
    model = langid.learn(langid.training_rows(docs))
    assert model.languages == ("aa", "bb", "cc")
    out = {r.doc_id: (r.lang_pred, r.s) for r in langid.identify(docs, model, "lang_pred", "s").collect()}
    assert np.mean([out[i][0] == k for i, _, k in rows if held_out(i, 4, 2)]) == 1
    assert [out[i] for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert out[903][0] == "aa" and out[None][0] == "aa" and out[904] == (model.languages[model.fallback], 0.0)
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(out) - {900, 901, 902}
    assert langid.identify(frame(spark, []), model, "p", "s").collect() == []


def test_language_without_training_is_undetermined(spark):
    for rows in ([], [(1, "some words", None)]):
        model = langid.learn(frame(spark, rows))
        docs = frame(spark, [(5, "the tion", "aa")])
        assert langid.identify(docs, model, "p", "s").first().p == "und"


def test_filter_masks_hold_every_language_of_a_gram():
    grams = {k: np.unique(langid.byte_grams(w)) for k, w in {"a": "hello there", "b": "there world", "c": "zzz"}.items()}
    model = langid.build_filter(grams, {"a": 3, "b": 2, "c": 1})
    for i, k in enumerate(model.languages):
        assert ((model.masks(grams[k]) >> np.uint64(i)) & np.uint64(1)).all()
    random = np.random.default_rng(1).integers(0, 2**32, 20_000, dtype=np.uint32)
    rate = ((model.masks(random)[:, None] >> np.arange(3, dtype=np.uint64)) & np.uint64(1)).mean(0)
    assert (np.abs(rate - model.false_positive) < 0.002).all()


# ---- licence scans


def brute_base(text):
    import re

    lowered = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = [(i, label) for i in range(len(words)) for p, label in licenses.BASE_PHRASES.items() if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


LICENCE_TEXTS = [
    None, "", "MIT License", "the mit  license. MIT\nlicense\x0bmit license", "Apache License, Version 2.0 and GNU General Public License v3", "mit licenses", "submit license",
    "SPDX-License-Identifier: MIT", "ééapache license", "general public license general public license", "mit license " * 3000, "x" * 50_000 + " apache license", "İMIT LICENSE mit license",
]


def test_licence_base_places_match_brute_force(spark):
    docs = data.documents(spark, list(enumerate(LICENCE_TEXTS)) + data.edge_texts())
    out = licenses.scan_licenses(docs).collect()
    want = Counter((r.doc_id, *brute_base(r.text)) for r in out)
    got = Counter((r.doc_id, *(None if x is None or x != x else x for x in (r.licenses.n_words, r.licenses.n_base, r.licenses.first_word, r.licenses.last_word)), r.licenses.base_labels) for r in out)
    assert got == want
    for r in out:
        assert set(filter(None, r.licenses.base_labels.split(","))) <= set(r.licenses.labels.split(",")) and 0 <= r.licenses.score <= 1
    assert licenses.scan_licenses(data.empty(spark)).collect() == []


def test_licence_rules_suppress_contained_detections():
    assert len(rules()) > 200
    text = "licensed under the apache license, version 2.0 as usual"
    found = licenses.detections(text)
    assert [r.label for _, _, r in found] == ["apache-2.0"]
    spans = [(a, b) for a, b, _ in licenses.detections("see the mit license and the gnu lesser general public license version 2.1, copyright 2020")]
    assert not any(i != j and a <= c and d <= b for i, (a, b) in enumerate(spans) for j, (c, d) in enumerate(spans))
    for rule in rules():
        assert rule.keywords and all(k == k.lower() for k in rule.keywords)


def inner(pattern):
    """A pattern without what only looks around."""
    import re

    return re.sub(r"\(\?(?:<!|!|<=|=)(?:[^()\[\]]|\[[^\]]*\])*\)", "", pattern)


@pytest.mark.parametrize("rule", rules(), ids=lambda r: f"{r.kind}-{r.label}")
def test_every_match_of_a_licence_rule_holds_a_keyword(rule):
    import re

    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=25, deadline=None, database=None)
    @given(st.from_regex(re.compile(inner(rule.pattern), re.ASCII), fullmatch=True))
    def check(text):
        text = " ".join(text.lower().split())
        assert not re.fullmatch(rule.pattern, text) or any(k in text for k in rule.keywords), text

    check()


def brute_detections(text):
    import re

    found = [(r.priority, m.start(), m.end(), r.label) for r in rules() for m in re.finditer(r.pattern, text) if m.end() > m.start()]
    return sorted(x for x in found if not any(p < x[0] and a <= x[1] and x[2] <= b for p, a, b, _ in found))


WRAPPED = """Licensed under the Apache License, Version 2.0. Unless required by applicable law or agreed to in writing, software
distributed under the License ... permission to use, copy, modify, and distribute this software for any
purpose. Neither the name of the owner
nor the names of its contributors. See the PHP Licence, the artistic licence 2.0 and an Apache software licence; the
GNU Lesser General Public License, version 2.1, Copyright 2020, (c) 2021, MIT-licence, expat-license. Spdx-License-Identifier: MIT"""


def test_licence_labels_match_brute_force(spark):
    rng = np.random.default_rng(3)
    parts = WRAPPED.split() + ["mit", "license", "gnu", "general", "public", "bsd", "cc-by", "4.0", "\n", "creative", "commons"]
    rows = [(0, WRAPPED), (1, WRAPPED.upper() * 40)] + [(i, " ".join(rng.choice(parts, 200))) for i in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in licenses.scan_licenses(docs).collect():
        lowered = r.text.translate(licenses._ASCII_LOWER)
        want = brute_detections(" ".join(lowered.split()))
        assert [(s.label, " ".join(lowered[s.start : s.end].split())) for s in r.licenses.spans] == [(k, " ".join(lowered.split())[a:b]) for _, a, b, k in want]
        assert set(r.licenses.labels.split(",")) - {""} == {k for *_, k in want} | set(filter(None, brute_base(r.text)[4].split(",")))
    found = {s.label for s in licenses.scan_licenses(docs.where("doc_id = 0")).first().licenses.spans}
    assert {"apache-2.0", "isc", "bsd-3-clause", "php-3.01", "artistic-2.0", "lgpl-2.1", "apache", "mit", "copyright"} <= found


def test_a_million_phrases_in_one_text():
    import time

    began = time.process_time()
    row = licenses.scan("mit license " * 1_000_000)
    assert row[:4] == (2_000_000, 1_000_000, 0, 1_999_998) and len(row[7]) == 1_000_000
    assert time.process_time() - began < 20


# ---- tokens and packing


def test_byte_bpe_is_the_tokenizers_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = tokens.byte_bpe(tokens.default_vocabulary())
    for _, t in [*data.edge_texts(), (0, "a <|endoftext|> b"), (0, "  tabs\t\tand\n\n\nlines  "), (0, " " * 2_000_000), (0, "\n" * 2_000_000), (0, "a" + "\t " * 700_000 + "b")]:
        assert encode(t).tolist() == library.encode(t or "", add_special_tokens=False).ids


def check_packing(rows, got, full):
    encode = tokens.byte_bpe(tokens.default_vocabulary())
    want = []
    for doc, t in rows:
        ids = np.append(encode(t), np.uint32(packing.END_ID)).astype("<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids), full)):
            want.append((doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= full
    return len(by), math.ceil(sum(r.length for r in got) / full)


@pytest.mark.parametrize("full", [1024, 50])
def test_packing_places_every_piece_once(spark, full):
    rng = np.random.default_rng(3)
    rows = data.edge_texts() + [(100 + i, data.words(__import__("random").Random(i), int(n))) for i, n in enumerate(rng.integers(1, 300, 150))]
    got = packing.pack(data.documents(spark, rows), full).collect()
    used, least = check_packing(rows, got, full)
    assert used <= 1.06 * least + 1
    assert packing.pack(data.empty(spark), full).collect() == []


def test_packed_sequences_rebuild_the_texts(spark):
    rows = [(1, "a b c"), (2, None), (3, "long " * 900)]
    out = packing.packed_sequences(data.documents(spark, rows), 128).collect()
    assert all(len(r.ids) == sum(r.lengths) <= 128 for r in out)
    encode = tokens.byte_bpe(tokens.default_vocabulary())
    total = Counter(i for _, t in rows for i in [*encode(t).tolist(), packing.END_ID])
    assert Counter(i for r in out for i in r.ids) == total


def test_best_fit_and_patterns_keep_the_histogram():
    rng = np.random.default_rng(5)
    h = np.bincount(rng.integers(1, 65, 5000), minlength=65)
    plan = packing.make_plan(h)
    assert plan.sequences <= 1.01 * math.ceil((h * np.arange(65)).sum() / 64) + 1
    length = np.repeat(np.arange(65), h)
    rank = np.concatenate([np.arange(n) for n in h])
    sequence, offset = plan.place(length, rank)
    taken = Counter()
    for s, o, n in zip(sequence.tolist(), offset.tolist(), length.tolist(), strict=True):
        for x in range(o, o + n):
            taken[s, x] += 1
    assert max(taken.values()) == 1 and max(x for _, x in taken) < 64


# ---- pieces


@pytest.fixture(scope="module")
def unigram_model(tmp_path_factory):
    """The model's pieces and scores declared as a unigram model's."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(pieces.default_model(), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    rng = np.random.default_rng(0)
    for p in proto.pieces:
        if p.type == 1:
            p.score = float(-len(proto.pieces) ** 0.2 - rng.random() * 9)  # no ties
    path = tmp_path_factory.mktemp("m") / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    return str(path)


PIECE_TEXTS = [(50, "a  b   c"), (51, " lead"), (52, "trail "), (53, "x² 3/4 №5 é"), (54, "▁literal"), (55, "a,b.c;d-e_f|g"), (56, "q" * 400 + "thetheand" * 30), (57, "\n\n"), (58, "日本語のテキスト"), (59, "emoji 😀😀 \x00\x01")]


def test_pieces_are_those_of_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    rows = data.edge_texts() + PIECE_TEXTS
    out = pieces.encode(data.documents(spark, rows)).collect()
    want = Counter((d, tuple(library.encode(t or ""))) for d, t in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in out) == want
    for r in out:
        assert r.n_pieces == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    back = pieces.decode(pieces.encode(data.documents(spark, rows)), "ids", "back").collect()
    plain = Counter((d, (t or "").replace("▁", " ")) for d, t in rows)
    assert Counter((r.doc_id, r.back) for r in back) == plain
    crc = {(r.doc_id, r.decoded_crc32) for r in out}
    assert crc == {(d, zlib.crc32((t or "").replace("▁", " ").encode())) for d, t in rows}
    assert pieces.encode(data.empty(spark)).collect() == []


def test_pieces_do_not_depend_on_the_parts(spark, monkeypatch):
    docs = data.documents(spark, data.edge_texts() + PIECE_TEXTS).coalesce(1)
    want = Counter((r.doc_id, tuple(r.ids)) for r in pieces.encode(docs).collect())
    plain = pieces._Parts.of

    def small(self, text):
        pieces.PART_CHARACTERS = 300
        return plain(self, text)

    monkeypatch.setattr(pieces._Parts, "of", small)
    assert Counter((r.doc_id, tuple(r.ids)) for r in pieces.encode(docs).collect()) == want


def test_unigram_pieces_are_the_best_path_of_the_library(spark, unigram_model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=unigram_model)
    rows = [(i, t) for i, t in enumerate(["the quick  brown fox", "naïve ça\nüber", "日本 and", "z" * 100, None, ""])]
    for r in pieces.encode(data.documents(spark, rows), unigram_model).collect():
        text = dict(rows)[r.doc_id] or ""
        best = library.nbest_encode_as_ids(text, 1)[0] if text else []
        score = lambda ids: sum(library.get_score(i) for i in ids)
        assert list(r.ids) == list(best) or abs(score(r.ids) - score(best)) < 1e-3


def test_lattice_and_agenda_agree(spark):
    model = pieces.piece_model(pieces.default_model())
    words = ["▁thethe", "▁international", "aaaaaaaaaaaaaaaaaaaa", "▁çawoulé", "xqzjk", "▁▁▁▁▁"]
    found = {r.word: r.cut for r in pieces.cut_words(spark.createDataFrame([(w,) for w in words], "word string"), model).collect()}
    for w in words:
        assert found.get(w, w) == model.cut_alone(w) or w not in found
