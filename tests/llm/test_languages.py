import numpy as np

from veriframe.llm import langid


def many(n):
    """n languages of 12 documents, each language with syllables of its own."""
    rng = np.random.default_rng(6)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    out = []
    for k in range(n):
        parts = ["".join(rng.choice(letters, 5)) for _ in range(30)]
        out += [(12 * k + i, " ".join(rng.choice(parts, 40)), f"l{k:03}") for i in range(12)]
    return out


def test_more_languages_than_a_word_has_bits(spark):
    rows = many(130)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(langid.training_rows(docs))
    assert len(model.languages) == 130 and len(model.table) == 3
    found = {r.doc_id: r.p for r in langid.identify(docs, model, "p", "s").collect()}
    assert found == {i: k for i, _, k in rows}


def test_no_gram_of_a_language_is_cut():
    grams = np.random.default_rng(3).choice(2**32, 300_000, replace=False)
    model = langid.build_filter({"a": grams, "b": grams[:10]}, {"a": 2, "b": 1})
    assert (model.masks(grams.astype(np.uint32)) & np.uint64(1)).all() and (model.false_positive <= langid.MAX_FILL**langid.HASHES).all()


def test_the_pipeline_drops_texts_that_show_no_language(spark):
    import corpus_pipeline

    rows = many(3) + [(900, "日本語", None), (901, None, "l000"), (902, "12 34", "l001")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = dict(corpus_pipeline.STAGES)["language ID"](spark, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(36))


def test_counts_do_not_depend_on_what_a_task_holds(spark, monkeypatch):
    docs = spark.createDataFrame(many(5), "doc_id long, text string, lang string")
    want = {tuple(r) for r in langid.gram_document_counts(docs).collect()}
    monkeypatch.setattr(langid, "HELD_GRAMS", 100)
    assert {tuple(r) for r in langid.gram_document_counts(docs).collect()} == want


def brute_languages(rows):
    """The decision with sets in place of the filter: a language's n-grams, and the share of a text's that it has."""
    from collections import Counter

    learned = [(t, k) for i, t, k in rows if t is not None and k is not None and not in_fold(i)]
    docs, counts = Counter(k for _, k in learned), Counter()
    for t, k in learned:
        counts.update((k, g) for g in set(langid.byte_grams(t).tolist()))
    share = {(k, g): n / docs[k] for (k, g), n in counts.items() if n / docs[k] >= langid.MIN_DOCUMENT_SHARE}
    most = {}
    for (_, g), s in share.items():
        most[g] = max(most.get(g, 0), s)
    own = {k: {g for (lang, g), s in share.items() if lang == k and most[g] <= langid.MAX_RIVAL * s} for k in docs}
    return {i: max(sorted(own), key=lambda k: sum(g in own[k] for g in langid.byte_grams(t).tolist())) for i, t, _ in rows}


def in_fold(doc_id):
    import zlib

    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_the_query_agrees_with_sets_of_n_grams(spark, tmp_path):
    rng = np.random.default_rng(11)
    parts = {"aa": ["tion", "the", "ing", "er"], "bb": ["schn", "ung", "keit", "the"], "cc": ["ci", "ando", "ing", "la"]}
    rows = [(i, " ".join("".join(rng.choice(parts[k], 2)) for _ in range(30)), k) for i, k in ((j, "abc"[j % 3] * 2) for j in range(90))]
    spark.createDataFrame([*rows, (900, None, "aa"), (901, "1 2", "bb"), (None, "the the", None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in langid.op7_language_id(spark, str(tmp_path)).collect()}
    assert {i: got[i].lang_pred for i, _, _ in rows} == brute_languages(rows)
    assert all(got[i].held_out == in_fold(i) and 0 <= got[i].score <= 1 for i, _, _ in rows)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[None].held_out is False
