from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veriframe.functions import exact, files, text, urls


def one(spark, column, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(column().alias("v")).first()["v"]




@pytest.mark.parametrize(("raw", "want"), [("a ﻿b", "a b"), (" x \ty　", "x y"), (None, ""), ("", "")])
def test_clean_text(spark, raw, want):
    assert one(spark, lambda: text.clean_text(F.col("c0")), raw) == want


def test_words_are_ascii_words(spark):
    assert one(spark, lambda: text.words(F.col("c0")), "naïve café x1 foo_bar") == ["na", "ve", "caf", "x1"]
    assert one(spark, lambda: text.token_set(F.col("c0")), "The the cat and THE cat sat") == ["cat", "sat"]


@pytest.mark.parametrize(
    ("a", "b", "want"), [("Same-Name", "same name", 1.0), ("abc", "", 0.0), ("lesson one", "lesson", 0.9), ("kitten", "sitting", 1 - 3 / 7), (None, None, 1.0)]
)
def test_fuzzy(spark, a, b, want):
    assert one(spark, lambda: text.fuzzy(F.col("c0"), F.col("c1")), a, b) == pytest.approx(want)


def test_path_similarity_keeps_unknown_apart(spark):
    score = lambda a, b: one(spark, lambda: text.path_similarity(text.path_form(F.col("c0")), text.path_form(F.col("c1"))), a, b)
    assert score("Root > A > B", "a > b") == 1.0
    assert score("Root", "a > b") is None and score(None, "a") is None
    assert 0 < score("unit 1 > quiz", "unit 1 > quizzes") < 1
    assert score("alpha", "omega") < 0.3


@pytest.mark.parametrize(
    ("name", "key"), [("My Pack (2) (3).zip", "mypack"), ("My-Pack.IMSCC", "mypack"), ("b0rl x.xml", "borlx"), ("course - dev (nce) - clxt", "course"), ("ab.zip", "ab.zip"), ("", "")]
)
def test_semantic_key(spark, name, key):
    assert one(spark, lambda: files.semantic_key(F.col("c0")), name) == key


def test_file_names(spark):
    assert one(spark, lambda: files.file_name(F.col("c0")), "http://x/a/b%20c+d.pdf?q=1#z") == "b c+d.pdf"
    assert one(spark, lambda: files.file_name(F.col("c0")), "a%zz/b%zz.doc") == "b%zz.doc"
    assert one(spark, lambda: files.display_file_name(F.col("c0")), "A  b (2).Zip") == "A b.Zip"
    assert one(spark, lambda: files.canonical_asset_name(F.col("c0")), "0123456789abcdef0123456789abcdef_My-20File_PW.pdf") == "My File Participant Workbook.pdf"
    assert one(spark, lambda: files.informative_tokens(F.col("c0")), "Final Rail_Plan v2 2020 rail.pdf") == ["rail", "plan"]
    assert one(spark, lambda: files.role(F.col("c0")), "x Instructor-Guide.pdf") == "instructor-guide"
    assert one(spark, lambda: files.normal_zip_path(F.col("c0")), "a/./b/../c//d") == "a/c/d"
    assert one(spark, lambda: files.normal_zip_path(F.col("c0")), "../../x") == "x"


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://www.Ex.com//a//b/?utm_source=1&x=2&gclid=3#f", "ex.com/a/b?x=2#f"), ("http://ex.com", "ex.com/"), ("ftp://ex.com", ""), (None, ""), ("http://ex.com/?%75tm_a=1", "ex.com/"),
    ],
)
def test_normal_url(spark, url, want):
    assert one(spark, lambda: urls.normal_url(F.col("c0")), url) == want


def test_url_predicates(spark):
    assert one(spark, lambda: urls.is_safe_web_url(F.col("c0")), "https://a.b/c") and not one(spark, lambda: urls.is_safe_web_url(F.col("c0")), "https://u:p@a.b/c")
    assert one(spark, lambda: urls.is_safe_web_url(F.col("c0")), None) is False
    assert one(spark, lambda: urls.video_id(F.col("c0")), "https://www.youtube.com/watch?t=1&v=abcdefghijk") == "abcdefghijk"
    assert one(spark, lambda: urls.external_links(F.array(F.col("c0"), F.col("c1"))), "http://a.b/x/", "http://www.a.b/x") == ["a.b/x"]


def test_html_text_and_cells(spark):
    assert one(spark, lambda: text.html_text(F.col("c0")), "<p>a &amp;lt; b</p><script>x</script><!-- c --><li>d&nbsp;e</li>") == "a &lt; b\n\nd e"
    assert one(spark, lambda: text.safe_cell(F.col("c0")), "=1+1") == "'=1+1" and one(spark, lambda: text.safe_cell(F.col("c0")), "x") == "x"
    assert one(spark, lambda: text.hash_bits_similarity(F.col("c0"), F.col("c1")), "0101", "0111") == 0.75
    assert one(spark, lambda: text.hash_bits_similarity(F.col("c0"), F.col("c1")), "0101", "01") is None


def test_asset_ladder(spark):
    yes, no, none = F.lit(True), F.lit(False), F.lit(None).cast("double")
    rung = lambda *a: one(spark, lambda: files.asset_method(*a)["method"], "x")
    assert rung(yes, no, none, yes, none, F.lit(1.0), yes) == "SHA256_EXACT"
    assert rung(no, yes, F.lit(0.95), yes, none, F.lit(1.0), yes) == "IMAGE_PERCEPTUAL"
    assert rung(no, yes, none, yes, F.lit(1.0), F.lit(1.0), yes) == "HASH_MISMATCH"
    assert rung(no, no, none, yes, F.lit(0.95), F.lit(1.0), yes) == "NAME_SIZE_NEAR"
    assert rung(no, no, none, no, none, F.lit(0.2), no) == "WEAK_NAME"


@pytest.mark.parametrize(
    ("said", "want"),
    [("1/3 + 1/6", Fraction(1, 2)), ("2^-2", Fraction(1, 4)), ("-2^2", Fraction(-4)), ("50% × 3", Fraction(3, 2)), ("0.1+0.2", Fraction(3, 10)), ("1/0", None), ("x+1", None), ("2**3", None), ("", None), (None, None), ("(1", None), ("007 + 1", Fraction(8)), ("9^9^9", None), ("0^0", None)],
)
def test_exact_values(said, want):
    assert exact.evaluate(said) == want


@settings(max_examples=100, deadline=None)
@given(st.integers(-999, 999), st.integers(1, 999), st.integers(0, 6))
def test_rounding_is_nearest_or_unknown(n, d, places):
    value = Fraction(n, d)
    got = exact.rounded(value, places)
    if got is None:
        assert (abs(value) * 10**places) % 1 == Fraction(1, 2)
    else:
        assert abs(Fraction(got) - value) * 10**places < Fraction(1, 2)


def test_exact_column(spark):
    assert one(spark, lambda: exact.exact(F.col("c0")), "1/8")["text"] == "0.1250"
    assert one(spark, lambda: exact.exact(F.col("c0"), 2), "1/8")["text"] is None
    assert one(spark, lambda: exact.exact(F.col("c0")), "what?")["numerator"] is None
