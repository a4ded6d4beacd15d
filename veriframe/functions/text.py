"""Text normal forms and similarities as Column expressions; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as ECMAScript counts it, and words that carry no meaning of their own.
SPACE = r"[\s\u00A0\uFEFF\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
STOP_WORDS = ("the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with", "is", "are", "be", "by", "from")
MORE_STOP_WORDS = (*STOP_WORDS, "as", "at", "it", "this", "that", "these", "those", "will", "can")
ADMINISTRATIVE_PARTS = ("archive", "overview", "start here", "syllabus", "instructor")
ADMINISTRATIVE_TITLES = (
    "resource", "resources", "student resource", "student resources", "instructor resource", "instructor resources", "interactive", "indirect",
)
ERROR_PREFIX = r"(?i)^\[error during distillation\]\s*"
WORD = r"(?<![A-Za-z0-9_])([a-z0-9]+)(?![A-Za-z0-9_])"
# A run of white space that isn't a single space: the large class is only asked where the character can be in it.
_RUN = rf"(?=[^ -~]){SPACE}+| (?=[^!-~]){SPACE}+"


def _words(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, however often a lambda reads it."""
    return F.get(F.transform(F.array(value), use), 0)


def clean_text(c: Column | str) -> Column:
    """White space of any kind collapsed to single spaces; null is empty."""
    return F.trim(F.regexp_replace(_text(c), _RUN, " "))


def clean_name(c: Column | str) -> Column:
    """Lower-case letters and digits with single spaces between them."""
    return F.trim(F.regexp_replace(F.lower(_text(c)), "[^a-z0-9]+", " "))


def title_key(c: Column | str) -> Column:
    return clean_name(F.regexp_replace(clean_text(c), ERROR_PREFIX, ""))


def alnum(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(_text(c)), "[^a-z0-9]", "")


def path_parts(c: Column | str) -> Column:
    """Normal segments of a > path without the root."""
    parts = F.transform(F.split(clean_text(c), ">"), lambda x: F.trim(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", " ")))
    return F.filter(parts, lambda x: (x != "") & (x != "root"))


def words(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_text(c)), F.lit(WORD), 1)


def token_set(c: Column | str) -> Column:
    return F.array_except(F.array_distinct(words(c)), _words(STOP_WORDS))


def semantic_tokens(c: Column | str) -> Column:
    """Tokens with meaning, repeats kept."""
    return F.filter(words(c), lambda w: (F.length(w) > 2) & ~w.isin(*MORE_STOP_WORDS))


def set_overlap(a: Column, b: Column) -> Column:
    """Jaccard share of two arrays of distinct values; 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def jaccard(a: Column | str, b: Column | str) -> Column:
    return let(F.struct(token_set(a).alias("p"), token_set(b).alias("q")), lambda x: set_overlap(x["p"], x["q"]))


def edit_similarity(a: Column, b: Column) -> Column:
    """Of two normal strings: 1 if equal, 0.9 if one holds the other, else 1 - distance / longer length."""
    return (
        F.when(a == b, 1.0)
        .when((a == "") | (b == ""), 0.0)
        .when(F.contains(a, b) | F.contains(b, a), 0.9)
        .otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))
    )


def fuzzy(a: Column | str, b: Column | str) -> Column:
    return edit_similarity(alnum(a), alnum(b))


def path_form(c: Column | str) -> Column:
    """struct(text, tokens, last, tail) of a > path: all that a comparison of paths needs, computed once per row."""
    joined = lambda parts: F.array_join(parts, " ")
    return let(
        path_parts(c),
        lambda p: F.struct(
            joined(p).alias("text"), token_set(joined(p)).alias("tokens"), F.try_element_at(p, F.lit(-1)).alias("last"), alnum(F.try_element_at(p, F.lit(-1))).alias("tail")
        ),
    )


def path_similarity(a: Column, b: Column) -> Column:
    """Of two ``path_form``: null if one is empty (a path not observed is no evidence against the other)."""
    token = set_overlap(a["tokens"], b["tokens"])
    tail = F.when(a["last"] == b["last"], 1.0).otherwise(edit_similarity(a["tail"], b["tail"]))
    return (
        F.when((a["text"] == "") | (b["text"] == ""), F.lit(None).cast("double"))
        .when(a["text"] == b["text"], 1.0)
        .otherwise(let(F.struct(token.alias("token"), tail.alias("tail")), lambda x: F.greatest(x["token"], x["token"] * 0.65 + x["tail"] * 0.35)))
    )


def grams(c: Column | str, n: int = 3) -> Column:
    """Character n-grams of the lower-cased clean text, repeats kept."""
    none = F.array().cast("array<string>")
    runs = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, n))
    return let(F.lower(clean_text(c)), lambda t: F.when(F.length(t) >= n, runs(t)).otherwise(none))


def shingles(tokens: Column, n: int) -> Column:
    """Distinct runs of ``n`` tokens."""
    none = F.array().cast("array<string>")
    runs = lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))
    return let(tokens, lambda t: F.when(F.size(t) >= n, F.array_distinct(runs(t))).otherwise(none))


def is_administrative(c: Column | str) -> Column:
    t = F.lower(F.trim(_text(c)))
    held = t.isin(*ADMINISTRATIVE_TITLES)
    for part in ADMINISTRATIVE_PARTS:
        held = held | F.contains(t, F.lit(part))
    return held


def item_type(c: Column | str) -> Column:
    """One of the canonical item types, or the clean text itself where no rule applies."""
    t = F.lower(F.trim(_text(c)))
    has = lambda *parts: F.exists(_words(parts), lambda p: F.contains(t, p))
    return (
        F.when(t == "", "Reading")
        .when(t == "coach", "Coach")
        .when(t.isin("supplement", "reading") | has("lecture"), "Reading")
        .when(t.isin("staffgraded", "ungradedassignment") | has("assignment", "peer"), "Assignment")
        .when(has("discussion"), "Discussion")
        .when(t.isin("plugin", "lti") | has("widget"), "Plugin")
        .when(has("quiz", "exam"), "Assessment")
        .when(has("video"), "Video")
        .otherwise(clean_text(c))
    )


def types_compatible(source: Column, target: Column) -> Column:
    s, t = F.lower(_text(source)), F.lower(_text(target))
    return (
        (s == t)
        | (s.isin("lti", "plugin") & t.isin("lti", "plugin"))
        | ((s == "assessment") & t.isin("assessment", "quiz", "assignment"))
        | ((s == "assignment") & ((t == "assignment") | F.contains(t, F.lit("peer"))))
    )


def match_score(title: Column, path: Column, compatible: Column) -> Column:
    """Weighted score of a pair from its title score, path score (null: not observed) and type."""
    kind = F.when(compatible, 1.0).otherwise(0.15)
    score = F.when(path.isNull(), title * 0.90 + kind * 0.10).otherwise(title * 0.76 + path * 0.14 + kind * 0.10)
    return F.when(title < 0.5, 0.0).when((title >= 0.98) & (score < 0.82), 0.82).otherwise(score)


# Named character references that are decoded.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def html_text(c: Column | str) -> Column:
    """Text of an HTML fragment: comments, scripts and styles dropped, block tags to line ends, named entities
    decoded; numeric references stay as they are."""
    t = F.regexp_replace(_text(c), r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>", "")
    t = F.regexp_replace(t, r"(?i)</?(?:p|div|br|li|h[1-6]|tr)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"</?[A-Za-z][^>]*>", "")
    for entity, char in ENTITIES:
        t = F.regexp_replace(t, "(?i)" + entity, char)
    return F.regexp_replace(t, r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+\z", "")


def safe_cell(c: Column | str) -> Column:
    """A cell that a spreadsheet will not take for a formula."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def hash_bits_similarity(a: Column, b: Column) -> Column:
    """1 - share of differing characters of two strings of equal length; null otherwise."""
    chars = lambda c: F.split(c, "")
    same = F.size(F.filter(F.zip_with(chars(a), chars(b), lambda x, y: x == y), lambda e: e))
    return F.when((a != "") & (b != "") & (F.length(a) == F.length(b)), same / F.length(a))
