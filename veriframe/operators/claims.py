"""Claims of ingestion reports: events in a text with the headings they stand under, their kinds and scope, and the items they
are about.

A heading goes for what follows it up to the next of its kind: an as-of join of events and headings by place in the report. Claims
meet items by equal keys only (names, rare parts of names, quoted questions) within their course.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.functions import text
from veriframe.functions.files import file_name
from veriframe.functions.questions import question_text
from veriframe.functions.text import clean_name, clean_text
from veriframe.operators import joins
from veriframe.operators.captures import asset_event, generated_behavior

# Headings of events, what is no title of an item, and what events say.
EVENTS = "AI-Generated Mandatory Field|Content Adaptation|Content Excluded|Unsupported Content Fallback|Empty Module Structure"
REPORT_NAME = r"(?i)author alignment report|author.?s eyes|\[delete me\]"
REPORT_TEXT = r"(?i)transformations and gap-filling|ai-generated mandatory field|content adaptation|content excluded|unsupported content fallback|empty module structure"
TYPE_LABEL = r"(?i)^(?:supplement|ungradedAssignment|gradedAssignment|assignment|ungradedWidget|gradedWidget|widget|plugin|lecture|discussionPrompt)(?:\s+Opens in a new tab)?$"
FAILURE = r"(?i)(?:NonRetryable|Exception|ERROR DURING DISTILLATION|distillation|parsing failure|malformed model|failed to (?:parse|convert|distill))"
FAILED = r"(?i)(NonRetryable[A-Za-z0-9_.$:-]*Exception[^.]{0,500}|\[ERROR DURING DISTILLATION\][^.]{0,500}|malformed model JSON[^.]{0,500})"
GENERATED_READING = r"(?i)\bgenerated\s+(?:the\s+)?(?:replacement\s+)?reading\s+content\b"
REPAIR = r"(?i)(?:^|[\s.])(?:reattach|re-attach|recreate|re-create|manually add|course team should|restore|upload)\b.*?(?:file|attachment|question|content|document|asset)"
LEFT_OPEN = r"(?i)\bpassing (?:threshold|score)\s+(?:to\s+)?(?:null|unspecified)\b"
QUOTED_FILE = r"""(?i)["“”']([^"“”'\n]{1,220}\.(?:docx?|pdf|pptx?|xlsx?|zip|html?|mp[34]|wav|png|jpe?g))["“”']"""
QUOTED_QUESTION = r"""(?i)\bQuestion\s+['"“]([^\n]{12,700}?\?)['"”]"""
SEPARATE = (r"(?i)\bseparate\s+(?:rubric\s+)?document\b", r"(?i)\bnot available\s+(?:with)?in\s+this item\b")
EXPLICIT_LOSS = (
    r"(?i)\b(?:could not|cannot|unable to)\s+(?:attach|embed|upload|include)\b|\b(?:attachment|file|asset)\b.{0,100}\b(?:could not be represented|not represented|missing from|no asset identifier)\b"
)
SCOPED = ("UNRESOLVED_SOURCE_ASSET", "UNSUPPORTED_CONTENT_FALLBACK", "REPAIR_INSTRUCTION")
NAMELESS = ("UNSUPPORTED_CONTENT_FALLBACK", "UNRESOLVED_SOURCE_ASSET", "GENERATED_CONTENT_FALLBACK", "GENERATED_BEHAVIOR", "SI_PROCESSING_FAILURE")
PLAIN_TITLE = r"^(?:practice|final|weekly) (?:test|quiz|assessment)$"
LOOK_BACK, EXCERPT, NEAR_PATH, MOST = 12000, 520, 0.78, 14
#: Claims of a course with no more than so many items meet each of these, those of a larger one by shared features.
PAIRS = 100
_CUT = "\x01"


def _parts(reports: DataFrame) -> DataFrame:
    """(course, report_id, place, part, failed, Module, Item): a report's text cut where an event or a heading begins, each part with the last
    headings before it; and after them, as ``failed``, the failures it tells of anywhere. A text is read once for both."""
    valid = F.concat_ws(" ", "name", "path").rlike(REPORT_NAME) & F.col("text").rlike(REPORT_TEXT)
    clean = reports.where(valid).select("course", "report_id", clean_text(F.replace("text", F.lit(_CUT), F.lit(" "))).alias("text"))
    cuts = F.regexp_replace("text", rf"(?i)\b(?=[ACUEDMI])(?=(?:{EVENTS}|DO NOT PUBLISH)\b|(?:Module|Item):\s)", _CUT)
    piece = lambda failed: lambda p: F.struct(p.alias("part"), F.lit(failed).alias("failed"))
    pieces = F.concat(F.transform(F.split(cuts, _CUT), piece(False)), F.transform(F.regexp_extract_all("text", F.lit(FAILED), 1), piece(True)))
    parts = clean.select("course", "report_id", F.posexplode(pieces).alias("i", "p")).select("course", "report_id", "i", "p.part", "p.failed")
    before = Window.partitionBy("course", "report_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("place", F.coalesce(F.sum(F.length("part")).over(before), F.lit(0)))
    heading = lambda kind: F.when(F.col("part").rlike(rf"(?i)^{kind}:\s"), F.struct("place", F.trim(F.regexp_replace("part", rf"(?i)^{kind}:\s+", "")).alias("title")))
    return parts.withColumns({kind: F.last(heading(kind), ignorenulls=True).over(before) for kind in ("Module", "Item")})


def _read(reports: DataFrame) -> DataFrame:
    """(course, report_id, place, category, body, subject, path, failed): the events of ``report_events`` and, with a category of null, the failures."""
    near = lambda kind: F.when(F.col("place") - F.col(f"{kind}.place") <= LOOK_BACK, F.col(kind))
    category = F.regexp_extract("part", rf"(?i)^({EVENTS})\b", 1)
    events = _parts(reports).withColumn("category", F.when(~F.col("failed"), category)).where("failed or category != ''").withColumns({"Module": near("Module"), "Item": near("Item")})
    of_item = F.col("Item").isNotNull() & (F.col("Module").isNull() | (F.col("Item.place") > F.col("Module.place")))
    path = F.coalesce("Module.title", F.lit(""))
    subject = F.when(of_item, F.col("Item.title")).otherwise(path)
    body = F.trim(F.when(F.col("failed"), F.col("part")).otherwise(F.substr("part", F.length("category") + 1)))
    return events.select("course", "report_id", "place", "category", body.alias("body"), F.when(subject.rlike(TYPE_LABEL), "").otherwise(subject).alias("subject"), path.alias("path"), "failed")


def report_events(reports: DataFrame) -> DataFrame:
    """(course, report_id, place, category, body, subject, path) of reports(course, report_id, name, path, text): each event with the
    module and item heading it stands under, of those that begin at most LOOK_BACK characters before. An item heading before the
    last module heading is none; a label of a type is no subject."""
    return _read(reports).where("not failed").drop("failed")


def _claim(condition: Column, kind: str, severity: str) -> Column:
    return F.when(condition, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity")))


def excerpt(c: Column) -> Column:
    return F.when(F.length(c) > EXCERPT, F.concat(F.substring(c, 1, EXCERPT - 3), F.lit("..."))).otherwise(c)


def _judged(rows: DataFrame) -> DataFrame:
    """(event, failed, type, severity, excerpt, x, scope) of all different events: what each claims and how far, a row for each thing."""
    category = F.when(~F.col("failed"), F.regexp_extract("event", rf"(?i)^({EVENTS})\b", 1))
    rows = rows.select("event", "failed").distinct().withColumn("category", category).withColumn("asset", F.when(~F.col("failed"), asset_event(F.col("event"))))
    is_ = lambda name: F.lower("category") == name.lower()
    behavior = is_("AI-Generated Mandatory Field") & generated_behavior(F.col("event"))
    reading = is_("AI-Generated Mandatory Field") & F.substr("event", F.length("category") + 1).rlike(GENERATED_READING)
    lost = F.col("asset") == "UNRESOLVED_SOURCE_ASSET"
    rows = rows.withColumn("behavior", behavior)
    kinds = F.array_compact(F.array(
        _claim(is_("Content Excluded"), "INTENTIONAL_EXCLUSION", "REVIEW"), _claim(is_("Unsupported Content Fallback"), "UNSUPPORTED_CONTENT_FALLBACK", "REVIEW"),
        _claim(lost, "UNRESOLVED_SOURCE_ASSET", "CRITICAL"), _claim(F.col("asset") == "CONTENT_MARKUP_ADAPTATION", "CONTENT_MARKUP_ADAPTATION", "INFO"), _claim(F.col("failed") | F.col("event").rlike(FAILURE), "SI_PROCESSING_FAILURE", "CRITICAL"),
        _claim(F.col("behavior"), "GENERATED_BEHAVIOR", "REVIEW"), _claim(~F.col("behavior") & reading, "GENERATED_CONTENT_FALLBACK", "REVIEW"),
        _claim(~F.col("failed") & ~lost & F.col("event").rlike(REPAIR), "REPAIR_INSTRUCTION", "REVIEW"),
    ))
    told = rows.select("event", "failed", F.explode(kinds).alias("k"), excerpt(F.col("event")).alias("excerpt"))
    return _with_scope(told.select("event", "failed", "k.type", "k.severity", "excerpt", clean_name("excerpt").alias("x")))


def report_claims(reports: DataFrame) -> DataFrame:
    """(course, type, severity, subject, path, excerpt) of reports: what their events claim, one event perhaps several things, and the failures
    a text tells of anywhere. What is told again in the same words under the same headings is one claim. Events are the same from report to
    report, so each different one is judged once."""
    event = F.when(F.col("failed"), F.col("body")).otherwise(F.trim(F.concat_ws(" ", "category", "body"))).alias("event")
    of = lambda c, failed: F.when(F.col("failed"), failed).otherwise(F.col(c)).alias(c)
    rows = joins.settled(_read(reports).select("course", of("subject", "processing"), of("path", ""), event, "failed"))
    told = rows.join(joins.settled(_judged(rows)), ["event", "failed"])
    keys = ["course", "type", clean_name("subject").alias("s"), clean_name("path").alias("p"), "x"]
    first = F.min(F.struct("severity", "subject", "path", "excerpt", "scope")).alias("c")
    # By course alone, so that what joins its claims with its items needn't move them again.
    return _rescoped(told.repartition("course").groupBy(*keys).agg(first).select("course", "type", "c.severity", "c.subject", "c.path", "c.excerpt", "c.scope"))


def scoped(claims: DataFrame) -> DataFrame:
    """``claims`` with type, severity and subject as their words allow them to be read: a grade left open is no invented one, a quoted
    file is the subject, moved content is no lost file, another document is not missing from the course. What they were before
    is kept in original_type and original_subject, null where nothing changed."""
    return _rescoped(_with_scope(claims))


def _with_scope(claims: DataFrame) -> DataFrame:
    """With ``scope``: the type and severity that a claim's words allow, and the one file that they quote."""
    kind, words = F.col("type"), F.col("excerpt")
    files = F.array_distinct(F.transform(F.regexp_extract_all("excerpt", F.lit(QUOTED_FILE), 1), file_name))
    rows = claims.withColumns({"_files": F.when(kind.isin(*SCOPED), files), "_event": F.when(kind.isin("REPAIR_INSTRUCTION", "UNRESOLVED_SOURCE_ASSET"), asset_event(words))})
    one = F.coalesce(F.size("_files") == 1, F.lit(False))
    open_ = (kind == "GENERATED_BEHAVIOR") & words.rlike(LEFT_OPEN) & ~generated_behavior(words)
    named = (kind == "REPAIR_INSTRUCTION") & (F.col("_event") == "UNRESOLVED_SOURCE_ASSET") & one
    moved = (kind == "UNRESOLVED_SOURCE_ASSET") & (F.col("_event") == "CONTENT_MARKUP_ADAPTATION")
    apart = (kind == "UNRESOLVED_SOURCE_ASSET") & words.rlike(SEPARATE[0]) & words.rlike(SEPARATE[1]) & ~words.rlike(EXPLICIT_LOSS)
    outcome = F.coalesce(
        _claim(open_, "SOURCE_GRADING_UNSPECIFIED", "INFO"), _claim(named, "UNRESOLVED_SOURCE_ASSET", "CRITICAL"), _claim(moved, "CONTENT_MARKUP_ADAPTATION", "INFO"),
        _claim(apart, "SOURCE_ASSET_SCOPE_REVIEW", "REVIEW"), F.struct("type", "severity"),
    )
    rows = rows.withColumn("_outcome", outcome)
    return rows.select(*claims.columns, F.struct("_outcome.type", "_outcome.severity", F.when(one, F.get("_files", F.lit(0))).alias("file")).alias("scope"))


def _rescoped(rows: DataFrame) -> DataFrame:
    kind, subject = F.col("scope.type"), F.coalesce("scope.file", "subject")
    changed = (kind != F.col("type")) | (subject != F.col("subject"))
    rest = [c for c in rows.columns if c not in ("type", "severity", "subject", "scope")]
    return rows.select(
        *rest, kind.alias("type"), F.col("scope.severity").alias("severity"), subject.alias("subject"), F.when(changed, F.col("type")).alias("original_type"), F.when(changed, F.col("subject")).alias("original_subject"),
    )


def _identified(claims: DataFrame) -> DataFrame:
    """With ``claim``, a key made of what a claim says, and its names in normal form."""
    key = F.md5(F.to_json(F.struct("course", "type", "subject", "path", "excerpt")))
    stems = F.when(F.col("type").isin(*SCOPED), F.array_distinct(F.transform(F.regexp_extract_all("excerpt", F.lit(QUOTED_QUESTION), 1), lambda s: F.lower(question_text(s)))))
    return claims.withColumns({"claim": key, "_subject": clean_name("subject"), "_hint": clean_name("path"), "_stems": F.coalesce(stems, F.array().cast("array<string>"))})


def _large(items: DataFrame, pairs: int) -> DataFrame:
    """(course): those with more than ``pairs`` items."""
    return joins.settled(items.groupBy("course").agg(F.count("*").alias("n")).where(F.col("n") > pairs).select("course"))


def localized(claims: DataFrame, items: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """``claims`` with the item (item_id, item_name) that alone of items(course, item_id, name, path) in the named module has the
    subject as its name or, where there is no subject, has a telling name that stands in the claim's words; and by which ``method``. Claims that
    quote questions are left to these."""
    rows = _identified(claims)
    forms = joins.settled(items.select("course", "item_id", F.col("name").alias("item_name"), clean_name("name").alias("_name"), clean_name("path").alias("_path")))
    large = _large(forms, pairs)
    methods = F.lit("UNIQUE_EXACT_SOURCE_NAME_IN_MODULE"), F.lit("UNIQUE_EXPLICIT_SOURCE_NAME_IN_MODULE")
    within = (F.col("_path") == F.col("_hint")) | F.startswith(F.col("_path"), F.concat("_hint", F.lit(" ")))
    plain = (F.size("_stems") == 0) & (F.col("_hint") != "")
    silent = (F.col("_subject") == "") & F.col("type").isin(*NAMELESS)
    telling = (F.length("_name") >= 10) & F.contains("_name", F.lit(" ")) & ~F.col("_name").rlike(PLAIN_TITLE) & (F.col("_path") != "")
    forms = forms.withColumn("_telling", telling)
    said = F.contains("_words", F.concat(F.lit(" "), "_name", F.lit(" ")))
    spaced = F.when(plain & silent, F.concat(F.lit(" "), clean_name("excerpt"), F.lit(" "))).alias("_words")
    own = [c for c in rows.columns if c not in ("_subject", "_hint", "_stems")]

    def by_pairs(rows: DataFrame, forms: DataFrame) -> DataFrame:
        """All items of a claim's course side by side with it."""
        named = (F.col("_subject") != "") & (F.col("_name") == F.col("_subject"))
        fits = F.col("_plain") & (named | (F.col("_words").isNotNull() & F.col("_telling") & said)) & within
        rows = rows.select("*", spaced, plain.alias("_plain"), F.monotonically_increasing_id().alias("_row"))
        met = rows.join(forms.withColumnRenamed("course", "_course"), (F.col("course") == F.col("_course")) & fits, "left")
        kept = [F.first(c).alias(c) for c in own if c not in ("course", "claim")]
        alone = met.groupBy("course", "claim", "_row").agg(*kept, F.count("item_id").alias("n"), *(F.min(c).alias(c) for c in ("item_id", "item_name")))
        one = (F.col("n") == 1) & (F.sum("n").over(Window.partitionBy("course", "claim")) == 1)  # what is said twice is about none
        method = F.when(clean_name("subject") == "", methods[1]).otherwise(methods[0])
        return alone.select(*own, *(F.when(one, F.col(c)).alias(c) for c in ("item_id", "item_name")), F.when(one, method).alias("method"))

    def by_features(rows: DataFrame, forms: DataFrame) -> DataFrame:
        """Names meet subjects as they are, and words by the rarest one of a name."""
        some = rows.where(plain)
        by_name = some.where("_subject != ''").join(forms.withColumnRenamed("_name", "_subject"), ["course", "_subject"]).where(within).select("claim", "course", "item_id", "item_name")
        word = lambda c: F.explode(F.array_distinct(F.filter(F.split(c, " "), lambda x: x != "")))
        names = forms.where("_telling").select("course", F.struct("item_id", "item_name", "_name", "_path").alias("id"), word("_name").alias("feature"))
        often = names.groupBy("course", "feature").agg(F.count("*").alias("often"))
        rarest = names.join(often, ["course", "feature"]).groupBy("course", "id").agg(F.min(F.struct("often", "feature"))["feature"].alias("feature"))
        words = some.where(silent).select("course", "claim", "_hint", spaced)
        met = words.withColumn("feature", word("_words")).join(rarest, ["course", "feature"]).select("course", "claim", "_hint", "_words", "id.*")
        by_words = met.where(within & said).select("claim", "course", "item_id", "item_name")
        found = by_name.withColumn("method", methods[0]).unionByName(by_words.withColumn("method", methods[1]))
        alone = found.groupBy("claim").agg(F.count("*").alias("n"), *(F.min(c).alias(c) for c in ("item_id", "item_name", "method"))).where("n = 1").drop("n")
        return rows.join(alone, "claim", "left").select(*own, "item_id", "item_name", "method")

    if large.isEmpty():
        return by_pairs(rows, forms)
    rows = joins.settled(rows)
    of = lambda df, how: df.join(large, "course", how)
    return by_pairs(of(rows, "left_anti"), forms).unionByName(by_features(of(rows, "left_semi"), of(forms, "left_semi")))


def path_compatible(hint: Column, path: Column) -> Column:
    """Of normal names: no hint fits any path; numbers of modules must agree; else one holds the other or they are alike."""
    number = lambda c: F.regexp_extract(c, r"\bmodule\s+(\d+)\b", 1)
    other = (number(hint) != "") & (number(path) != "") & (number(hint).cast("decimal(38,0)") != number(path).cast("decimal(38,0)"))
    return F.when(hint == "", True).when((path == "") | other, False).otherwise(F.contains(path, hint) | F.contains(hint, path) | (text.fuzzy(path, hint) >= NEAR_PATH))


def claimed_items(claims: DataFrame, items: DataFrame, questions: DataFrame, most: int = MOST, pairs: int = PAIRS) -> DataFrame:
    """(course, item_id, claim, type, basis): the claims that are about each of items(course, item_id, name, path, assets): those bound
    to it, those whose quoted questions(course, item_id, prompt) all stand there once, those whose subject names it or one of its
    assets. Each item has its first ``most``, by type and words."""
    rows = joins.settled(_identified(claims.drop("claim")).select("course", "claim", "type", "excerpt", "item_id", "_subject", "_hint", "_stems"))
    names = F.transform(F.coalesce("assets", F.array().cast("array<string>")), clean_name)
    where = joins.settled(items.select("course", "item_id", clean_name("name").alias("_name"), clean_name("path").alias("_path"), names.alias("_assets")))
    told = ["course", "claim", "type", "excerpt"]
    bound = rows.where("item_id is not null").select(*told, "item_id").withColumn("basis", F.lit("BOUND"))
    free = rows.where("item_id is null").drop("item_id")
    compatible = path_compatible(F.col("_hint"), F.col("_path"))

    stems = free.where(F.size("_stems") > 0).select(*told, "_hint", F.size("_stems").alias("asked"), F.explode("_stems").alias("stem"))
    prompts = questions.select("course", "item_id", F.lower(question_text("prompt")).alias("stem"))
    hits = stems.join(prompts, ["course", "stem"]).groupBy(*told, "_hint", "asked", "item_id", "stem").agg(F.count("*").alias("n"))
    whole = hits.groupBy(*told, "_hint", "asked", "item_id").agg(F.count_if(F.col("n") == 1).alias("once")).where("once = asked")
    quoted = whole.join(where, ["course", "item_id"]).where(compatible).select(*told, "item_id").withColumn("basis", F.lit("QUESTION"))

    named = free.where((F.size("_stems") == 0) & (F.col("_subject") != "")).select(*told, "_subject", "_hint")
    large = _large(where, pairs)
    longer = lambda s, t: (F.length(s) >= F.length(t) + 3) & F.contains(s, t)
    title = lambda s, t: (F.length(s) >= 4) & (F.length(t) >= 4) & ((s == t) | longer(s, t) | longer(t, s))
    held = lambda s, t: (F.length(t) >= 4) & (F.contains(s, t) | F.contains(t, s))

    def by_pairs(named: DataFrame, where: DataFrame) -> DataFrame:
        """All items of a claim's course side by side with it."""
        s = F.col("_subject")
        basis = F.when(title(s, F.col("_name")), "NAME").when(F.exists("_assets", lambda t: held(s, t)), "ASSET")
        return named.join(where, "course").withColumn("basis", basis).where(F.col("basis").isNotNull()).where(compatible).select(*told, "item_id", "basis")

    def by_features(named: DataFrame, where: DataFrame) -> DataFrame:
        """Different subjects meet different names of items and assets by the rarest character or gram of the one that may be held."""
        short = lambda c: F.array_distinct(F.concat(F.split(c, ""), text.grams(c, 2), text.grams(c, 3)))
        subjects = named.select("course", F.col("_subject").alias("id")).distinct().withColumn("feature", F.explode(short("id")))
        names = where.select("course", F.explode(F.concat(F.array("_name"), "_assets")).alias("id")).where("length(id) >= 4").distinct()
        met = joins.settled(joins.holding_candidates(subjects, names.withColumn("feature", F.explode(short("id"))), ["course"]))
        s, t = F.col("source"), F.col("target")
        by_title = met.where(title(s, t)).toDF("course", "_subject", "_name").join(where, ["course", "_name"])
        own = where.select("course", "item_id", "_path", F.explode("_assets").alias("asset"))
        by_asset = met.where(held(s, t)).toDF("course", "_subject", "asset").join(own, ["course", "asset"])
        both = by_title.select("course", "_subject", "item_id", "_path", F.lit("NAME").alias("basis")).unionByName(by_asset.select("course", "_subject", "item_id", "_path", F.lit("ASSET").alias("basis")))
        by_name = named.join(both, ["course", "_subject"]).where(compatible)
        return by_name.groupBy(*told, "item_id").agg(F.max("basis").alias("basis"))

    found = bound.unionByName(quoted)
    if large.isEmpty():
        found = found.unionByName(by_pairs(named, where))
    else:
        of = lambda df, how: df.join(large, "course", how)
        found = found.unionByName(by_pairs(of(named, "left_anti"), where)).unionByName(by_features(of(named, "left_semi"), of(where, "left_semi")))
    order = Window.partitionBy("course", "item_id").orderBy("type", "excerpt", "claim")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("course", "item_id", "claim", "type", "basis")
