"""Chat formatting by quotation linking, in DataFrame operations only.

A line's quote level is the number of > signs it starts with. Paragraphs are runs of lines of one level
without blank lines; paragraphs and single lines are normalised (a-z, single spaces) and hashed. A quoted
hash links to the first message of its conversation that has it in its own words, if that came earlier.
The linked message of the lowest level, the latest of several, is the one answered; a message without links
answers the one before it. Conversations are put in reply order: a message, what follows it turn by turn,
then the branches that quote it, the last quoted message's first, each branch in its own order.

Branches are numbered by their path of branch points, found by doubling; the order inside a conversation
comes from a range sort over all conversations and counts by range, so that a conversation of any length
is spread over tasks. Chats are cut into parts of ``PART`` messages.

Edge cases: a null text is empty, a null role is written as ``unknown``; null conversation ids form one
conversation without links, a null turn sorts first and has no links; repeated rows are separate messages,
and those of one turn share its links; a message that only quotes stays with an empty body; no rows give no
rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

PART = 256
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = r"[\x09-\x0D\x20]+"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), _BLANKS, " "))


def quoted_lines(text: Column) -> Column:
    """array of (level, content) of the lines of a text."""

    def line(x: Column) -> Column:
        mark = F.regexp_extract(x, r"^[ \t]*(?:>[ \t]?)+", 0)
        return F.struct(
            (F.length(mark) - F.length(F.replace(mark, F.lit(">"), F.lit("")))).alias("level"),
            F.substr(x, F.length(mark) + 1).alias("content"),
        )

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line)


def paragraphs(lines: Column) -> Column:
    """array of (level, text): normalised paragraphs, blank ones left out. ``lines`` is a stored column."""
    blank = lambda i: _normal(F.get(lines, i)["content"]) == ""
    begins = lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, i - 1)["level"]) | blank(i) | blank(i - 1)
    starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), begins)
    once = F.transform(F.array(F.struct(starts.alias("starts"), F.transform(lines, lambda x: x["content"]).alias("texts"))), lambda o: F.transform(
        o["starts"],
        lambda s, k: F.struct(
            F.get(lines, s)["level"].alias("level"),
            _normal(F.array_join(F.slice(o["texts"], s + 1, F.coalesce(F.get(o["starts"], k + 1), F.size(lines)) - s), " ")).alias("text"),
        ),
    ))
    whole = F.get(once, 0)  # starts and texts are computed once per message
    return F.filter(whole, lambda p: p["text"] != "")


def parsed(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, body, keys): keys are the (level, hash) of paragraphs and lines."""
    lines = conversations.select("conv_id", "turn", "role", quoted_lines(F.col("text")).alias("lines"))
    both = lines.select("*", paragraphs(F.col("lines")).alias("parts"))
    own = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["content"]), "\n")
    single = F.filter(F.transform("lines", lambda x: F.struct(x["level"].alias("level"), _normal(x["content"]).alias("text"))), lambda p: p["text"] != "")
    keys = F.array_distinct(F.transform(F.concat("parts", single), lambda p: F.struct(p["level"].alias("level"), F.md5(p["text"]).alias("key"))))
    return both.select("conv_id", "turn", "role", F.regexp_replace(own, rf"^{_BLANKS}|{_BLANKS}\z", "").alias("body"), keys.alias("keys"))


def quote_links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, key, origin): quotations and the first message of the conversation that has them."""
    keys = messages.select("conv_id", "turn", F.explode("keys").alias("k")).select("conv_id", "turn", "k.level", "k.key")
    origins = keys.where("level = 0").groupBy("conv_id", "key").agg(F.min("turn").alias("origin"))
    return keys.where("level > 0").distinct().join(origins, ["conv_id", "key"]).where("origin < turn").select("conv_id", "turn", "level", "key", "origin")


def branches(messages: DataFrame, links: DataFrame) -> DataFrame:
    """(conv_id, turn, parent, n_links, start, path): ``path`` names the branch, (-answered turn, first turn)
    for each branch point from the conversation's start on; empty on the main line. Only distinct turns."""
    answers = links.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "origin"))["origin"].alias("quoted"), F.count("*").alias("n_links"))
    turns = messages.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.count("*").alias("copies"))
    n = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(turns.join(answers, ["conv_id", "turn"], "left").repartitionByRange(n, "conv_id", "turn").withColumn("range", F.spark_partition_id()), "turns")
    inside = Window.partitionBy("conv_id", "range").orderBy("turn")
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    edges = ranged.groupBy("conv_id", "range").agg(F.max("turn").alias("top"))
    came = edges.withColumn("came", F.max("top").over(before)).select("conv_id", "range", "came")  # a row per range
    rows = ranged.join(came, ["conv_id", "range"]).withColumn("previous", F.coalesce(F.lag("turn").over(inside), "came"))
    rows = rows.withColumn("parent", F.coalesce("quoted", "previous"))
    rows = rows.withColumn("starts", F.col("quoted").isNotNull() & (F.col("quoted") != F.col("previous")))
    # the branch a turn is on begins at the last turn, up to itself, that starts one
    own = F.last(F.when(F.col("starts"), F.col("turn")), ignorenulls=True).over(inside)
    rows = materialize(rows.withColumn("here", own), "turns")
    last = rows.groupBy("conv_id", "range").agg(F.max("here").alias("last"))
    came = last.withColumn("was", F.max("last").over(before)).select("conv_id", "range", "was")
    rows = rows.join(came, ["conv_id", "range"]).withColumn("start", F.coalesce("here", "was"))
    rows = materialize(rows.select("conv_id", "turn", "parent", "n_links", "starts", "start"), "turns")
    point = rows.where("starts").select("conv_id", F.col("turn").alias("start"), F.col("parent").alias("at"))
    on = rows.select("conv_id", F.col("turn").alias("at"), F.col("start").alias("above"))
    step = F.array(F.struct((-F.col("at")).alias("at"), F.col("start").alias("start")))
    paths = materialize(point.join(on, ["conv_id", "at"]).select("conv_id", "start", "above", step.alias("path")), "paths")
    while paths.where("above is not null").limit(1).count():  # each round doubles the known stretch of a path
        up = paths.select("conv_id", F.col("start").alias("above"), F.col("above").alias("next"), F.col("path").alias("head"))
        longer = paths.join(up, ["conv_id", "above"], "left").select("conv_id", "start", F.col("next").alias("above"), F.concat(F.coalesce("head", F.array().cast(paths.schema["path"].dataType)), "path").alias("path"))
        paths = materialize(longer, "paths")
    return rows.join(paths.select("conv_id", "start", "path"), ["conv_id", "start"], "left").select("conv_id", "turn", "parent", "n_links", "path")


def reply_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, body, parent, n_links, position): messages without quotes and their places, from 0,
    in their conversation's reply order."""
    messages = materialize(parsed(conversations), "messages")
    found = branches(messages, quote_links(messages))
    none = F.array().cast(found.schema["path"].dataType)
    rows = messages.join(found, ["conv_id", "turn"], "left").withColumn("path", F.coalesce("path", none)).drop("keys")
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["path", "turn", "role", "body"]
    ranged = materialize(rows.repartitionByRange(n, "conv_id", *order).withColumn("range", F.spark_partition_id()), "ordered")
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select(F.col("conv_id").alias("conv"), F.col("range").alias("r"), "base")
    inside = Window.partitionBy("conv_id", "range").orderBy(*order)
    placed = ranged.withColumn("at", F.row_number().over(inside) - 1).join(bases, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("range") == F.col("r")))
    return placed.select("conv_id", "turn", "role", "body", "parent", F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("base") + F.col("at")).alias("position"))


def format_chats(conversations: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, part, n_messages, n_linked, chat): conversations in reply order, ``part`` messages at a time."""
    rows = reply_order(conversations).withColumn("part", F.floor(F.col("position") / part))
    message = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), "body", F.lit("<|end|>\n"))
    grouped = rows.groupBy("conv_id", "part").agg(  # at most ``part`` messages in a group
        F.count("*").alias("n_messages"),
        F.sum((F.col("n_links") > 0).cast("long")).alias("n_linked"),
        F.sort_array(F.collect_list(F.struct("position", message.alias("message")))).alias("messages"),
    )
    return grouped.select("conv_id", "part", "n_messages", "n_linked", F.array_join("messages.message", "").alias("chat"))


def op2_chat_formatting(spark, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


OP2_SQL = r"""
WITH RECURSIVE src AS (SELECT row_number() OVER () AS id, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
marked AS (
  SELECT id, conv_id, turn, n, line, regexp_extract(line, '^[ \t]*(?:>[ \t]?)+') AS mark
  FROM (SELECT id, conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM src)
),
lines AS (
  SELECT id, conv_id, turn, n, length(mark) - length(replace(mark, '>', '')) AS level, substr(line, length(mark) + 1) AS content,
    trim(regexp_replace(translate(substr(line, length(mark) + 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+', ' ', 'g')) AS norm
  FROM marked
),
flagged AS (
  SELECT *, CASE WHEN lag(level) OVER w IS DISTINCT FROM level OR norm = '' OR lag(norm) OVER w = '' THEN 1 ELSE 0 END AS b
  FROM lines WINDOW w AS (PARTITION BY id ORDER BY n)
),
numbered AS (SELECT *, sum(b) OVER (PARTITION BY id ORDER BY n) AS p FROM flagged),
paras AS (SELECT id, conv_id, turn, level, string_agg(norm, ' ' ORDER BY n) AS norm FROM numbered WHERE norm <> '' GROUP BY id, conv_id, turn, level, p),
keys AS (SELECT DISTINCT conv_id, turn, level, md5(norm) AS key FROM (SELECT conv_id, turn, level, norm FROM paras UNION ALL SELECT conv_id, turn, level, norm FROM lines WHERE norm <> '')),
origins AS (SELECT conv_id, key, min(turn) AS origin FROM keys WHERE level = 0 GROUP BY ALL),
links AS (SELECT k.conv_id, k.turn, k.level, o.origin FROM keys k JOIN origins o USING (conv_id, key) WHERE k.level > 0 AND o.origin < k.turn),
answers AS (SELECT conv_id, turn, count(*) AS n_links, arg_max(origin, -level * 1000000000 + origin) AS quoted FROM links GROUP BY ALL),
turns AS (SELECT DISTINCT conv_id, turn FROM src WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
linked AS (
  SELECT conv_id, turn, n_links, quoted, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous
  FROM turns LEFT JOIN answers USING (conv_id, turn)
),
started AS (
  SELECT *, coalesce(quoted <> previous, false) AS starts,
    max(CASE WHEN quoted <> previous THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS start
  FROM linked
),
points AS (SELECT s.conv_id, s.turn AS start, s.quoted AS spot, o.start AS above FROM started s JOIN started o ON o.conv_id = s.conv_id AND o.turn = s.quoted WHERE s.starts),
paths(conv_id, start, path) AS (
  SELECT conv_id, start, [struct_pack(a := -spot, s := start)] FROM points WHERE above IS NULL
  UNION ALL
  SELECT p.conv_id, p.start, list_append(q.path, struct_pack(a := -p.spot, s := p.start)) FROM points p JOIN paths q ON q.conv_id = p.conv_id AND q.start = p.above
),
own AS (SELECT id, string_agg(content, chr(10) ORDER BY n) FILTER (level = 0) AS body FROM lines GROUP BY id),
ordered AS (
  SELECT s.conv_id, s.role, coalesce(t.n_links, 0) AS n_links,
    regexp_replace(coalesce(o.body, ''), '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+\z', '', 'g') AS body, s.turn, coalesce(p.path, []) AS path
  FROM src s JOIN own o USING (id) LEFT JOIN started t ON t.conv_id = s.conv_id AND t.turn = s.turn
  LEFT JOIN paths p ON p.conv_id = s.conv_id AND p.start = t.start
),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY path, turn NULLS FIRST, role NULLS FIRST, body) - 1 AS position FROM ordered)
SELECT conv_id, position // 256 AS part, count(*) AS n_messages, sum((n_links > 0)::BIGINT)::BIGINT AS n_linked,
  string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || body || '<|end|>' || chr(10), '' ORDER BY position) AS chat
FROM placed GROUP BY conv_id, position // 256
"""
