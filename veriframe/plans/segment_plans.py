"""Queries over places in texts, and over ledgers of events taken in sequence."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.operators import history, segments, similarity
from veriframe.operators.stored import settled
from veriframe.operators.scope import item_id
from veriframe.sources.tables import table
from veriframe.streaming import ledger, lifecycle

SHINGLE = 5


def _near_passages(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, benchmark items, and the pairs that share a run of five words."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    shared = settled(similarity.shared_shingles(documents, "doc_id", items, SHINGLE).select("doc_id", F.col("id").alias("target_id")))
    return documents, items, shared


def passage_windows(spark, sf_dir: str) -> DataFrame:
    """Where in a document a benchmark item stands best, for those that share words with it."""
    documents, items, shared = _near_passages(spark, sf_dir)
    pairs = shared.join(documents.withColumnRenamed("text", "source"), "doc_id").join(items.toDF("target_id", "target"), "target_id")
    return segments.best_windows(pairs, ["doc_id", "target_id"])


def passage_segments(spark, sf_dir: str) -> DataFrame:
    """The line of a document that has most in common with a benchmark item, for the same pairs."""
    documents, items, shared = _near_passages(spark, sf_dir)
    lines = documents.join(shared.select("doc_id").distinct(), "doc_id").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))
    return segments.best_segments(shared, lines, items)


def _lifecycle_events(spark, sf_dir: str) -> DataFrame:
    """Events as ledgers of their users: errors are no kind of change; every fifth user's tenth event is lost, some events come
    twice, under another number, or against another's number."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    good = F.col("event_type") != "error"
    number = F.when(good, F.row_number().over(Window.partitionBy("user_id", good).orderBy("event_id"))).otherwise(1)
    course, native = F.concat(F.lit("u"), F.col("user_id").cast("string")), F.col("event_type")
    kind = F.when(native == "error", "remark").when(native == "purchase", "decision").otherwise("stage")
    rows = e.select(
        course.alias("course"), F.format_string("e%09d", "event_id").alias("event_id"), number.alias("sequence"), item_id(course, F.lit("source"), native).alias("item_id"), F.lit("source").alias("platform"), native.alias("native_id"), kind.alias("kind"),
        F.when(kind == "stage", native).alias("stage"), F.when(kind == "decision", "approved").alias("decision"), F.lit("someone").alias("actor"), F.lit(None).cast("string").alias("note"), F.col("event_id").alias("k"), "user_id",
    )
    kept = rows.where(~((F.col("user_id") % 5 == 0) & (F.col("sequence") == 10) & (F.col("kind") != "remark")))
    k, valid = F.col("k"), kept.where("kind <> 'remark'")
    again = valid.where(k % 7 == 0)
    renumbered = valid.where(k % 11 == 0).withColumn("sequence", F.col("sequence") + 1000)
    against = valid.where(k % 13 == 0).withColumn("event_id", F.concat("event_id", F.lit("x")))
    return kept.unionByName(again).unionByName(renumbered).unionByName(against).drop("k", "user_id")


def _outcomes(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = settled(_lifecycle_events(spark, sf_dir))
    store = f"{ledger.work_folder(spark)}/lifecycle-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(events.schema).parquet(_folder(events))
    return events, lifecycle.settled_outcomes(lifecycle.append(stream, store))


def _folder(stored: DataFrame) -> str:
    return stored.inputFiles()[0].rsplit("/", 1)[0]


def ledger_outcomes(spark, sf_dir: str) -> DataFrame:
    """What became of each event, by course."""
    return _outcomes(spark, sf_dir)[1].groupBy("course", "outcome").agg(F.count("*").alias("events"), F.min("sequence").alias("first"), F.max("sequence").alias("last"))


def ledger_states(spark, sf_dir: str) -> DataFrame:
    """Items of the ledgers as their accepted events leave them; decisions on older evidence don't count."""
    events, rows = _outcomes(spark, sf_dir)
    value: Column = F.coalesce("stage", "decision")
    told = lifecycle.accepted_events(events, rows).select("item_id", "sequence", "kind", value.alias("value"), (F.col("sequence") % 3).alias("fingerprint"))
    items = events.where("kind <> 'remark'").select("item_id", "course", "native_id").distinct()
    state = history.ledger_state(told, items.select("item_id", (F.length("native_id") % 3).alias("fingerprint")))
    return items.join(state, "item_id").select("course", "native_id", "stage", "decision", "freshness", "events")


QUERIES = {f.__name__: f for f in (passage_windows, passage_segments, ledger_outcomes, ledger_states)}

_EVENTS = """rows AS (SELECT 'u' || user_id AS course, event_id AS k, user_id, event_type AS native, format('e{:09d}', event_id) AS id, CASE WHEN event_type <> 'error' THEN row_number() OVER (PARTITION BY user_id, event_type <> 'error' ORDER BY event_id) ELSE 1 END AS n FROM events),
kept AS (SELECT * FROM rows WHERE NOT (user_id % 5 = 0 AND n = 10 AND native <> 'error')), valid AS (SELECT * FROM kept WHERE native <> 'error'),
first AS (SELECT *, user_id % 5 = 0 AND n > 10 AS waits FROM valid),
told AS (SELECT course, n, CASE WHEN waits THEN 'HELD' ELSE 'ACCEPTED' END AS outcome FROM first UNION ALL SELECT course, 1, 'INVALID' FROM kept WHERE native = 'error' UNION ALL SELECT course, n, 'REPLAYED' FROM first WHERE k % 7 = 0
    UNION ALL SELECT course, n + 1000, 'DUPLICATE_ID' FROM first WHERE k % 11 = 0 UNION ALL SELECT course, n, 'CONFLICT' FROM first WHERE k % 13 = 0)"""
ORACLE_SQL = {
    "ledger_outcomes": f"WITH {_EVENTS} SELECT course, outcome, count(*) AS events, min(n) AS first, max(n) AS last FROM told GROUP BY ALL",
    "ledger_states": f"""WITH {_EVENTS}, i AS (SELECT DISTINCT course, native FROM valid),
        s AS (SELECT i.course, i.native, f.n, CASE WHEN f.native = 'purchase' THEN 'decision' WHEN f.native IS NOT NULL THEN 'stage' END AS kind, CASE WHEN f.native = 'purchase' THEN 'approved' ELSE f.native END AS value, f.n % 3 = length(i.native) % 3 AS now
          FROM i LEFT JOIN first f ON f.course = i.course AND f.native = i.native AND NOT f.waits)
        SELECT course, native AS native_id, coalesce(arg_max(value, n) FILTER (kind = 'stage'), 'inventory') AS stage, coalesce(arg_max(value, n) FILTER (kind = 'decision' AND now), 'open') AS decision,
          CASE WHEN count(n) > 0 AND count(*) FILTER (now) = 0 THEN 'changed' ELSE 'current' END AS freshness, count(n) AS events FROM s GROUP BY course, native""",
}
