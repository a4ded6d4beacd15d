"""Snapshots, ledgers and sequences: what changed, what is current, what belongs together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Full outer join of two snapshots: BEFORE_ONLY, AFTER_ONLY, CHANGED or STABLE, with the changed fields. A
    field that one side did not observe has not changed."""
    a = before.select(key, *(F.col(f).alias(f"{f}_before") for f in fields), F.lit(True).alias("in_before"))
    b = after.select(key, *(F.col(f).alias(f"{f}_after") for f in fields), F.lit(True).alias("in_after"))
    both = a.join(b, key, "full_outer")
    changed = F.array_compact(F.array(*(F.when(F.col(f"{f}_before") != F.col(f"{f}_after"), F.lit(f)) for f in fields)))
    kind = (
        F.when(F.col("in_before").isNull(), "AFTER_ONLY")
        .when(F.col("in_after").isNull(), "BEFORE_ONLY")
        .when(F.size(changed) > 0, "CHANGED")
        .otherwise("STABLE")
    )
    return both.select(key, kind.alias("kind"), F.array_join(F.when(F.col("in_before") & F.col("in_after"), changed), ",").alias("fields"))


def repeated_exports(audits: DataFrame, order: Sequence[Column], same: Sequence[str], differs: str) -> DataFrame:
    """Rows that follow a row of the same package (in the order of all rows of that package) with the next
    generation, equal ``same`` and another ``differs``."""
    w = Window.partitionBy("package_id").orderBy(*order)
    prior = {f"prior_{c}": F.lag(c).over(w) for c in ("id", "generation", differs, *same)}
    rows = audits.withColumns(prior).where("prior_id is not null")
    equal = F.lit(True)
    for c in same:
        equal = equal & F.col(c).eqNullSafe(F.col(f"prior_{c}"))
    again = (F.col("generation") == F.col("prior_generation") + 1) & equal & (F.col(differs) != F.col(f"prior_{differs}"))
    return rows.where(again).select("package_id", F.col("prior_id").alias("previous"), "id")


def ledger_state(events: DataFrame, current: DataFrame) -> DataFrame:
    """Fold of an append-only ledger: last stage of any kind, last decision on the current fingerprint, freshness.
    events(item_id, sequence, kind, value, fingerprint), current(item_id, fingerprint). Partial aggregates only."""
    now = current.select("item_id", F.col("fingerprint").alias("current_fingerprint"))
    rows = now.join(events, "item_id", "left")
    on_it = F.col("fingerprint") == F.col("current_fingerprint")
    return rows.groupBy("item_id").agg(
        F.coalesce(F.max_by(F.when(F.col("kind") == "stage", F.col("value")), F.when(F.col("kind") == "stage", F.col("sequence"))), F.lit("inventory")).alias("stage"),
        F.coalesce(F.max_by(F.when((F.col("kind") == "decision") & on_it, F.col("value")), F.when((F.col("kind") == "decision") & on_it, F.col("sequence"))), F.lit("open")).alias("decision"),
        F.when((F.count("sequence") > 0) & (F.count(F.when(on_it, 1)) == 0), "changed").otherwise("current").alias("freshness"),
        F.count("sequence").alias("events"),
    )


def interval_union(spans: DataFrame, key: str) -> DataFrame:
    """Per key: calls, summed span length and the length of the union of the spans (start, stop in one unit)."""
    before = Window.partitionBy(key).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("stop").over(before)
    new = F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), F.coalesce(reach, F.col("start"))))
    return spans.withColumn("new", new).groupBy(key).agg(
        F.count("*").alias("calls"), F.sum(F.col("stop") - F.col("start")).alias("summed"), F.sum("new").alias("covered"), F.max(F.col("stop") - F.col("start")).alias("slowest")
    )


def islands(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Runs of consecutive rows with one value: (keys, island, value, first, last, n)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    begins = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = rows.withColumn("begins", begins)
    marked = marked.withColumn("island", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "island", value).agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n"))


def carried_forward(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Each of ``values`` as last seen up to the row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({name: F.last(c, ignorenulls=True).over(w) for name, c in values.items()})


def within_budget(rows: DataFrame, keys: Sequence[str], order: Sequence[str], cost: str, budget: float) -> DataFrame:
    """``rows`` with ``kept``: whether what came before left room for them."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("kept", F.coalesce(F.sum(cost).over(before), F.lit(0)) + F.col(cost) <= budget)


def chunk_contiguity(chunks: DataFrame, key: str, index: str) -> DataFrame:
    """Validity of chunked payloads: indexes 0..n-1, each once."""
    n, top = F.count("*"), F.max(index)
    state = (
        F.when(F.count_distinct(index) < n, "DUPLICATE_INDEX")
        .when((F.min(index) != 0) | (top != n - 1), "NOT_CONTIGUOUS")
        .otherwise("COMPLETE")
    )
    return chunks.groupBy(key).agg(n.alias("chunks"), state.alias("state"))


def freshness(edits: DataFrame, reports: DataFrame, key: str) -> DataFrame:
    """Latest edit per key and whether a later report with another input hash covers it. edits(key, edited_at),
    reports(key, captured_at, input_hash); a report without capture time covers nothing."""
    last = edits.groupBy(key).agg(F.max("edited_at").alias("edited_at"))
    rows = last.join(reports, key, "left")
    at = F.col("captured_at")
    old = F.max_by(F.when(at <= F.col("edited_at"), F.col("input_hash")), F.when(at <= F.col("edited_at"), at))
    new = F.max_by(F.when(at > F.col("edited_at"), F.col("input_hash")), F.when(at > F.col("edited_at"), at))
    out = rows.groupBy(key, "edited_at").agg(old.alias("old"), new.alias("new"))
    covered = F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("old"))
    return out.select(key, "edited_at", F.when(covered, "CURRENT").otherwise("PENDING").alias("state"))


def multiset_difference(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose counts differ: MISSING, UNEXPECTED or COUNT."""
    e = expected.groupBy(*keys).agg(F.count("*").alias("expected"))
    o = observed.groupBy(*keys).agg(F.count("*").alias("observed"))
    both = e.join(o, list(keys), "full_outer").fillna(0, ["expected", "observed"])
    kind = F.when(F.col("observed") == 0, "MISSING").when(F.col("expected") == 0, "UNEXPECTED").otherwise("COUNT")
    return both.where("expected != observed").withColumn("kind", kind)
