"""Ledgers of lifecycle events as a stream: each course's events are taken in order of their sequence numbers, without gaps.

Keyed state holds, for a course, the number that comes next, the ids it has seen and the events that wait for an earlier one.
Nothing is dropped in silence: every event comes out with an outcome, rejected ones beside the accepted. Events that waited longer than
``patience`` for an earlier one leave as GAP when their timer goes off, so state holds no orphans and the number is free again.
A run that goes on from the same store goes on from its state. One course is one sequence and therefore one task's work, with a look into its
state for each event; ids of a course stay in the state store, on disk.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veriframe.operators.scope import item_id

# What an event may be, its stages and decisions.
KINDS = ("stage", "decision", "membership", "mapping-confirmed", "mapping-rejected", "transformation")
PLATFORMS = ("source", "target")
MOST_EVENTS = 20_000
PATIENCE_MS = 24 * 3600 * 1000
OUTCOMES = ("ACCEPTED", "HELD", "REPLAYED", "DUPLICATE_ID", "CONFLICT", "INVALID", "FULL", "GAP")
RESULT = "course string, event_id string, sequence long, outcome string"
#: State on disk; timers go off with the next events, for with timers a run that takes what is there would go on with empty batches.
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def valid_event(platforms: tuple[str, ...] = PLATFORMS) -> Column:
    """Whether an event names its item rightly and records one kind of change: columns course, event_id, sequence, item_id,
    platform, native_id, kind, stage, decision, actor, note."""
    said = lambda c, most: F.col(c).isNotNull() & (F.trim(c) != "") & (F.length(c) <= most)
    only = lambda c: F.col(c).isNull() == (F.col("kind") != c)
    good = (
        said("course", 120) & said("event_id", 120) & said("native_id", 2000) & said("actor", 320) & (F.coalesce(F.length("note"), F.lit(0)) <= 4000) & (F.col("sequence") >= 1)
        & F.col("kind").isin(*KINDS) & F.col("platform").isin(*platforms) & (F.col("item_id") == item_id(F.col("course"), F.col("platform"), F.col("native_id"))) & only("stage") & only("decision")
    )
    return F.coalesce(good, F.lit(False))


class _Sequence(StatefulProcessor):
    def __init__(self, most: int, patience: int):
        self.most, self.patience = most, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "n long")
        self.held = handle.getMapState("held", "sequence long", "event_id string")
        self.ids = handle.getMapState("ids", "event_id string", "sequence long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        found = pd.concat(list(rows)).sort_values(["sequence", "event_id"], kind="stable")  # of one course in one batch
        wanted = self.next.get()[0] if self.next.exists() else 1
        out = []
        for event, sequence, good in zip(found["event_id"], found["sequence"], found["good"], strict=True):
            if not good:
                out.append((event, sequence, "INVALID"))
            elif self.ids.containsKey((event,)):
                out.append((event, sequence, "REPLAYED" if self.ids.getValue((event,))[0] == sequence else "DUPLICATE_ID"))
            elif sequence < wanted or self.held.containsKey((sequence,)):
                out.append((event, sequence, "CONFLICT"))
            elif sequence > self.most:
                out.append((event, sequence, "FULL"))
            else:
                self.ids.updateValue((event,), (sequence,))
                if sequence > wanted:
                    self.held.updateValue((sequence,), (event,))
                    out.append((event, sequence, "HELD"))
                    continue
                out.append((event, sequence, "ACCEPTED"))
                wanted = sequence + 1
                while self.held.containsKey((wanted,)):
                    out.append((self.held.getValue((wanted,))[0], wanted, "ACCEPTED"))
                    self.held.removeKey((wanted,))
                    wanted += 1
        self.next.update((wanted,))
        self._timer(timerValues)
        yield self._rows(key, out)

    def _timer(self, timerValues) -> None:
        """One timer while events wait, none else."""
        waiting, timers = next(iter(self.held.keys()), None) is not None, list(self.handle.listTimers())
        if waiting and not timers:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
        for t in () if waiting else timers:
            self.handle.deleteTimer(t)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        late = sorted((s[0], e[0]) for s, e in self.held.iterator())
        for _, event in late:
            self.ids.removeKey((event,))
        self.held.clear()
        yield self._rows(key, [(event, sequence, "GAP") for sequence, event in late])

    def close(self) -> None:
        pass

    @staticmethod
    def _rows(key, out: list[tuple]):
        import pandas as pd

        rows = pd.DataFrame(out, columns=["event_id", "sequence", "outcome"])
        rows.insert(0, "course", key[0])
        return rows.astype({"sequence": "int64"})


def sequenced(events: DataFrame, most: int = MOST_EVENTS, patience: int = PATIENCE_MS, platforms: tuple[str, ...] = PLATFORMS) -> DataFrame:
    """The outcome of each of a stream of events: ACCEPTED in sequence (held ones once they are), HELD for an earlier one, REPLAYED (the
    same id and number again), DUPLICATE_ID (the id with another number), CONFLICT (the number is another event's), INVALID, FULL, GAP."""
    rows = events.select(F.coalesce("course", F.lit("")).alias("course"), F.coalesce("event_id", F.lit("")).alias("event_id"), F.coalesce(F.col("sequence").cast("long"), F.lit(0)).alias("sequence"), valid_event(platforms).alias("good"))
    schema = T.StructType.fromDDL(RESULT)
    return rows.groupBy("course").transformWithStateInPandas(_Sequence(most, patience), schema, "Append", "ProcessingTime")


def append(events: DataFrame, store: str, **settings) -> DataFrame:
    """Takes what the stream ``events`` has now into the ledgers kept in the folder ``store``, and returns all outcomes so far, with the
    number of the batch. The same store, given again, goes on where it was."""
    spark: SparkSession = events.sparkSession
    before = {name: spark.conf.get(name, None) for name in _SETTINGS}

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{store}/out/number={number}")  # a repeated batch writes the same place

    try:
        for name, value in _SETTINGS.items():
            spark.conf.set(name, value)
        sink = sequenced(events, **settings).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{store}/state")
        sink.trigger(availableNow=True).start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return outcomes(spark, store)


def outcomes(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.option("basePath", f"{store}/out").schema(f"{RESULT}, batch int").parquet(f"{store}/out/*")


def settled_outcomes(rows: DataFrame) -> DataFrame:
    """``outcomes`` without the waiting of events that have since been accepted or given up."""
    done = rows.where(F.col("outcome").isin("ACCEPTED", "GAP")).groupBy("course", "event_id").agg(F.max("batch").alias("done"))
    joined = rows.join(done, ["course", "event_id"], "left")
    return joined.where((F.col("outcome") != "HELD") | F.col("done").isNull() | (F.col("done") < F.col("batch"))).drop("done")


def accepted_events(events: DataFrame, rows: DataFrame) -> DataFrame:
    """``events`` that were accepted, once each."""
    good = rows.where("outcome = 'ACCEPTED'").select("course", "event_id", "sequence").distinct()
    return events.join(good, ["course", "event_id", "sequence"]).dropDuplicates(["course", "event_id"])
