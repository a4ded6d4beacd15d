import json
import hashlib

import pytest

from veriframe.streaming import ledger, lifecycle

SCHEMA = "course string, event_id string, sequence int, item_id string, platform string, native_id string, kind string, stage string, decision string, actor string, note string"


def event(course, id, sequence, kind="stage", value="review", native="n1", item=None, note=None):
    item = item or "item-" + hashlib.sha256(json.dumps([course, "source", native], separators=(",", ":")).encode()).hexdigest()
    return (course, id, sequence, item, "source", native, kind, value if kind == "stage" else None, value if kind == "decision" else None, "someone", note)


@pytest.fixture
def feed(spark, tmp_path):
    """feed(rows) takes one more file into the same ledgers and returns all outcomes so far."""
    n = 0

    def run(rows, **settings):
        nonlocal n
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        n += 1
        stream = ledger.read_stream(spark, f"{tmp_path}/in/*")
        return lifecycle.append(stream, str(tmp_path / "store"), **settings)

    return run


def seen(df):
    return sorted((r["course"], r["event_id"], r["sequence"], r["outcome"]) for r in df.collect())


def test_replays_conflicts_and_invalid_events_come_out_beside_the_accepted(feed):
    got = seen(feed([
        event("c", "a", 1), event("c", "b", 2, "decision", "approved"), event("c", "b", 2, "decision", "approved"), event("c", "a", 3), event("c", "z", 2),
        event("c", "bad", 3, item="item-other"), event("c", "worse", 3, "no kind"), event("d", "a", 1), event("c", "e", 99),
    ], most=50))
    assert got == [
        ("c", "a", 1, "ACCEPTED"), ("c", "a", 3, "DUPLICATE_ID"), ("c", "b", 2, "ACCEPTED"), ("c", "b", 2, "REPLAYED"), ("c", "bad", 3, "INVALID"), ("c", "e", 99, "FULL"),
        ("c", "worse", 3, "INVALID"), ("c", "z", 2, "CONFLICT"), ("d", "a", 1, "ACCEPTED"),
    ]


def test_a_gap_is_filled_after_a_restart_from_state(feed, spark):
    first = feed([event("c", "a", 1), event("c", "c", 3), event("c", "d", 4)])
    assert seen(first) == [("c", "a", 1, "ACCEPTED"), ("c", "c", 3, "HELD"), ("c", "d", 4, "HELD")]
    second = feed([event("c", "b", 2), event("c", "c", 3), event("c", "x", 4)])  # another run with the same store
    new = seen(second.where("batch > 0"))
    assert new == [("c", "b", 2, "ACCEPTED"), ("c", "c", 3, "ACCEPTED"), ("c", "c", 3, "REPLAYED"), ("c", "d", 4, "ACCEPTED"), ("c", "x", 4, "CONFLICT")]
    assert sum(o == "HELD" for *_, o in seen(lifecycle.settled_outcomes(second))) == 0
    kept = lifecycle.accepted_events(spark.createDataFrame([event("c", "a", 1), event("c", "b", 2), event("c", "x", 4)], SCHEMA), second)
    assert sorted(r["event_id"] for r in kept.collect()) == ["a", "b"]


def test_events_that_waited_too_long_leave_and_free_their_number(feed):
    feed([event("c", "a", 1), event("c", "c", 3)], patience=1)
    later = feed([event("other", "q", 1)], patience=1)  # time has passed: the timer goes off
    assert ("c", "c", 3, "GAP") in seen(later)
    last = feed([event("c", "b", 2), event("c", "new", 3)], patience=1)
    assert {("c", "b", 2, "ACCEPTED"), ("c", "new", 3, "ACCEPTED")} <= set(seen(last))
    assert ("c", "c", 3, "HELD") not in seen(lifecycle.settled_outcomes(last))
