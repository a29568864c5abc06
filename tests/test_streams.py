"""Streams with keyed state: order, late rows, and state that doesn't grow."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators.common import shared_path
from tidemark.streaming import stateful
from tidemark.streaming import windows as W

START = dt.datetime(2024, 1, 1)
MINUTE = 60_000_000


def streamed(spark, batches, schema):
    folder = shared_path(spark, "batches")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def state_rows(told):
    return [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in told]


def dropped(told):
    return sum(s["numRowsDroppedByWatermark"] for p in told for s in p["stateOperators"])


EVENTS = "event_id long, ts timestamp, project string, person long, commenter long, merged boolean"


def events(n, seed):
    rng = random.Random(seed)
    return [(i, START + dt.timedelta(minutes=rng.randrange(n // 2)), "p" if rng.random() < 0.8 else "q", rng.randrange(12), rng.randrange(12), rng.random() < 0.4) for i in range(n)]


def flags_by_hand(rows, minutes):
    out = {}
    for e in rows:
        before = [b for b in rows if b[2] == e[2] and (b[1], b[0]) < (e[1], e[0]) and (minutes is None or b[1] > e[1] - dt.timedelta(minutes=minutes))]
        out[e[0], "first_time"] = all(b[3] != e[3] for b in before)
        out[e[0], "external"] = e[4] != e[3] and not any(b[3] == e[4] and b[5] for b in before)
    return out


def test_flags_of_batches_out_of_order(spark):
    rows = events(300, 1)
    shuffled = sorted(rows, key=lambda r: (r[1] + dt.timedelta(minutes=random.Random(r[0]).randrange(20))))
    batches = [shuffled[i : i + 60] for i in range(0, 300, 60)] + [[(-1, START + dt.timedelta(days=9), "p", -1, -1, False)]]
    for minutes in (None, 15):
        told = []
        flags = stateful.contributor_flags(streamed(spark, batches, EVENTS), "60 minutes", minutes and minutes * MINUTE)
        got = {(r.event_id, r.flag): r.value for r in W.drained(flags, "flags", told=told).where("event_id >= 0").collect()}
        assert got == flags_by_hand(rows, minutes)
        assert dropped(told) == 0


def test_late_rows_are_dropped_and_told(spark):
    ordered = [(i, START + dt.timedelta(minutes=10 * i), "p", 1, 2, True) for i in range(6)]
    late = (99, START + dt.timedelta(minutes=1), "p", 3, 4, True)
    batches = [ordered[:5], ordered[5:], [late], [(-1, START + dt.timedelta(days=9), "p", -1, -1, False)]]
    told = []
    got = W.drained(stateful.contributor_flags(streamed(spark, batches, EVENTS), "5 minutes"), "flags", told=told)
    assert {r.event_id for r in got.collect()} == set(range(6))
    assert dropped(told) == 2  # the row as contribution and as comment


def test_state_ends_with_its_window(spark):
    days = [[(100 * d + i, START + dt.timedelta(days=d, minutes=i), "p", 1000 * d + i, -5, True) for i in range(40)] for d in range(6)]
    batches = [*days, [(-1, START + dt.timedelta(days=99), "p", -1, -1, False)]]
    told, kept = [], []
    W.drained(stateful.contributor_flags(streamed(spark, batches, EVENTS), "1 minutes", 30 * MINUTE), "flags", told=told)
    W.drained(stateful.contributor_flags(streamed(spark, batches, EVENTS), "1 minutes"), "flags", told=kept)
    some, every = state_rows(told), state_rows(kept)
    assert max(some[4:]) <= max(some[:4]) and some[-1] <= 40  # later days don't add up
    assert every[-1] >= 240
    counts = []
    stream = streamed(spark, batches, EVENTS).withColumn("user_id", F.col("person"))
    got = W.drained(stateful.earlier_counts(stream, 30 * MINUTE, "1 minutes"), "counts", told=counts)
    assert got.where("event_id >= 0").count() == 240
    assert state_rows(counts)[-1] <= 40


def test_earlier_counts_by_hand(spark):
    rows = events(400, 2)
    batches = [sorted(rows, key=lambda r: r[1])[i::3] for i in range(3)] + [[(-1, START + dt.timedelta(days=9), "p", -1, -1, False)]]
    stream = streamed(spark, batches, EVENTS).withColumn("user_id", F.col("person"))
    got = {r.event_id: r.n for r in W.drained(stateful.earlier_counts(stream, 20 * MINUTE, "300 minutes"), "counts").collect()}
    for e in rows:
        want = sum(b[3] == e[3] and (b[1], b[0]) < (e[1], e[0]) and b[1] > e[1] - dt.timedelta(minutes=20) for b in rows)
        assert got[e[0]] == want


def test_joined_streams_drop_state(spark):
    at = lambda m: START + dt.timedelta(minutes=m)
    orders = [[(i, at(10 * i), "F") for i in range(10 * b, 10 * b + 10)] for b in range(5)] + [[(-1, at(9**6), "")]]
    lines = [[(i, at(10 * i + 3 * n), n, "A") for i in range(10 * b, 10 * b + 10) if i % 3 for n in range(1, 5)] for b in range(5)] + [[(-2, at(9**6), 0, "")]]
    told = []
    both = stateful.merged_streams(streamed(spark, orders, "o_orderkey long, ordered timestamp, o_orderstatus string"), streamed(spark, lines, "l_orderkey long, shipped timestamp, l_linenumber int, l_returnflag string"), "1 minutes", "1 minutes", "10 MINUTES")
    got = sorted((r.o_orderkey, r.l_linenumber or 0) for r in W.drained(both, "both", told=told).where("o_orderkey >= 0").collect())
    assert got == sorted((i, n) for i in range(50) for n in ((1, 2, 3) if i % 3 else (0,)))
    assert max(state_rows(told)) < 150 and state_rows(told)[-1] < 10


def test_flags_of_many_people_and_several_files(spark, monkeypatch):
    """More people than are looked up one by one, a slice in several files, and no call of state for each row."""
    rng = random.Random(7)
    rows = [(i, START + dt.timedelta(minutes=rng.randrange(600)), "p", rng.randrange(2500), rng.randrange(2500), rng.random() < 0.6) for i in range(3000)]
    monkeypatch.setattr(W, "ROWS_A_TASK", 250)
    last = spark.createDataFrame([(-1, START + dt.timedelta(days=99), "p", -1, -1, False)], EVENTS)
    stream, late = W.arriving(spark.createDataFrame(rows, EVENTS), "ts", 4, last)
    for minutes in (None, 90):
        told = []
        got = {(r.event_id, r.flag): r.value for r in W.drained(stateful.contributor_flags(stream, late, minutes and minutes * MINUTE), "flags", told=told).where("event_id >= 0").collect()}
        assert got == flags_by_hand(rows, minutes) and dropped(told) == 0
        assert len([p for p in told if p["numInputRows"]]) <= 7  # a batch takes as many files as a slice has
        waiting = max(state_rows(told)[:2])
        assert waiting < 3000  # packed: not a row of state for each that waits
