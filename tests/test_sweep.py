"""Windows that hold an event, against a plain search of all of them."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import sessions as se
from tracelake.operators import sweep as sw

BASE = dt.datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp, project string"
WINDOWS = "session_id string, start_ts timestamp, end_ts timestamp, projects array<string>"


def at(seconds):
    return None if seconds is None else BASE + dt.timedelta(seconds=seconds)


def plain(events, windows, latest, any_project):
    out = {}
    for event, when, project in events:
        if when is None:
            continue
        inside = [(s, name, project is not None and project in (ps or [])) for name, s, e, ps in windows if s is not None and e is not None and s <= when <= e]
        own = [w for w in inside if w[2]]
        chosen = own or (inside if any_project else [])
        if chosen:
            out[event] = (max if latest else min)(chosen)[1:]
    return out


@pytest.mark.parametrize("latest, any_project", [(False, True), (True, False), (True, True)])
@pytest.mark.parametrize("per_range", [7, 50, 1 << 18])
def test_equals_a_search_of_all_windows(spark, latest, any_project, per_range):
    """Hot times, long, empty and backward windows, nulls, ties; ranges from tiny to one."""
    rnd = random.Random(per_range)
    hot = 500
    events = [(i, rnd.choice([hot, rnd.randrange(1000), rnd.randrange(1000)]), rnd.choice(["a", "b", "c", None])) for i in range(300)] + [(900, None, "a")]
    windows = []
    for i in range(80):
        start = rnd.choice([hot, rnd.randrange(1000), rnd.randrange(1000)])
        end = start + rnd.choice([0, 3, 40, 900, -5])
        windows.append((f"s{i:02}", start, end, rnd.choice([["a"], ["a", "b", "b"], [], None, [None, "c"]])))
    windows += [("year", -10_000, 10_000, ["b"]), ("twin", -10_000, 10_000, ["b"]), ("null", None, 5, ["a"]), ("open", 5, None, ["a"])]
    e = spark.createDataFrame([(i, at(t), p) for i, t, p in events], EVENTS)
    w = spark.createDataFrame([(n, at(s), at(t), p) for n, s, t, p in windows], WINDOWS)
    got = {r["event_id"]: (r["session_id"], r["same"]) for r in sw.first_windows(e, w, latest, any_project, per_range).collect()}
    assert got == plain(events, windows, latest, any_project)


def test_a_hot_instant_is_dealt_over_parts_and_long_windows_cost_few_rows(spark):
    """A third of all events and windows at one time: no part holds more than a few ranges' rows."""
    e = spark.createDataFrame([(i, at(50 if i % 3 else i), "a") for i in range(3000)], EVENTS)
    w = spark.createDataFrame([(f"s{i}", at(50 if i % 3 == 0 else i), at(4000), ["a"]) for i in range(900)], WINDOWS)
    found = sw.first_windows(e, w, per_range=100)
    sizes = found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == found.count() > 2000 and max(sizes) < 400
    assert max(len(sw._nodes(x, y)) for x in range(0, 300, 7) for y in range(x, 300)) <= 2 * 9
    covered = lambda x, y: sorted(p for n in sw._nodes(x, y) for p in range((n % sw.NODE) << (n // sw.NODE), ((n % sw.NODE) + 1) << (n // sw.NODE)))
    assert all(covered(x, y) == list(range(x, y + 1)) for x in range(40) for y in range(x, 40))


def test_empty_tables_and_repeated_ids(spark):
    none, some = spark.createDataFrame([], EVENTS), spark.createDataFrame([(1, at(5), "a"), (1, at(50), "a"), (2, at(5), None)], EVENTS)
    w, no = spark.createDataFrame([("s", at(0), at(10), ["a"])], WINDOWS), spark.createDataFrame([], WINDOWS)
    assert se.attach_orphans(none, w).count() == se.attach_orphans(some, no).count() == se.attach_orphans(none, no).count() == 0
    assert [tuple(r) for r in se.attach_orphans(some, w).collect()] == [(1, "s")]


def test_overlaps_of_a_busy_cell_are_dealt_over_tasks(spark, monkeypatch):
    for name, n in (("CHUNK", 64), ("TASK_PAIRS", 1 << 12)):
        monkeypatch.setattr(se, name, n, raising=False)
    draw = random.Random(7)
    spans = [(f"s{i}", a := draw.randrange(0, 400), a + draw.choice((0, 0, 5, 60, 300))) for i in range(400)]
    rows = spark.createDataFrame(spans, "session_id string, lo long, hi long").select("session_id", F.timestamp_seconds("lo").alias("start_ts"), F.timestamp_seconds("hi").alias("end_ts"))
    pairs = se.session_overlaps(rows, cell_seconds=500)
    expected = sorted((min(a[0], b[0]), max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2])) for i, a in enumerate(spans) for b in spans[i + 1 :] if a[1] < b[2] and b[1] < a[2])
    found = pairs.select("a", "b", F.unix_seconds("overlap_start"), F.unix_seconds("overlap_end"))
    assert sorted(tuple(r) for r in found.collect()) == expected
    assert len({r["part"] for r in pairs.select(F.spark_partition_id().alias("part")).distinct().collect()}) > 20  # bytes would make one task of them


def test_pairs_come_in_an_order_that_takes_few_bytes(spark, monkeypatch):
    """Of a start's pairs with a chunk of runs the ends rise, and mostly one of the two ids stays."""
    for name, n in (("CHUNK", 256), ("RANGE_ROWS", 64)):
        monkeypatch.setattr(se, name, n, raising=False)
    draw = random.Random(5)
    spans = [(f"s{i:03}", a := draw.randrange(0, 400), a + draw.choice((1, 5, 60, 300))) for i in range(600)]
    rows = spark.createDataFrame(spans, "session_id string, lo long, hi long").select("session_id", F.timestamp_seconds("lo").alias("start_ts"), F.timestamp_seconds("hi").alias("end_ts"))
    settings = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    kept = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name in settings:
            spark.conf.set(name, "-1")
        found = [tuple(r) for r in se.session_overlaps(rows, cell_seconds=100).select("a", "b", F.unix_seconds("overlap_start"), F.unix_seconds("overlap_end")).collect()]
    finally:
        for name, value in kept.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert sorted(found) == sorted((min(a[0], b[0]), max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2])) for i, a in enumerate(spans) for b in spans[i + 1 :] if a[1] < b[2] and b[1] < a[2])
    steps = list(zip(found, found[1:]))
    assert sum(x[3] > y[3] for x, y in steps if x[2] == y[2]) < len(steps) / 20
    assert sum(x[0] != y[0] and x[1] != y[1] for x, y in steps) < len(steps) / 4
