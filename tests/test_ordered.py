"""Steps in a key's order, with keys split over several parts, against a plain loop."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import facets as fa
from tracelake.operators import ordered as od
from tracelake.operators import sessions as se

BASE = dt.datetime(2024, 1, 1)
SCHEMA = "session_id string, ts timestamp, event_id long, k string"


def made(n=400):
    """A session with half of all rows, one without a name, ties in time, and a null time."""
    rnd = random.Random(5)
    names = ["hot"] * 5 + [None] * 2 + ["a", "b", "c"]
    rows = [(rnd.choice(names), BASE + dt.timedelta(seconds=rnd.choice([900, rnd.randrange(4000)])), i, rnd.choice("xy")) for i in range(n)]
    return [*rows, ("hot", None, n, "x")]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or BASE, r[2]))


@pytest.fixture(params=[30, 1_000_000])
def limit(request, monkeypatch):
    monkeypatch.setattr(od, "HOT_ROWS", request.param)
    return request.param


def test_segments_counts_and_parents(spark, limit):
    rows = made()
    segments, counts, parents = {}, {}, {}
    for name in {r[0] for r in rows}:
        before, segment = None, 0
        for i, r in enumerate(in_order([r for r in rows if r[0] == name])):
            gap = (r[1] - before[1]).total_seconds() if before and before[1] and r[1] else None
            segment += gap is not None and gap > 60
            segments[r[2]], counts[r[2]] = segment, i + 1
            if gap is not None and gap <= 60:
                parents[r[2]] = before[2]
            before = r
    e = spark.createDataFrame(rows, SCHEMA)
    assert {r["event_id"]: r["segment"] for r in se.segment(e, "session_id", 60).collect()} == segments
    assert {r["event_id"]: r["n_so_far"] for r in se.session_event_count(e).collect()} == counts
    assert {r["event_id"]: r["parent_event_id"] for r in se.link_parents(e).collect()} == parents
    assert se.segment(e, "session_id", 60).columns == [*e.columns, "segment"]


def test_groups_over_edges(spark, limit):
    rows = [r for r in made() if r[1] is not None]
    want, before = {}, None
    for r in in_order(rows):
        if before is None or before[3] != r[3] or (r[1] - before[1]).total_seconds() >= 20:
            head = r[2]
        want[r[2]], before = head, r
    got = fa.event_groups(spark.createDataFrame(rows, SCHEMA), F.col("k"), 20)
    assert {r["event_id"]: r["group_id"] for r in got.collect()} == want


def test_one_group_longer_than_many_parts(spark):
    rows = [("s", BASE + dt.timedelta(seconds=i), i, "x") for i in range(200)]
    got = fa.event_groups(spark.createDataFrame(rows, SCHEMA), F.col("k"), 20, hot_rows=10).collect()
    assert {r["group_id"] for r in got} == {0}


def test_parts_stay_small_and_in_order(spark):
    rows = [("s", BASE + dt.timedelta(seconds=i // 2), i, "x") for i in range(1000)] + [("t", BASE, 5000 + i, "x") for i in range(9)]
    dealt = od.deal(spark.createDataFrame(rows, SCHEMA), "session_id", ("ts", "event_id"), 100)
    parts = dealt.where("session_id = 's'").groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi")).orderBy("_part").collect()
    assert len(parts) >= 8 and max(p["n"] for p in parts) <= 200
    assert all(a["hi"] < b["lo"] for a, b in zip(parts, parts[1:]))
    assert {r["_part"] for r in dealt.where("session_id = 't'").collect()} == {0}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert se.segment(none, "session_id", 60).collect() == [] and fa.event_groups(none, F.col("k")).collect() == []
