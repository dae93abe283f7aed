"""Stretches of activity on a shuffled feed against the batch, batch by batch and after repeats."""

import datetime as dt
import random

from tracelake.operators import index as ix
from tracelake.operators import sessions as se
from tracelake.sources.batches import read_batches
from tracelake.streaming import late

FIELDS = "event_id long, session_id string, ts timestamp"


def rows_of(frame):
    return sorted((r["session_id"] or "", r["start_ts"], r["end_ts"], r["n_events"]) for r in frame.collect())


def test_late_rows_are_stitched_in(spark, tmp_path):
    rnd, base, path = random.Random(3), dt.datetime(2024, 1, 1), str(tmp_path / "segments")
    events = [(i, rnd.choice(["a", "b", None]), base + dt.timedelta(seconds=rnd.choice([0, 60 * rnd.randrange(2000)]))) for i in range(200)] + [(999, "a", None)]
    sink = late.segment_sink(path)
    ordered = sorted(events[:-1], key=lambda e: e[2])
    feed = [ordered[:80], [], [*ordered[120:], events[-1]], ordered[80:120][::-1]]
    for number, part in enumerate(feed):
        for _ in range(2):  # each batch comes twice
            sink(spark.createDataFrame(part, FIELDS), number)
        if number == 1:
            assert read_batches(spark, f"{path}/late").count() == 0
    seen = spark.createDataFrame(events[:-1], FIELDS).na.fill("", ["session_id"])
    assert rows_of(late.segments_with_late(spark, path)) == rows_of(se.work_segments(seen))
    assert 0 < read_batches(spark, f"{path}/late").count() <= 40
    assert read_batches(spark, f"{path}/closed").count() > 10
    assert len(list((tmp_path / "segments/open/none").iterdir())) == 2


def test_only_rows_in_time_close_like_the_window(spark, tmp_path):
    """A row exactly at the gap's end continues a stretch; one behind the watermark by less than the delay is no late one."""
    base, path = dt.datetime(2024, 1, 1), str(tmp_path / "s")
    at = lambda i, s: (i, "a", base + dt.timedelta(seconds=s))
    sink = late.segment_sink(path)
    for number, part in enumerate([[at(1, 0), at(2, 900)], [at(3, 1800), at(4, 5000)], [at(5, 4400), at(6, 4399)]]):
        sink(spark.createDataFrame(part, FIELDS), number)
    assert [r["start_ts"] for r in read_batches(spark, f"{path}/late").collect()] == [base + dt.timedelta(seconds=4399)]
    got = [((s - base).seconds, (e - base).seconds, n) for _, s, e, n in rows_of(late.segments_with_late(spark, path))]
    assert got == [(0, 1800, 3), (4399, 5000, 3)]


def test_prefixes_meet_only_their_terms(spark):
    terms = spark.createDataFrame([("abc", 3), ("ab", 9), ("abd", 3), ("abcde", 1), ("b", 2), ("é1", 1)], "term string, df long")
    asked = spark.createDataFrame([("ab",), ("ABC!",), ("a",), ("zzz",), (None,)], "prefix string")
    got = {(r["prefix"], r["term"], r["rank"]) for r in ix.autocomplete(terms, asked, 2).collect()}
    assert got == {("ab", "abc", 1), ("ab", "abd", 2), ("abc", "abcde", 1)}
    wild = spark.createDataFrame([(1, "ab* b"), (2, "abcd*"), (3, "zz* a*")], "query_id long, query string")
    found = {(r["query_id"], r["term"]) for r in ix.expand_wildcards(wild, terms.select("term")).collect()}
    assert found == {(1, "ab"), (1, "abc"), (1, "abd"), (1, "abcde"), (1, "b"), (2, "abcde"), (3, "zz"), (3, "a")}
    assert ix.autocomplete(terms, asked.limit(0)).count() == 0
