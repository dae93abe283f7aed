import datetime as dt
import json
import os

import numpy as np
from pyspark.sql import functions as F

from tracelake.functions.classify import high_signal
from tracelake.operators import index as ix
from tracelake.operators import sessions as se
from tracelake.plans import stream_queries as sq
from tracelake.sources import logs as lo
from tracelake.sources.batches import read_batches, write_batch
from tracelake.streaming import streams as st

FIELDS = "event_id string, ts timestamp, session_id string, type string, text string, doc_id long"


def folder(tmp_path, batches):
    d = tmp_path / "in"
    d.mkdir()
    for i, rows in enumerate(batches):
        file = d / f"{i:03}.json"
        file.write_text("\n".join(json.dumps(r) for r in rows) + "\n{broken")
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(d)


def feed(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [{"event_id": f"e{i}", "ts": (base + dt.timedelta(seconds=s)).isoformat(), "session_id": k, "type": t, "text": f"alpha word{i % 3}", "doc_id": i} for i, (s, k, t) in enumerate([(0, "a", "x"), (30, "a", "bridge_ping_sent"), (95, "a", "x"), (96, "b", "x"), (120, "b", "x"), (4000, "a", "x"), (90000, "z", "x")])]
    path = folder(tmp_path, [rows[:3], rows[3:5], [*rows[4:6]], rows[6:]])
    batch = spark.createDataFrame([(r["event_id"], dt.datetime.fromisoformat(r["ts"]), r["session_id"], r["type"], r["text"], r["doc_id"]) for r in rows], FIELDS)
    return st.stream_logs(spark, path, FIELDS, 1), batch


def finish(spark, tmp_path, frame, name, mode="append"):
    out = str(tmp_path / name)
    st.run_available(frame, st.appender(out), str(tmp_path / f"{name}-cp"), mode).awaitTermination()
    return read_batches(spark, out)


def test_feed_dedupe_and_index(spark, tmp_path):
    stream, batch = feed(spark, tmp_path)
    live = finish(spark, tmp_path, st.live_feed(st.stream_dedupe(stream)), "live")
    assert sorted(r["event_id"] for r in live.collect()) == sorted(r["event_id"] for r in high_signal(batch).collect())
    st.run_available(stream.select("doc_id", "text"), st.index_sink(str(tmp_path / "ix")), str(tmp_path / "ix-cp")).awaitTermination()
    rows = lambda i: sorted(map(tuple, i.postings.select("term", "doc_id", "tf").collect()))
    assert rows(st.read_index(spark, str(tmp_path / "ix"))) == rows(ix.build_index(batch))


def test_parents_and_segments(spark, tmp_path):
    stream, batch = feed(spark, tmp_path)
    got = finish(spark, tmp_path, st.stream_parents(st.stream_dedupe(stream)), "parents").where("parent_event_id is not null").collect()
    want = se.link_parents(batch).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    segments = finish(spark, tmp_path, st.stream_segments(stream.dropDuplicates(["event_id"])), "segments")
    whole = se.work_segments(batch.where("session_id <> 'z'"))
    assert sorted((r["session_id"], r["n_events"]) for r in segments.collect()) == sorted((r["session_id"], r["n_events"]) for r in whole.collect())


def test_serving_ongoing_novelty(spark, tmp_path):
    path = folder(tmp_path, [[{"session_id": "s", "key": "a", "place": 1, "kind": "activity"}], [{"session_id": "s", "key": "a", "place": 2, "kind": "ending"}, {"session_id": "s", "key": "b", "place": 0, "kind": "activity"}]])
    stream = st.stream_logs(spark, path, "session_id string, key string, place long, kind string", 1)
    served = finish(spark, tmp_path, st.stream_delta_serving(stream), "served")
    assert sorted(r["key"] for r in served.collect()) == ["a", "b"]
    flags = finish(spark, tmp_path, st.stream_ongoing(stream), "flags", "update")
    assert sorted(r["ongoing"] for r in flags.collect()) == [False, True]
    sink = st.novelty_sink(str(tmp_path / "vec"))
    v = lambda i, x: spark.createDataFrame([(i, [float(y) for y in x])], "vec_id long, embedding array<double>")
    for i, x in enumerate(([1, 0], [1, 0.01], [0, 1])):
        sink(v(i, np.array(x)), i)
    assert sorted(r["vec_id"] for r in read_batches(spark, str(tmp_path / "vec")).select(F.col("vec_id")).collect()) == [0, 2]


def test_novelty_within_a_batch(spark, tmp_path):
    """Equal vectors in one batch, also in the first: the one of smallest id stays."""
    sink = st.novelty_sink(str(tmp_path / "vec"))
    frame = lambda rows: spark.createDataFrame([(i, [float(y) for y in x]) for i, x in rows], "vec_id long, embedding array<double>")
    sink(frame([(1, (1, 0)), (2, (1, 0))]), 0)
    sink(frame([(3, (0, 1)), (4, (0, 1)), (5, (1, 0.001)), (3, (0, 1))][:3]), 1)
    assert sorted(r["vec_id"] for r in read_batches(spark, str(tmp_path / "vec")).collect()) == [1, 3]


def test_dedupe_remembers_old_ids(spark, tmp_path):
    day = [{"event_id": "a", "ts": "2024-01-01T00:00:00", "type": "x"}, {"event_id": "b", "ts": "2024-01-01T00:00:01", "type": "x"}]
    path = folder(tmp_path, [day, [{"event_id": "c", "ts": "2024-03-01T00:00:00", "type": "x"}], [{"event_id": "a", "ts": "2024-03-02T00:00:00", "type": "x"}]])
    stream = st.stream_logs(spark, path, "event_id string, ts timestamp, type string", 1)
    assert sorted(r["event_id"] for r in finish(spark, tmp_path, st.stream_dedupe(stream), "once").collect()) == ["a", "b", "c"]


def test_tailing_a_growing_log(spark, tmp_path):
    log = tmp_path / "logs"
    log.mkdir()
    line = lambda i: json.dumps({"event_id": f"é{i}"}) + "\n"
    (log / "a.jsonl").write_text(line(1) + line(2) + '{"event_id": "half')
    (log / "b.jsonl").write_text(line(3) + "{broken}\n\n")
    rows, at = lo.tail_logs(spark, str(log), None, "event_id string")
    assert sorted(r["event_id"] for r in rows.collect()) == ["é1", "é2", "é3"]
    with (log / "a.jsonl").open("a") as f:
        f.write('"}\n' + line(4))
    rows, at = lo.tail_logs(spark, str(log), at, "event_id string")
    assert sorted(r["event_id"] for r in rows.collect()) == ["half", "é4"]
    (log / "b.jsonl").write_text(line(5))
    rows, at = lo.tail_logs(spark, str(log), at, "event_id string")
    assert [r["event_id"] for r in rows.collect()] == ["é5"]
    assert lo.tail_logs(spark, str(log), at, "event_id string")[0].count() == 0


def test_a_repeated_batch_changes_nothing_and_reads_nothing(spark, tmp_path):
    """Batches are told by their number; an unreadable file in another batch's folder does not matter to the writer."""
    domain, whole = str(tmp_path / "domain"), str(tmp_path / "all")
    rows = lambda *ids: spark.createDataFrame([(i, "x") for i in ids], "event_id string, type string")
    sink = st.dual_appender(domain, whole)
    sink(rows("a", "b"), 0)
    sink(rows("c"), 1)
    for path in (domain, whole):
        (tmp_path / path / "none/0/part-bad.parquet").write_bytes(b"broken")
    sink(rows("c"), 1)
    sink(rows("d"), 2)
    for path in (domain, whole):
        (tmp_path / path / "none/0/part-bad.parquet").unlink()
        assert sorted(r["event_id"] for r in read_batches(spark, path).collect()) == ["a", "b", "c", "d"]
        assert sorted(r["event_id"] for r in read_batches(spark, path, ("none", 1)).collect()) == ["a", "b", "d"]
    (tmp_path / domain / "none/2/_SUCCESS").unlink()  # a batch that was not finished
    assert read_batches(spark, domain).count() == 3
    assert read_batches(spark, str(tmp_path / "nothing")) is None
    write_batch(rows("e"), domain, 1, query="other")
    assert read_batches(spark, domain).count() == 4


def test_tables_of_two_queries_and_a_restart(spark, tmp_path):
    """A query keeps its id over a restart; a second query's batches of the same numbers stand beside it."""
    path = folder(tmp_path, [[{"event_id": "a"}], [{"event_id": "b"}]])
    out = str(tmp_path / "rows")
    feed_ = lambda state: st.run_available(st.stream_logs(spark, path, "event_id string", 1), st.appender(out), str(tmp_path / state)).awaitTermination()
    feed_("one")
    feed_("one")
    assert read_batches(spark, out).count() == 2 and not (tmp_path / "rows/none").exists()
    (tmp_path / "one/commits/1").unlink()  # as if the second batch's end was never noted
    (tmp_path / "one/commits/.1.crc").unlink(missing_ok=True)
    feed_("one")
    assert read_batches(spark, out).count() == 2
    feed_("two")
    assert sorted(r["event_id"] for r in read_batches(spark, out).collect()) == ["a", "a", "b", "b"]


def test_novelty_of_a_repeated_batch(spark, tmp_path):
    sink = st.novelty_sink(str(tmp_path / "vec"))
    frame = lambda rows: spark.createDataFrame([(i, [float(y) for y in x]) for i, x in rows], "vec_id long, embedding array<double>")
    sink(frame([(1, (1, 0))]), 0)
    for _ in range(2):
        sink(frame([(2, (0, 1)), (3, (1, 0.01))]), 1)
        assert sorted(r["vec_id"] for r in read_batches(spark, str(tmp_path / "vec")).collect()) == [1, 2]


def test_parents_with_an_end(spark, tmp_path):
    """The same parents for rows in time, and no session's state once the watermark is past its last event."""
    base = dt.datetime(2024, 1, 1)
    row = lambda i, k, s: {"event_id": i, "session_id": k, "ts": (base + dt.timedelta(seconds=s)).isoformat()}
    parts = [[row("a1", "a", 0), row("a2", "a", 30), row("b1", "b", 31)], [row("a3", "a", 80), row("c1", "c", 81)], [row("d1", "d", 9000)]]
    stream = st.stream_logs(spark, folder(tmp_path, parts), FIELDS, 1)
    run = st.run_available(st.stream_parents(stream, watermark="10 minutes"), st.appender(str(tmp_path / "out")), str(tmp_path / "cp"))
    run.awaitTermination()
    got = {r["event_id"]: r["parent_event_id"] for r in read_batches(spark, str(tmp_path / "out")).collect()}
    assert got == {"a1": None, "a2": "a1", "b1": None, "a3": "a2", "c1": None, "d1": None}
    totals = [sum(o["numRowsTotal"] for o in json.loads(p.json)["stateOperators"]) for p in run.recentProgress]
    assert max(totals) > 1 == totals[-1]  # the last session alone


def test_ongoing_with_an_end(spark, tmp_path):
    """The same states as without a watermark, and idle sessions are forgotten."""
    base = dt.datetime(2024, 1, 1)
    row = lambda k, place, kind, s: {"session_id": k, "place": place, "kind": kind, "ts": (base + dt.timedelta(seconds=s)).isoformat()}
    parts = [[row("a", 1, "activity", 0), row("b", 1, "activity", 9)], [row("a", 2, "ending", 80)], [row("c", 1, "activity", 90000)], [row("a", 3, "activity", 90001), row("d", 1, "other", 90002)]]
    stream = st.stream_logs(spark, folder(tmp_path, parts), "session_id string, place long, kind string, ts string", 1)
    sink = lambda batch, number: write_batch(batch.withColumn("n", F.lit(number)), str(tmp_path / "out"), number)
    run = st.run_available(st.stream_ongoing(stream, "10 minutes"), sink, str(tmp_path / "cp"), "update")
    run.awaitTermination()
    last = {}
    for r in sorted(read_batches(spark, str(tmp_path / "out")).collect(), key=lambda r: r["n"]):
        last.setdefault(r["session_id"], []).append(r["ongoing"])
    assert last == {"a": [True, False, True], "b": [True], "c": [True], "d": [False]}
    totals = [sum(o["numRowsTotal"] for o in json.loads(p.json)["stateOperators"]) for p in run.recentProgress]
    assert max(totals) >= 3 >= totals[-1]  # b is gone, a came back


def test_a_table_of_many_files_comes_in_as_many_batches_as_asked(spark, tmp_path):
    """The index is that of all documents, in one segment for each of four batches, and ids that come again stay out."""
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("alpha word"), F.col("id") % 7).alias("text"))
    docs.repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    path, state = str(tmp_path / "ix"), str(tmp_path / "cp")
    st.run_available(sq.batches(spark, str(tmp_path), "documents", "doc_id"), st.index_sink(path), state).awaitTermination()
    index = st.read_index(spark, path)
    assert len(index.segments) == 4
    assert all(s.table("blocks").select("shard").distinct().count() == 4 for s in index.segments)  # as many as there are cores
    st.index_sink(path)(docs.where("doc_id < 20").union(spark.createDataFrame([(9000, "beta")], "doc_id long, text string")), 4)
    rows = lambda i: sorted(map(tuple, i.postings.select("term", "doc_id", "tf").collect()))
    assert rows(st.read_index(spark, path)) == sorted([*rows(ix.build_index(docs)), ("beta", 9000, 1)])
