"""Small cases of summaries, names in logs, facets of the command line, paths and histories."""

from pyspark.sql import functions as F

from tracelake.functions import classify as cl
from tracelake.operators import evaluate as ev
from tracelake.operators import facets as fa
from tracelake.operators import index as ix
from tracelake.sources import logs as lo

RAW = "session_id string, event string, trigger string, reason string, agent_type string, git_branch string, git_dirty_files long"


def test_rich_summaries(spark):
    rows = [("s", "SessionEnd", None, "clear", None, "main", 3), ("s", "PreCompact", "auto", None, None, "", 9), ("none", "SessionEnd", None, None, None, "main", None), (None, "SubagentStop", None, None, "Plan", None, None), ("s", "Other", None, None, None, None, None)]
    log = spark.createDataFrame([("s",), ("s",), ("t",), (None,), ("",)], "session_id string")
    out = cl.milestone_events(spark.createDataFrame(rows, RAW), log).collect()
    assert {(r["milestone"], r["session_event_count"]) for r in out} == {("session_end_clear", 2), ("compaction_auto", 2), ("session_end_unknown", 0), ("agent_Plan", 0)}
    texts = {r["milestone"]: r["rich_summary"] for r in out}
    assert texts["session_end_clear"] == "Session ended (clear) [main, 3 dirty, 2 events]"
    assert texts["compaction_auto"].endswith(" [2 events]")
    assert texts["session_end_unknown"] == "Session ended (unknown) [main, 0 dirty, 0 events]"
    assert texts["agent_Plan"] == "Plan agent completed [0 events]"
    assert "rich_summary" not in cl.milestone_events(spark.createDataFrame(rows, RAW)).columns


def test_contained_needles(spark):
    lines = spark.createDataFrame([("see src/a.py now",), ("x" * 300 + "tail.js",), (None,), ("",)], "line string")
    needles = ["a.py", "src/a.py", "A.py", "b.py", "x" * 300 + "tail.js", "x" * 300 + "tail.ts", "", None, "a.py"]
    asked = spark.createDataFrame([(n,) for n in needles], "n string")
    for block in (1 << 20, 8):
        assert sorted(r["n"] for r in ix.contained(lines, "line", asked, "n", block).collect()) == ["a.py", "src/a.py", "x" * 300 + "tail.js"]
    assert ix.contained(lines.limit(0), "line", asked, "n").count() == 0 == ix.contained(lines, "line", asked.limit(0), "n").count()


def test_phantoms_within_longer_names(spark):
    queries = spark.createDataFrame([(1, "where is a.py and c.py"), (2, "b.py"), (3, "d.py")], "query_id long, query string")
    results = spark.createDataFrame([(3,)], "query_id long")
    logs = spark.createDataFrame([("read src/a.py",), (None,)], "line string")
    found = lambda within: sorted((r["query_id"], r["entity"]) for r in ev.phantoms(queries, results, logs, within=within).collect())
    assert found(True) == [(1, "c.py"), (2, "b.py")]
    assert found(False) == [(1, "a.py"), (1, "c.py"), (2, "b.py")]


def test_facets_of_the_command_line(spark):
    day = lambda i: f"2024-01-{i % 28 + 1:02d}"
    rows = [(1, i, i + 1, f"p{i % 11}" if i % 2 else "?", "t", "a+b" if i % 3 else "c", "q", day(i)) for i in range(510)]
    r = spark.createDataFrame(rows, "query_id long, doc_id long, rank long, project string, type string, source string, quadrant string, day string").withColumn("ts", F.col("day").cast("timestamp"))
    got = {}
    for x in fa.facets(r, "cli").collect():
        got.setdefault(x["dim"], []).append((x["rank"], x["value"], x["n"], x["more"]))
    assert {d: len(v) for d, v in got.items()} == {"project": 8, "type": 1, "source": 3, "month": 1, "day": 7}
    assert {v[3] for v in got["project"]} == {3} and {v[3] for v in got["day"]} == {21} and {v[3] for v in got["source"]} == {0}
    assert got["type"] == [(1, "t", 500, 0)] and sum(v[2] for v in got["source"]) == 500 + sum(1 for i in range(500) if i % 3)
    assert sorted(got["day"])[0][1] == "2024-01-28"


def test_transcript_paths(spark):
    e = spark.createDataFrame([(1, "s", "/a/b.c", None), (2, "s", None, ""), (3, "t", "/a/b.c", None), (4, "t", "x", "/own")], "event_id long, sessionId string, project string, transcript_path string")
    listing = spark.createDataFrame([("/r/-a-b.c/s.jsonl",), ("/r/-/s.jsonl",), ("/r/-/s.jsonl",)], "transcript_path string")
    assert {r["event_id"]: r["transcript_path"] for r in lo.normalize_fields(e, listing, "/r/").collect()} == {1: "/r/-a-b.c/s.jsonl", 2: "/r/-/s.jsonl", 3: None, 4: "/own"}
