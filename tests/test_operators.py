import datetime as dt
import json

from pyspark.sql import functions as F

from tracelake.functions import classify as cl
from tracelake.functions import links as li
from tracelake.functions.text import display_text, fold, scrub
from tracelake.operators import evaluate as ev
from tracelake.operators import facets as fa
from tracelake.operators import fusion as fu
from tracelake.operators import index as ix
from tracelake.operators import sessions as se
from tracelake.operators import vectors as vx
from tracelake.sources import logs as lo


def at(*s):
    return [dt.datetime(2024, 1, 1) + dt.timedelta(seconds=x) for x in s]


def test_rrf_and_tail(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 10, 1)], "query_id long, doc_id long, rank int")
    rows = {r["doc_id"]: r for r in fu.rrf({"bm25": a, "semantic": b}).collect()}
    assert round(rows[10]["score"], 4) == 0.0328 and rows[10]["sources"] == "bm25+semantic"
    assert rows[11]["sources"] == "bm25"
    scores = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.1), (1, 3, 0.09)], "query_id long, doc_id long, score double")
    assert {r["doc_id"] for r in fu.cut_tail(scores).collect()} == {1, 2}


def test_decay(spark):
    t = spark.createDataFrame([(1, at(0)[0], 1.0), (2, None, 1.0)], "doc_id long, ts timestamp, score double")
    out = {r["doc_id"]: r["score"] for r in fu.time_decay(t, F.lit("2024-01-02 00:00:00").cast("timestamp")).collect()}
    assert out == {1: round(2.718281828459045**-0.024, 6), 2: 1.0}


def test_quadrants_and_commits(spark):
    rows = spark.createDataFrame([(1, 99, 0), (1, 100, 0), (0, 30, 19), (0, 30, 20)], "f int, a int, r int")
    assert [r[0] for r in rows.select(cl.diff_quadrant(F.col("f"), F.col("a"), F.col("r"))).collect()] == ["bootstrap", "construct", "surgical", "rework"]
    s = spark.createDataFrame([("feat(x)!: y",), ("feat(x): y",), ("bugfix: z",), ("Cleaned up",), ("wip",)], "s string")
    got = s.select(cl.commit_type(F.col("s")), cl.commit_type(F.col("s"), "strict")).collect()
    assert [tuple(r) for r in got] == [("feature", "feat"), ("feature", "feat"), ("fix", None), ("refactor", None), ("other", None)]


def test_url_and_event_labels(spark):
    u = spark.createDataFrame([("https://arxiv.org/abs/1",), ("https://docs.python.org",), ("https://x.blog/",), ("https://news.site",), ("https://en.wikipedia.org",), ("https://a.b",), (None,)], "u string")
    assert [r[0] for r in u.select(cl.url_category(F.col("u"))).collect()] == ["research", "docs", "blog", "news", "reference", "other", "other"]
    e = spark.createDataFrame([("milestone_compaction_auto", "s"), ("git_commit", "s"), ("memory_user", "s"), ("odd", None)], "t string, s string")
    assert [r[0] for r in e.select(cl.event_category(F.col("t"), F.col("s"))).collect()] == ["compaction", "commit", "memory", "odd"]


def test_tool_and_milestone_events(spark):
    raw = spark.createDataFrame(
        [("Edit", "/a/node_modules/x", None, None), ("Edit", "/a/x.py", None, None), ("Bash", None, "ls -l", None), ("Bash", None, "git commit -m x", "[main abc1234] fix: y"), ("Bash", None, "git push", None), ("Bash", None, "make", None)],
        "tool string, file_path string, command string, response string",
    )
    out = [(r["type"], r["summary"], r["salience"]) for r in cl.tool_events(raw).collect()]
    assert out == [("tool_file_edit", "Modified: /a/x.py", 0.4), ("git_commit", "[fix] Commit abc1234: fix: y", 0.7), ("git_push", "Pushed: git push", 0.6), ("tool_bash", "Ran: make", 0.2)]
    life = spark.createDataFrame([("PreCompact", "auto", None, None), ("SubagentStop", None, None, "Plan"), ("SubagentStop", None, None, "other")], "event string, trigger string, reason string, agent_type string")
    assert [(r["milestone"], r["salience"]) for r in cl.milestone_events(life).collect()] == [("compaction_auto", 0.4), ("agent_Plan", 0.4)]


def test_gaps_at_their_edges(spark):
    e = spark.createDataFrame([(i, t, "s") for i, t in enumerate(at(0, 60, 121, 1021, 1922))], "event_id long, ts timestamp, session_id string")
    assert {(r["event_id"], r["parent_event_id"]) for r in se.link_parents(e).collect()} == {(1, 0)}
    assert [r["n_events"] for r in se.work_segments(e).orderBy("segment").collect()] == [4, 1]
    g = spark.createDataFrame([(i, t, "k") for i, t in enumerate(at(0, 299, 599, 86399, 86500))], "event_id long, ts timestamp, k string")
    assert [r["group_id"] for r in fa.event_groups(g, F.col("k")).orderBy("event_id").collect()] == [0, 0, 2, 3, 3]


def test_touching_sessions_do_not_overlap(spark):
    t = at(0, 100, 200, 150)
    s = spark.createDataFrame([("a", t[0], t[1]), ("b", t[1], t[2]), ("c", t[3], t[2])], "session_id string, start_ts timestamp, end_ts timestamp")
    assert {(r["a"], r["b"]) for r in se.session_overlaps(s).collect()} == {("b", "c")}


def test_thread_with_fork_and_cycle(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 2), (5, 5), (1, None)], "event_id long, parent_event_id long")
    starts = spark.createDataFrame([(2,), (5,)], "event_id long")
    got = {(r["start_id"], r["event_id"], r["role"]) for r in se.thread(edges, starts).collect()}
    assert got == {(2, 2, "start"), (2, 1, "ancestor"), (2, 3, "descendant"), (2, 4, "descendant"), (5, 5, "start")}


def test_thread_longer_than_a_thousand_steps(spark):
    edges = spark.range(1, 2500).select(F.col("id").alias("event_id"), (F.col("id") - 1).alias("parent_event_id"))
    starts = spark.createDataFrame([(1200,), (2499,)], "event_id long")
    got = {(r["start_id"], r["event_id"], r["role"]) for r in se.thread(edges, starts).collect()}
    assert got == {(s, i, "start" if i == s else "ancestor" if i < s else "descendant") for s in (1200, 2499) for i in range(2500)}


def test_thread_on_a_cycle_with_a_branch(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 2), (4, 1), (5, 4)], "event_id long, parent_event_id long")
    got = {(r["event_id"], r["role"]) for r in se.thread(edges, spark.createDataFrame([(1,)], "event_id long")).collect()}
    assert got == {(1, "start"), (2, "ancestor"), (4, "descendant"), (5, "descendant")}


def test_knn_of_equal_vectors_takes_the_smallest_ids(spark):
    rows = [(i, [1.0, 2.0]) for i in range(99, 49, -1)] + [(i, [1.0, -3.0 - i]) for i in range(20)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    q = spark.createDataFrame([(1000, [1.0, 2.0]), (1001, [2.0, 1.0])], "query_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in vx.knn(q, vectors, k=5).collect()}
    assert got == {(i, n + 1): 50 + n for i in (1000, 1001) for n in range(5)}
    assert vx.knn(q, vectors, k=None).count() == 100


def test_logs(spark, tmp_path):
    a, b = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    a.write_text('{"event_id":"e1","summary":"short","timestamp":"2024-01-01T00:00:00Z"}\n\n{"summary":"no id"}\n{broken\n')
    b.write_text('{"event_id":"e1","summary":"much longer","session":"s","timestamp":"1704067200"}\n')
    merged = lo.normalize_fields(lo.merge_events(lo.union_logs({"changelog": lo.read_log(spark, str(a)), "research": lo.read_log(spark, str(b))})))
    rows = {r["event_id"]: r for r in merged.collect()}
    assert len(rows) == 2 and rows["e1"]["summary"] == "much longer" and rows["e1"]["source"] == "research" and rows["e1"]["session_id"] == "s"
    assert lo.corrupt_lines(spark, str(a)).count() == 1
    resp = spark.createDataFrame([("s1", json.dumps({"results": [{"url": "http://a", "title": "A"}, {"url": ""}]})), ("s2", "[]"), ("s3", "oops")], "event_id string, tool_response string")
    assert [(r["url"], r["parent_event_id"]) for r in lo.explode_search_results(resp).collect()] == [("http://a", "s1")]


def test_commits_memories_links(spark, tmp_path):
    c = spark.createDataFrame([("abcdef123", at(0)[0], "feat: x", "me", ["a", "b"], "git@github.com:o/r.git")], "hash string, ts timestamp, subject string, author string, files array<string>, remote string")
    r = lo.commit_events(c).first()
    assert (r["event_id"], r["summary"], r["url"]) == ("git-abcdef1", "Commit abcdef1: feat: x | files: a, b", "https://github.com/o/r/commit/abcdef123")
    m = spark.createDataFrame([("/p/proj/memory/note.md", "---\nname: N\ntype: user\ndescription: D\n---\nbody", at(0)[0])], "path string, value string, modified timestamp")
    r = lo.memory_events(m).first()
    assert (r["type"], r["summary"], r["body"], r["project"]) == ("memory_user", "N: D", "body", "proj")
    e = spark.createDataFrame([("e", "claude-history://session/%2Fa%2Fb%20c.jsonl?uuid=u1", ""), ("f", "", "/gone"), ("g", "", "")], "event_id string, deeplink string, transcript_path string")
    t = spark.createDataFrame([("/a/b c.jsonl",)], "transcript_path string")
    got = {r["event_id"]: (r["stale"], r["message_uuid"], r["link"]) for r in li.resolve_links(e, t).collect()}
    assert got["e"][:2] == (False, "u1") and got["f"] == (True, None, "claude-history://session/%2Fgone") and got["g"] == (False, None, None)


def test_text_functions(spark):
    t = spark.createDataFrame([("Éa ﬁ ñ", "Fetched: https://h.x/p")], "a string, summary string")
    r = t.select(fold(F.col("a")), display_text(["summary"]), scrub(F.lit("/home/bob/Acme acme-two"), {"acme": "x", "acme-two": "yy"})).first()
    assert tuple(r) == ("ea ﬁ n", "h.x/p", "~/x yy")


def test_truth(spark):
    results = spark.createDataFrame([(1, 1, 1, "alpha beta gamma", ""), (1, 2, 2, "nothing here", "abcdefabcdef-9")], "query_id long, doc_id long, rank int, summary string, session string")
    events = spark.createDataFrame([(1, 0, "alpha beta delta", 0, "dup"), (1, 1, "alpha beta gamma", 3, None)], "query_id long, place int, summary string, grade int, noise string")
    sessions = spark.createDataFrame([(1, "abcdefabcdef", True, "secondary")], "query_id long, session string, relevant boolean, role string")
    got = {r["doc_id"]: r["grade"] for r in ev.match_truth(results, events, sessions).collect()}
    assert got == {1: 3, 2: 2}
    assert ev.session_recall(results, sessions).first()["recall"] == 1.0


def test_serving_and_sinks(spark, tmp_path):
    served = spark.createDataFrame([("s", "a", 1)], "session_id string, key string, served_at long")
    new = spark.createDataFrame([("s", "a", 1, 2), ("s", "b", 2, 2)], "session_id string, key string, rank int, served_at long")
    fresh, history, held = fu.delta_serve(new, served, 1)
    assert [r["key"] for r in fresh.collect()] == ["b"] and [r["key"] for r in history.collect()] == ["b"] and held.first()["suppressed"] == 1
    e = spark.createDataFrame([("e1", "fetch", "x")], "event_id string, type string, summary string")
    for _ in range(2):
        lo.dual_sink(e, str(tmp_path / "domain"), str(tmp_path / "all"))
    assert spark.read.parquet(str(tmp_path / "domain")).count() == spark.read.parquet(str(tmp_path / "all")).count() == 1


def test_listing_and_filters(spark, tmp_path):
    e = spark.createDataFrame([("a", at(0)[0], "x", "Proj-One", "hello alpha"), ("b", at(9)[0], "bridge_ping_sent", "two", "beta"), ("c", at(5)[0], "y", "proj-onex", "ALPHA")], "event_id string, ts timestamp, type string, project string, text string")
    page, total = fu.list_events(e, 1, 1)
    assert [r["event_id"] for r in page.collect()] == ["a"] and total == 2
    assert [r["event_id"] for r in lo.order_events(e).collect()] == ["b", "c", "a"]
    ids = lambda f: sorted(r["event_id"] for r in f.collect())
    assert ids(li.project_filter(e, "proj-one")) == ["a", "c"] and ids(li.project_filter(e, "^PROJ-ONE$", "regex")) == ["a"]
    assert ids(li.project_filter(e, "two", "exact")) == ["b"] and ids(li.project_filter(e, spark.createDataFrame([("two",)], "project string"), "alias")) == ["b"]
    assert ix.find_in_messages(e.withColumnRenamed("type", "session_id"), "al alpha").groupBy().sum("n_matches").first()[0] == 2
    assert fa.facet_span(e.withColumn("query_id", F.lit(1))).first()["total"] == 3
    hits = spark.createDataFrame([(1, i, float(i)) for i in range(9)], "query_id long, doc_id long, score double")
    assert sorted(r["doc_id"] for r in fu.fusion_depth(hits, 3).collect()) == [6, 7, 8]
    cl.register_classifier("tag", lambda f: f.withColumn("tag", F.lit(1)))
    assert "tag" in cl.apply_classifier(e, "tag").columns
    assert lo.with_time(e.withColumn("timestamp", F.lit("1704067200"))).first()["ts"] == at(0)[0]


def test_tables_on_disk(spark, tmp_path):
    vectors = spark.createDataFrame([("e", [1.0, 0.0])], "event_id string, embedding array<float>")
    vectors.write.parquet(str(tmp_path / "v"))
    r = lo.read_vectors(spark, str(tmp_path / "v")).first()
    assert r["salience"] == 0.5 and r["parent_event_id"] is None
    (tmp_path / "truth.json").write_text(json.dumps([{"query": "q", "intent": "i", "events": [{"summary": "s", "grade": 2, "noise": None}], "sessions": {"abc": {"relevant": True, "role": "primary"}}}]))
    events, sessions = lo.read_truth(spark, str(tmp_path / "truth.json"))
    assert events.first()["grade"] == 2 and sessions.first()["role"] == "primary"
    target = lo.write_enriched(vectors, str(tmp_path / "out"), "1")
    assert spark.read.parquet(target).count() == 1
    judged = spark.createDataFrame([(1, "novel"), (2, "novel")], "vec_id long, verdict string")
    assert vx.gate_counts(judged).first()["count"] == 2


def test_overlaps_in_a_busy_cell(spark, monkeypatch):
    """Chunks of three: every pair of a busy cell once, whatever the lengths."""
    monkeypatch.setattr(se, "CHUNK", 3)
    base = dt.datetime(2024, 1, 1)
    rows = [(f"s{i:02}", base + dt.timedelta(seconds=37 * i), base + dt.timedelta(seconds=37 * i + (4000 if i % 9 == 0 else 60 + i)), f"p{i % 2}") for i in range(40)]
    frame = spark.createDataFrame(rows, "session_id string, start_ts timestamp, end_ts timestamp, project string")
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] < b[2] and b[1] < a[2])
    assert sorted((r["a"], r["b"]) for r in se.session_overlaps(frame).collect()) == want
    project = {r[0]: r[3] for r in rows}
    assert sorted((r["a"], r["b"]) for r in se.session_overlaps(frame, by="project").collect()) == [(a, b) for a, b in want if project[a] == project[b]]
