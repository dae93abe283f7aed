import json

import pytest
from pyspark.sql import functions as F

from tracelake.operators import transcripts as tr
from tracelake.sources import logs as lo

T0 = "2024-03-01T10:00:"


def usage(i, o, r=0, c=0):
    return {"input_tokens": i, "output_tokens": o, "cache_read_input_tokens": r, "cache_creation_input_tokens": c}


def entry(n, kind, second, content, **more):
    return {"uuid": f"u{n}", "type": kind, "timestamp": f"{T0}{second:06.3f}Z", "message": {"role": kind, "content": content, **more.pop("message", {})}, **more}


CALL = [{"type": "text", "text": "looking"}, {"type": "tool_use", "id": "t1", "name": "Read", "input": {"file_path": "/a/b.py"}}]
SIX = [
    entry(1, "user", 0, "please read @src/app.py now"),
    entry(2, "assistant", 5, CALL, requestId="req-1", message={"usage": usage(100, 40)}),
    entry(3, "assistant", 5.5, CALL, requestId="req-1", message={"usage": usage(100, 55)}),
    entry(4, "user", 6, [{"type": "tool_result", "tool_use_id": "t1", "content": "file text"}], isMeta=True),
    entry(5, "assistant", 10, [{"type": "text", "text": "done"}], requestId="req-2", message={"usage": usage(160, 30, 20)}),
    entry(6, "user", 1, "<system-reminder>be brief</system-reminder>"),
]


@pytest.fixture(scope="module")
def load(spark, tmp_path_factory):
    def run(entries, name="s1"):
        root = tmp_path_factory.mktemp("logs")
        (root / "proj").mkdir()
        lines = [json.dumps(e) for e in entries]
        (root / "proj" / f"{name}.jsonl").write_text("\n".join([*lines, "", "{broken"]))
        (root / "proj" / "agent-x.jsonl").write_text(lines[0] if lines else "")
        return lo.parse_entries(lo.read_entries(spark, str(root))), str(root)

    return run


def test_six_lines(load):
    m, root = load(SIX)
    assert m.count() == 6
    assert [r["uuid"] for r in tr.dedupe_requests(m).orderBy("ordinal").collect()] == ["u1", "u3", "u4", "u5", "u6"]
    r = tr.session_metrics(m).first()
    assert (r["input_tokens"], r["output_tokens"], r["cache_read_input_tokens"], r["message_count"]) == (260, 85, 20, 6)
    assert r["duration_ms"] == 10_000
    assert tr.ongoing(m).first()["ongoing"] is False
    assert tr.compaction_summary(m).first()["compactions"] == 0
    shares = tr.attribution_shares(tr.token_attribution(m)).first()
    assert abs(sum(shares[f"{c}_share"] for c in tr.CATEGORIES) - 1) < 1e-3
    assert shares["mentioned_files"] == 500
    call = tr.calls_with_results(m).orderBy("ordinal").collect()
    assert [(c["name"], c["result_ordinal"]) for c in call] == [("Read", 4), ("Read", 4)]
    assert [r["summary"] for r in tr.synth_tool_events(m).collect()] == []
    assert {r["category"] for r in tr.message_category(m).collect()} == {"user_messages", "thinking_text", "tool_outputs", "claude_md"}
    turns = tr.turns_rich(m).orderBy("turn_idx").collect()
    assert "[Read: /a/b.py]" in turns[0]["body"]


def test_harvest_and_listing(spark, load):
    m, root = load(SIX)
    body = m.select("ordinal", tr.harvest_text(m["raw"]).alias("h")).orderBy("ordinal").collect()
    assert body[0]["h"] == "please read @src/app.py now"
    files = lo.scan_transcripts(spark, root).collect()
    assert [(f["project"], f["session_id"]) for f in files] == [("proj", "s1")]


def test_phases(load):
    m, _ = load([
        entry(1, "assistant", 0, [], message={"usage": usage(1000, 50, 200)}),
        entry(2, "user", 1, "summary", isCompactSummary=True),
        entry(3, "assistant", 2, [], message={"usage": usage(200, 30)}),
    ])
    s = tr.compaction_summary(m).first()
    assert (s["compactions"], s["phases"], s["consumption"]) == (1, 2, 1200)
    first, second = tr.compaction_phases(m).orderBy("phase").collect()
    assert (first["peak_tokens"], first["post_tokens"], second["contribution"]) == (1200, 200, 0)
    assert tr.compaction_events(m).first()["compression"] == pytest.approx(1 - 200 / 1200, abs=1e-6)


@pytest.mark.parametrize(
    ("blocks", "want"),
    [
        ([("assistant", [{"type": "tool_use", "id": "a", "name": "Bash", "input": {}}])], True),
        ([("assistant", [{"type": "tool_use", "id": "a", "name": "Bash", "input": {}}]), ("user", [{"type": "tool_result", "tool_use_id": "a", "content": "x"}]), ("assistant", [{"type": "text", "text": "end"}])], False),
        ([("assistant", [{"type": "tool_use", "id": "a", "name": "ExitPlanMode", "input": {}}])], False),
        ([("assistant", [{"type": "thinking", "thinking": "hm"}]), ("user", [{"type": "text", "text": "[Request interrupted by user]"}])], False),
        ([("assistant", [{"type": "text", "text": "x"}]), ("assistant", [{"type": "thinking", "thinking": "more"}])], True),
        ([("assistant", [{"type": "tool_use", "id": "s", "name": "SendMessage", "input": {"type": "shutdown_response", "approve": True}}]), ("user", [{"type": "tool_result", "tool_use_id": "s", "content": "ok"}])], False),
    ],
)
def test_ongoing(load, blocks, want):
    m, _ = load([entry(i, kind, i, content) for i, (kind, content) in enumerate(blocks)])
    assert tr.ongoing(m).first()["ongoing"] is want


def test_predicates(spark, load):
    m, _ = load([
        entry(1, "user", 0, "hello"), entry(2, "user", 1, "<system-reminder>x</system-reminder>"), entry(3, "user", 2, "[Request interrupted by user]"),
        entry(4, "assistant", 3, "x", message={"model": "<synthetic>"}), entry(5, "system", 4, "y"), entry(6, "user", 5, [{"type": "text", "text": "hi"}]),
    ])
    rows = m.select("uuid", tr.is_user_chunk().alias("user"), tr.is_hard_noise().alias("noise")).orderBy("uuid").collect()
    assert [r["user"] for r in rows] == [True, False, True, False, False, True]
    assert [r["noise"] for r in rows] == [False, True, True, True, True, False]


def test_harvest_reads_escapes_as_the_text_has_them(spark):
    raw = r'{"text": "a\tb C:\\new \/x \"q\" \\\\srv", "other": "no", "command": "one\ntwo\r"}'
    row = spark.createDataFrame([(raw,)], "raw string").select(tr.harvest_text(F.col("raw")).alias("t")).first()
    assert row["t"] == 'a b C:\\new /x "q" \\\\srv one two '


def test_queries_over_live_messages_reach_every_case(spark, sf_dir):
    """Both values of each flag and something in every column, so that the SQL beside them compares more than constants."""
    from tracelake.plans import transcript_queries as q

    assert {r["ongoing"] for r in q.ongoing_sessions(spark, sf_dir).collect()} == {True, False}
    spent = q.token_attribution(spark, sf_dir).agg(*(F.max(c).alias(c) for c in tr.CATEGORIES)).first()
    assert all(spent[c] > 0 for c in tr.CATEGORIES)
    assert len({r["dominant"] for r in q.attribution_shares(spark, sf_dir).collect()}) >= 2
    events = q.compaction_events(spark, sf_dir)
    assert events.where("pre_tokens > 0 and post_tokens > 0 and compression is not null").count() and events.where("compression is null").count()
    assert q.compaction_phases(spark, sf_dir).where("post_tokens is not null and contribution <> 0").count()
    assert q.context_splits(spark, sf_dir).count() > 0
    parts = q.message_partition(spark, sf_dir).agg(F.sum("n_internal_user").alias("meta"), F.sum(F.col("n_user") - F.col("n_real_user") - F.col("n_internal_user")).alias("noise")).first()
    assert parts["meta"] > 0 and parts["noise"] > 0
