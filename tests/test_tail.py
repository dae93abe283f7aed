"""The source of growing logs: whole lines once, across restarts, parts and truncation."""

import json

import pytest

from tracelake.sources.batches import read_batches
from tracelake.streaming import streams as st
from tracelake.streaming import tail

FIELDS = "event_id string, text string"


def line(i):
    return json.dumps({"event_id": f"é{i}", "text": "x" * (i % 50)}, ensure_ascii=False) + "\n"


def fed(spark, log, out, part_bytes):
    """Runs the stream over what is there, each time as after a restart, and gives all ids so far."""
    st.run_available(tail.tail_events(spark, str(log), FIELDS, part_bytes), st.appender(str(out / "rows")), str(out / "state")).awaitTermination()
    return sorted(r["event_id"] for r in read_batches(spark, str(out / "rows")).collect())


@pytest.mark.parametrize("part_bytes", [40, 64 << 20])
def test_growing_files_over_restarts(spark, tmp_path, part_bytes):
    log, out = tmp_path / "logs", tmp_path / "out"
    (log / "deep").mkdir(parents=True)
    ids = lambda *n: sorted(f"é{i}" for i in n)
    (log / "a.jsonl").write_text(line(1) + line(2) + line(3)[:9])
    (log / "deep/b.jsonl").write_text(line(4) + "{broken}\n\n")
    (log / "other.txt").write_text(line(99))
    assert fed(spark, log, out, part_bytes) == ids(1, 2, 4)
    with (log / "a.jsonl").open("a") as f:
        f.write(line(3)[9:] + "".join(line(i) for i in range(10, 60)))
    (log / "c.jsonl").write_text(line(5).rstrip("\n"))
    assert fed(spark, log, out, part_bytes) == ids(1, 2, 3, 4, *range(10, 60))
    assert fed(spark, log, out, part_bytes) == ids(1, 2, 3, 4, *range(10, 60))
    (log / "a.jsonl").write_text(line(70))  # begun anew
    assert fed(spark, log, out, part_bytes) == ids(1, 2, 3, 4, 70, *range(10, 60))


@pytest.mark.parametrize("part_bytes", [1, 7, 100, 10_000])
def test_parts_hold_each_line_once(tmp_path, part_bytes):
    text = "".join(line(i) for i in range(60)) + "\n\n" + "y" * 300 + "\n" + "tail without an end"
    (tmp_path / "a.jsonl").write_text(text)
    reader = tail.TailReader(str(tmp_path), ".jsonl", part_bytes)
    end = reader.latestOffset()
    raw = text.encode()
    assert list(end.values()) == [raw.rfind(b"\n") + 1]
    rows = [(p, v) for part in reader.partitions({}, end) for b in reader.read(part) for p, v in zip(b["place"].to_pylist(), b["value"].to_pylist(), strict=True)]
    assert [v for _, v in rows] == text.split("\n")[:-1]
    assert all(raw[p:].startswith(v.encode()) for p, v in rows)
    assert reader.partitions(end, end)[0].path == ""


def test_a_line_longer_than_a_block(tmp_path):
    (tmp_path / "a.jsonl").write_text("a" * 2_500_000 + "\nb\n")
    reader = tail.TailReader(str(tmp_path), ".jsonl", 1 << 20)
    values = [v for part in reader.partitions({}, reader.latestOffset()) for b in reader.read(part) for v in b["value"].to_pylist()]
    assert [len(v) for v in values] == [2_500_000, 1]
