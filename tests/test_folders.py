"""Folders of logs with empty, broken and old files; imports of summary indexes of all shapes."""

import json
import os
from datetime import UTC, datetime

from tracewell.sources import logs

SESSIONS = "id string, engine string, model string, cwd string, started_at timestamp, ended_at timestamp, last_event_at timestamp, parent_id string, session_type string, total_turns bigint"
HANDOFFS = "session_id string, headline string, projects array<string>, keywords array<string>, substance int"


def base(df):
    return sorted(r.file.rsplit("/", 1)[1] for r in df.select("file").distinct().collect())


def test_layouts(spark, tmp_path):
    def put(name, text, old=False):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
        if old:
            os.utime(path, (0, 0))

    record = json.dumps({"type": "user", "sessionId": "s"}) + "\n"
    put("a/p/one.jsonl", "\n" + record + "{broken\n")
    put("a/p/TWO.JSONL", record, old=True)
    put("a/p/empty.jsonl", "")
    put("a/p/agent-1.jsonl", record)
    put("a/p/one/subagents/agent-7.jsonl", record)
    put("a/p/one/deeper.jsonl", record)
    put("b/2024/01/rollout-x.jsonl", record)
    put("b/2024/other.jsonl", record)
    put("c/h/chats/session-1.json", json.dumps({"sessionId": "g", "startTime": "t", "messages": [{"model": "m"}]}, indent=2))
    put("c/h/chats/session-2.json", "{")
    put("c/h/session-3.json", "{}")
    root = f"file://{tmp_path}"
    since = datetime(2020, 1, 1, tzinfo=UTC)
    assert base(logs.engine_a(spark, f"{root}/a")) == ["TWO.JSONL", "one.jsonl"]
    assert base(logs.engine_a(spark, f"{root}/a", since)) == ["one.jsonl"]
    assert base(logs.engine_b(spark, f"{root}/b")) == ["rollout-x.jsonl"] == base(logs.engine_b(spark, f"{root}/b", since))
    documents = logs.engine_c(spark, f"{root}/c")
    assert base(documents) == ["session-1.json"] == base(logs.engine_c(spark, f"{root}/c", since))
    assert tuple(logs.document_heads(documents).drop("file").first()) == ("g", "m", None, "t", None)
    kid = logs.child_logs(spark, f"{root}/a").first()
    assert (kid.agent_id, kid.size, kid.parent_dir.endswith("/a/p/one")) == ("7", len(record), True)


def test_heads_read_the_first_lines_only(spark):
    rows = [("f", i, "{broken" if i < 2 else json.dumps({"n": i})) for i in range(29)] + [("f", 29, json.dumps({"sessionId": "in"})), ("f", 30, json.dumps({"cwd": "/out"}))]
    lines = spark.createDataFrame(rows, "file string, ord long, line string")
    got = logs.log_heads(lines, "claude").first()
    assert (got.session_uid, got.cwd) == ("in", None) and logs.log_heads(lines, "claude", 31).first().cwd == "/out"


def test_imports(spark, tmp_path):
    entry = {"session_id": "a", "headline": "h", "projects": "p, q", "tags": ["k"], "substance": 2, "startedAt": "2024-03-07T10:00:00Z", "engine": " Codex "}
    shapes = {"list": [entry], "entries": {"entries": [entry]}, "handoffs": {"handoffs": {"a": {"title": "h", "project": ["p", "q"], "keywords": "k"}}}, "map": {"a": {"title": "h", "projects": "p,q", "keywords": ["k"]}}}
    for name, shape in shapes.items():
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(shape))
        got = logs.import_summaries(spark, f"file://{path}").collect()
        assert [(r.session_id, r.headline, r.projects, r.keywords) for r in got] == [("a", "h", ["p", "q"], ["k"])]
    entries = logs.import_summaries(spark, f"file://{tmp_path}/list.json").unionByName(logs.import_summaries(spark, f"file://{tmp_path}/map.json"))
    sessions = spark.createDataFrame([("b", "codex", None, None, None, None, None, None, "standalone", 3)], SESSIONS)
    handoffs = spark.createDataFrame([("b", "there", [], [], 1)], HANDOFFS)
    for known, counts in ((handoffs, (1, 1)), (handoffs.unionByName(handoffs.withColumn("session_id", logs.F.lit("a"))), (0, 2))):
        s, h, report = logs.imported(entries, sessions, known)
        assert tuple(report.first()) == counts
    s, h, report = logs.imported(entries, sessions, handoffs)
    stub = s.filter("id = 'a'").first()
    assert (stub.session_type, stub.total_turns, s.count(), h.count()) == ("standalone", 0, 2, 2)
    again = logs.imported(entries, s, h)
    assert tuple(again[2].first()) == (0, 2) and again[0].count() == 2
