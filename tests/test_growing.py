"""Growing logs, read tail by tail, against logs read whole; table versions that change as a whole."""

import json
import random

import pytest

from tracewell.operators.versions import Conflict, Store
from tracewell.sources import growing, ingest, logs

FACTS = ["file", "ts", "turn_number", "fact_type", "subject", "detail", "exit_code", "success"]


def claude_log(rng, uid, n):
    out, calls = [], []
    for i in range(n):
        stamp = f"2024-01-02T03:{i // 60:02}:{i % 60:02}Z"
        kind = rng.choice(["user", "say", "call", "result", "result", "late", "broken", "blank", "usage"])
        base = {"sessionId": f"{uid}-{i // 9}", "timestamp": stamp, "cwd": f"/w{i % 3}"}
        if kind == "user":
            out.append({**base, "type": "user", "message": {"content": f"ask {i} é😀"}})
        elif kind == "say":
            out.append({**base, "type": "assistant", "message": {"model": f"m{i % 2}", "stop_reason": rng.choice([None, "end_turn"]), "content": [{"type": "text", "text": f"reply {i}"}]}})
        elif kind == "usage":
            out.append({**base, "type": "assistant", "message": {"id": f"k{rng.randrange(6)}", "usage": {"input_tokens": rng.randrange(90), "output_tokens": i}, "content": []}})
        elif kind == "call":
            calls.append((f"c{rng.randrange(n)}", rng.choice(["Bash", "Read", "Write"])))
            made = {"command": rng.choice(["make", "git commit -m x"])} if calls[-1][1] == "Bash" else {"file_path": f"/p{i}"}
            out.append({**base, "type": "assistant", "message": {"content": [{"type": "tool_use", "id": calls[-1][0], "name": calls[-1][1], "input": made}]}})
        elif kind in ("result", "late"):
            call = rng.choice(calls)[0] if calls and kind == "result" else None
            block = {"type": "tool_result", "content": f"Exit code {rng.randrange(3)}", "is_error": rng.choice([True, False])}
            out.append({**base, "type": "user", "message": {"content": [{**block, "tool_use_id": call} if call else block]}})
        else:
            out.append("{broken" if kind == "broken" else "")
    return "".join((x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)) + "\n" for x in out).encode()


def codex_log(rng, uid, n):
    out, calls = [{"type": "session_meta", "payload": {"id": uid, "cwd": "/w"}}], []
    for i in range(n):
        kind = rng.choice(["user", "say", "call", "result", "result", "done", "usage"])
        event = lambda **p: {"timestamp": f"2024-01-02T03:{i // 60:02}:{i % 60:02}Z", "type": "event_msg", "payload": p}
        item = lambda **p: {**event(**p), "type": "response_item"}
        if kind == "user":
            out.append(event(type="user_message", message=f"ask {i}"))
        elif kind == "say":
            out.append(event(type="agent_message", message=f"said {rng.randrange(5)}"))
        elif kind == "done":
            out.append(event(type="task_complete", last_agent_message=f"said {rng.randrange(9)}"))
        elif kind == "usage":
            out.append(event(type="token_count", info={"last_token_usage": {"input_tokens": 50 + i, "cached_input_tokens": 7, "output_tokens": i}, "total_token_usage": {"total_tokens": rng.randrange(8)}}))
        elif kind == "call":
            calls.append(f"c{rng.randrange(n)}")
            out.append(item(type="function_call", name="exec_command", call_id=calls[-1], arguments=json.dumps({"cmd": f"make {i}"})))
        elif calls:
            out.append(item(type="function_call_output", call_id=rng.choice(calls), output=f"x\nProcess exited with code {rng.randrange(3)}"))
    return "".join(json.dumps(x) + "\n" for x in out).encode()


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def whole(spark, root, engine):
    lines = logs.read_lines(spark, str(root), "*.jsonl", recursive=True)
    events = {"claude": logs.events_a, "codex": logs.events_b}[engine](lines)
    facts = ingest.facts_of(events).select(*FACTS)
    sessions = ingest.sessions_of(events)
    return listed(facts), listed(sessions.select(*sorted(sessions.columns)))


def grown(spark, store):
    sessions, facts = growing.current(spark, store)
    return listed(facts.select(*FACTS)), listed(sessions.select(*sorted(sessions.columns)))


@pytest.mark.parametrize("engine", ["claude", "codex"])
def test_tails_give_what_whole_logs_give(spark, tmp_path, engine):
    rng, root, store = random.Random(engine), tmp_path / "logs" / "project", f"file://{tmp_path}/store"
    root.mkdir(parents=True)
    make = {"claude": claude_log, "codex": codex_log}[engine]
    text = {f"log {i}.jsonl": make(rng, f"s{i}", rng.randrange(20, 90)) for i in range(4)}
    text["empty.jsonl"], text["long.jsonl"] = b"", make(rng, "long", 400)
    at = dict.fromkeys(text, 0)
    for step in range(3):
        added = 0
        for name, data in text.items():
            to = len(data) if step == 2 else min(len(data), at[name] + rng.randrange(0, len(data) // 2 + 1))
            with open(root / name, "ab") as f:
                f.write(data[at[name] : to])
            at[name] = to
        known = {r.file: r.offset for r in Store(spark, store).read("offsets").collect()} if step else {}
        got = growing.ingest_growth(spark, store, f"file://{tmp_path}/logs", "*.jsonl", engine, range_bytes=700)
        now = {r.file: r.offset for r in Store(spark, store).read("offsets").collect()}
        added = sum(at.values()) - sum(known.values())
        assert got["bytes"] == added
        # What is read ends at a line end: no record is cut in two.
        assert all(o == 0 or open(f.replace("%20", " ").removeprefix("file:"), "rb").read()[o - 1 : o] == b"\n" for f, o in now.items())
    assert grown(spark, store) == whole(spark, tmp_path / "logs", engine)
    assert growing.ingest_growth(spark, store, f"file://{tmp_path}/logs", "*.jsonl", engine) == {"files": 0, "bytes": 0}


def test_names_of_earlier_calls_reach_later_results(spark, tmp_path):
    root, store = tmp_path / "logs", f"file://{tmp_path}/store"
    root.mkdir()
    item = lambda **p: json.dumps({"timestamp": "2024-03-07T10:00:00Z", "type": "response_item", "payload": p}) + "\n"
    log = root / "rollout-1.jsonl"
    log.write_text(json.dumps({"type": "event_msg", "payload": {"type": "user_message", "message": "go"}}) + "\n" + item(type="function_call", name="exec_command", arguments='{"cmd":"cargo build"}', call_id="c1"))
    run = lambda: growing.ingest_growth(spark, store, f"file://{root}", "rollout-*.jsonl", "codex")
    run()
    facts = lambda: {(r.fact_type, r.subject, r.exit_code, r.success) for r in growing.current(spark, store)[1].collect()}
    assert facts() == {("user_prompt", None, None, None), ("command", "cargo build", None, None)}
    with open(log, "a") as f:
        f.write(item(type="function_call_output", call_id="c1", output="failed\nProcess exited with code 1"))
    run()
    assert facts() == {("user_prompt", None, None, None), ("command", "cargo build", 1, False), ("error", "cargo build", 1, False)}
    # Written anew and shorter: what was known of it goes.
    log.write_text(json.dumps({"type": "event_msg", "payload": {"type": "user_message", "message": "new"}}))
    run()
    assert facts() == {("user_prompt", None, None, None)} and growing.current(spark, store)[0].first().total_turns == 1


def test_a_run_that_breaks_off_changes_nothing(spark, tmp_path):
    root, store = tmp_path / "logs", f"file://{tmp_path}/store"
    root.mkdir()
    (root / "a.jsonl").write_bytes(claude_log(random.Random(1), "s", 60))
    run = lambda **o: growing.ingest_growth(spark, store, f"file://{root}", "*.jsonl", "claude", **o)
    run()
    before = grown(spark, store)
    with open(root / "a.jsonl", "ab") as f:
        f.write(claude_log(random.Random(2), "s", 60))

    def fail():
        raise OSError("lost")

    with pytest.raises(OSError):
        run(before_commit=fail)
    assert grown(spark, store) == before and Store(spark, store).version == 1
    run()
    assert grown(spark, store) == whole(spark, root, "claude")


def test_versions(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    df = lambda rows: spark.createDataFrame(rows, "k string, v int")
    rows = lambda **o: sorted(map(tuple, Store(spark, root, **o).read("t").collect()), key=str)
    s = Store(spark, root, buckets=4)
    s.replace("t", df([(f"k{i}", i) for i in range(20)] + [(None, 1)]), "k")
    assert s.commit(rows=21) == 1 and s.notes() == {"rows": 21}
    first, other = Store(spark, root), Store(spark, root)
    first.rewrite("t", df([("k3", 33), ("k3", 34)]), df([("k3", 0), ("k4", 0), (None, 0)]), "k")
    assert rows() == sorted([(f"k{i}", i) for i in range(20)] + [(None, 1)], key=str)
    first.commit()
    assert rows() == sorted([(f"k{i}", i) for i in range(20) if i not in (3, 4)] + [("k3", 33), ("k3", 34)], key=str)
    # Buckets without a touched key stay the files they were.
    parts = [Store(spark, root, version=v).manifest["tables"]["t"]["parts"] for v in (1, 2)]
    assert any(parts[0][b] == parts[1].get(b) for b in parts[0])
    other.append("t", df([("lost", 1)]), "k")
    with pytest.raises(Conflict):
        other.commit()
    third = Store(spark, root)
    third.append("t", df([("more", 1)]), "k")
    third.replace("empty", df([]), "k")
    third.commit()
    assert len(rows()) == 21 and rows(version=1) and Store(spark, root).read("empty").collect() == []
    dead = third.vacuum(keep=1)
    assert dead and len(rows()) == 21 and third.versions() == [3] and third.vacuum(keep=1) == []
