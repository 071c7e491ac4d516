"""Child ids and files, the stored index, transcripts, dated documents and stateful streams, on small made-up tables."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tracewell.operators import assembly, links, search, search_index
from tracewell.operators.versions import Store
from tracewell.sources import children, dated, growing, logs
from tracewell.streaming import sessions as streams


def plain_ids(kids, stored):
    """(parent, uid) -> id, one kid after the other, by parent."""
    known, out = {i: (p, t) for i, p, t in stored}, {}
    for parent, uid in sorted(kids):
        out[parent, uid] = None
        for n in (8, 12):
            c = uid[:n]
            if c and (c not in known or known[c][0] == parent or known[c] == (None, "subagent")):
                known[c] = (parent, "subagent")
                out[parent, uid] = c
                break
    return out


def test_child_ids_with_clashes_and_orphans(spark):
    rng = random.Random(3)
    kids = list({(f"p{rng.randrange(4)}", "".join(rng.choice("ab") for _ in range(rng.choice([3, 8, 9, 10, 12, 13])))) for _ in range(120)})
    stored = [("aaaaaaaa", "p2", "subagent"), ("abababab", None, "subagent"), ("bbbbbbbb", None, "standalone"), ("aab", "p9", "subagent"), ("bababababa", "p1", "subagent")]
    got = links.child_ids(spark.createDataFrame(kids, "parent_id string, uid string"), spark.createDataFrame(stored, "id string, parent_id string, session_type string")).collect()
    # A parent that has an id keeps it, so those are asked first.
    own = {i: p for i, p, _ in stored}
    want = plain_ids(kids, stored)
    assert len(got) == len(kids)
    for r in got:
        assert r.id is None or r.uid.startswith(r.id)
        assert (r.id == want[r.parent_id, r.uid]) or own.get(r.uid[:8]) or own.get(r.uid[:12])
    holders = {}
    for r in got:
        if r.id:
            assert holders.setdefault(r.id, r.parent_id) == r.parent_id


def test_files_match_by_prefix_both_ways(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("xy") for _ in range(rng.randrange(1, 14)))
    asked = list({(f"p{rng.randrange(3)}", rng.choice(["", "agent-"]) + word()) for _ in range(80)})
    files = list({(f"p{rng.randrange(3)}", rng.choice(["", "agent-"]) + word()) for _ in range(60)})
    got = links.match_files(spark.createDataFrame(asked, "parent string, agent_id string"), spark.createDataFrame(files, "parent string, file_id string")).collect()
    bare = lambda x: x.removeprefix("agent-")
    for r in got:
        hits = [f for p, f in files if p == r.parent and (bare(f).startswith(bare(r.agent_id)) or bare(r.agent_id).startswith(bare(f)))]
        assert r.file_id == max(hits, key=lambda f: (len(f), f), default=None)
    assert len(got) == len(asked)


SESSIONS = "id string, engine string, cwd string, session_type string, parent_id string"
FACTS = "id long, session_id string, fact_type string, turn_number int, ts timestamp, subject string, detail string"


def test_index_is_what_a_scan_finds(spark, tmp_path):
    """Segments, replaced sessions, a merge; only the buckets of the query's terms are read."""
    rng, store = random.Random(5), f"file://{tmp_path}/index"
    words = [f"w{i}" for i in range(40)]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9))) or None
    facts = {i: (i, f"s{i % 7}", rng.choice(["command", "error", "user_prompt"]), i, datetime(2024, 1, 1 + i % 9), text(), text()) for i in range(140)}
    df = lambda rows: spark.createDataFrame(list(rows), FACTS)
    sessions = spark.createDataFrame([(f"s{i}", "claude" if i % 2 else "codex", f"/Work/Proj{i}", "standalone", None) for i in range(7)], SESSIONS)
    search_index.SEGMENTS, before = 2, search_index.SEGMENTS
    try:
        for step in range(4):
            search_index.update(spark, store, df(f for f in facts.values() if f[0] // 35 == step), buckets=8)
        gone = spark.createDataFrame([("s3",), ("s9",)], "session_id string")
        for i in [i for i, f in facts.items() if f[1] == "s3"]:
            facts.pop(i)
        facts |= {1_000: (1_000, "s3", "error", 1, datetime(2024, 1, 5), "w1 w2", "w3"), 1_001: (1_001, "s9", "command", 1, None, None, "w1 w1 w1")}
        search_index.update(spark, store, df(f for f in facts.values() if f[0] >= 1_000), gone, buckets=8)
    finally:
        search_index.SEGMENTS = before
    everything = df(facts.values())
    for options in ({}, {"field": "errors"}, {"cwd": "proj3"}, {"engine": "codex", "since": datetime(2024, 1, 4)}, {"limit": 5}):
        for query in ("w1; (w3", "w7 w7 w30", "nothing", ""):
            got, want = (sorted(map(tuple, f(query))) for f in (lambda q: search_index.find(spark, store, sessions, q, **{"limit": None, **options}).collect(), lambda q: search.search_facts(everything, sessions, q, **{"limit": None, **options}).collect()))
            assert got == want
    s = Store(spark, store)
    assert len(search_index.term_buckets(s, ["w1"])) == 1 and set(s.notes()) == {"segment", "n", "subject", "detail"} and s.notes()["n"] == len(facts)


def test_search_finds_subjects_and_minds_no_case_of_folders(spark):
    facts = spark.createDataFrame([(1, "a", "command", 1, datetime(2024, 1, 1), "cargo build", None), (2, "b", "command", 1, None, None, "cargo")], FACTS)
    sessions = spark.createDataFrame([("a", "claude", "/Work/Proj", "standalone", None), ("b", "claude", None, "standalone", None)], SESSIONS)
    assert [r.id for r in search.search_facts(facts, sessions, "CARGO", cwd="proj").collect()] == [1]
    assert sorted(r.id for r in search.search_facts(facts, sessions, "cargo").collect()) == [1, 2]


def events(spark, *rows):
    """Events of one log: (kind, text or (name, payload, id) or (id, text))."""
    out = []
    for i, (kind, x) in enumerate(rows):
        name, payload, call, text = (*x, None) if kind == "tool_use" else (None, None, x[0], x[1]) if kind == "tool_result" else (None, None, None, x)
        out.append(("f", i, 0, datetime(2024, 1, 1, 20, i % 60), kind, text, name, call, payload, "m"))
    return spark.createDataFrame(out, "file string, ord long, sub_ord int, ts timestamp, kind string, text string, name string, call_id string, payload string, model string")


def test_interrupts_open_no_turn(spark):
    assert assembly.turn_blocks(events(spark, ("user", "[Request interrupted by user]"))).count() == 0
    assert assembly.turn_blocks(events(spark, ("user", "Hello"))).count() == 1
    e = events(spark, ("tool_use", ("Read", "{}", "c0")), ("assistant_text", "hi"), ("tool_use", ("Read", "{}", "c1")), ("user", "go"), ("user", "x [Request interrupted by user]"), ("tool_use", ("Bash", "{}", "c2")), ("tool_result", ("c1", "late")), ("tool_result", ("c2", "a")), ("tool_result", ("c2", "b")))
    got = sorted((r.ord, r.turn, r.kind, r.result) for r in assembly.turn_blocks(e).collect())
    assert got == [(1, 1, "text", None), (2, 1, "call", "late"), (3, 2, "user", None), (5, 2, "call", "b")]
    nested = assembly.nested_turns(assembly.turn_blocks(e), most=1).orderBy("turn", "part").collect()
    assert [(r.turn, r.part, len(r.blocks), r.model) for r in nested] == [(1, 0, 1, "m"), (1, 1, 1, "m"), (2, 0, 1, None), (2, 1, 1, None)]


@pytest.mark.parametrize(
    "name, given, line",
    [
        ("Read", {"file_path": "/src/main.rs"}, "-> Read: `/src/main.rs`"),
        ("Read", {"file_path": "a", "offset": 5, "limit": 10}, "-> Read: `a` (lines 5-15)"),
        ("Read", {"limit": 10}, "-> Read: `?` (first 10 lines)"),
        ("Bash", {"command": "a" * 100}, "-> Bash: `" + "a" * 57 + "...`"),
        ("Bash", {"command": "x" * 56 + "’" + "tail" * 9}, "-> Bash: `" + "x" * 56 + "’...`"),
        ("exec_command", {"cmd": "ls"}, "-> Bash: `ls`"),
        ("Glob", {"pattern": "*.rs"}, "-> Search: `*.rs`"),
        ("apply_patch", {}, "-> Patch (apply_patch)"),
        ("WebSearch", {"query": "q"}, "-> WebSearch: `q`"),
        ("Other", {}, "-> Other"),
        ("Edit", {"_truncated": '{"file_path": "x", "y": {"z": 1...'}, "-> Edit: `x`"),
        ("Edit", {"_truncated": "nothing"}, "-> Edit: `?`"),
        ("Agent", {}, None),
    ],
)
def test_annotations(spark, name, given, line):
    row = spark.createDataFrame([(name, json.dumps(given))], "name string, payload string")
    assert row.select(assembly.annotation(F.col("name"), F.col("payload"))).first()[0] == line


def test_conversation_of_calls_alone_has_one_heading(spark):
    e = events(spark, ("user", "go"), ("tool_use", ("Read", '{"file_path":"a"}', "c1")), ("user", None), ("tool_use", ("Write", '{"file_path":"b"}', "c2")), ("user", "ok " + "y" * 100_000), ("assistant_text", " done \n"))
    got = [r.text for r in assembly.conversation(assembly.turn_blocks(e), "claude").orderBy("turn").collect()]
    assert got[0] == "### [00:00] User\ngo\n\n### [00:01] Claude\n-> Read: `a`" and got[1] == "-> Write: `b`\n"
    assert got[2].startswith("### [00:04] User\nok yyy") and "[... truncated from 100003 chars]" in got[2] and got[2].endswith("### [00:05] Claude\ndone\n") and len(got[2]) < 6_000


def test_totals_of_results_come_before_those_of_progress(spark):
    line = json.dumps({"type": "progress", "timestamp": "2024-03-07T10:00:00Z", "data": {"type": "agent_progress", "agentId": "agent123", "prompt": "Investigate", "totalTokens": 5}})
    records = children.progress(spark.createDataFrame([("f", 1, line)], "file string, ord long, line string"))
    said = [json.dumps({"agentId": "agent123", "totalTokens": 1200, "totalDurationMs": 3000, "totalToolUseCount": 4}), "agentId: other (x)\ntotal_tokens: 77", "no agent"]
    results = children.result_totals(events(spark, *(("tool_result", ("t", t)) for t in said)))
    assert sorted(map(tuple, results.collect())) == [("f", "agent123", 1200, 3000, 4), ("f", "other", 77, None, None)]
    got = children.progress_activity(records, results).first()
    assert (got.agent_id, got.tokens, got.millis, got.tools, got.files_read, got.tool_counts) == ("agent123", 1200, 3000, 4, [], {})


def test_last_lines_are_read_from_the_end(spark, tmp_path):
    text = {"a.jsonl": b"".join(b"line %d\n" % i for i in range(9_000)), "b.jsonl": b"one\n\nthree", "c.jsonl": b"", "d.jsonl": b"x" * 5_000 + b"\nlast\n", "e.jsonl": b"\n\n"}
    for name, data in text.items():
        (tmp_path / name).write_bytes(data)
    sizes = growing.log_sizes(spark, f"file://{tmp_path}", "*.jsonl")
    for n in (1, 3, 20):
        got = growing.last_lines(sizes, n, block=64).orderBy("file", "ord").collect()
        for name, data in text.items():
            have = [(r.ord, r.line) for r in got if r.file.endswith(name)]
            lines = data.decode().removesuffix("\n").split("\n") if data else []
            assert [x for _, x in have] == lines[-n:]
            assert all(data[o:].startswith(x.encode()) for o, x in have)
    assert max(r.bytes for r in got if r.file.endswith("a.jsonl")) < 400


def test_last_action(spark):
    use = lambda name, given: json.dumps({"type": "assistant", "timestamp": "t", "message": {"content": [{"type": "tool_use", "name": name, "input": given}]}})
    lines = lambda *x: spark.createDataFrame([("f", i, t) for i, t in enumerate(x)], "file string, ord long, line string")
    tail = lambda engine, *x: logs.runtime_tail(lines(*x), engine, 5).select("action", "summary").first()
    assert tail("claude", use("Read", {"path": "p"}), use("Bash", {"file_path": "f", "command": "z" * 130}), "{}") == ("Bash", "z" * 117 + "...")
    assert tail("claude", use("Odd", {"n": 1})) == ("Odd", '{"n":1}') and tail("claude", "{broken") == (None, None)
    call = json.dumps({"type": "response_item", "payload": {"type": "function_call", "name": "exec_command", "arguments": '{"cmd":"ls"}'}})
    assert tail("codex", call) == ("exec_command", "ls") and tail("gemini", call) == (None, None)


def test_a_second_run_writes_no_document(spark, tmp_path):
    root = f"file://{tmp_path}/docs"
    docs = lambda text: spark.createDataFrame([("claude", "abcdefgh1", datetime(2024, 3, 7, 10), text), ("codex", "x/y", datetime(2024, 3, 8), text), ("codex", "lost", None, text), ("claude", "abcdefgh2", datetime(2024, 3, 7, 9), text)], "engine string, id string, started_at timestamp, text string")
    files = lambda: {str(p.relative_to(tmp_path / "docs")): p.read_text() for p in (tmp_path / "docs").rglob("*") if p.is_file() and not p.name.startswith(".")}
    assert dated.write_dated(spark, docs("one"), root, "sessions") == {"written": 2, "kept": 1, "undated": 1}
    assert files() == {"claude/sessions/2024/03/07/abcdefgh.md": "one", "codex/sessions/2024/03/08/x_y.md": "one"}
    assert dated.write_dated(spark, docs("two"), root, "sessions") == {"written": 0, "kept": 3, "undated": 1}
    new = spark.createDataFrame([("x/y",)], "id string")
    assert dated.write_dated(spark, docs("two"), root, "sessions", fresh=new) == {"written": 1, "kept": 2, "undated": 1}
    assert set(files().values()) == {"one", "two"}


def test_turns_go_on_counting_after_a_restart(spark, tmp_path):
    schema = "session_id string, ord long, ts timestamp, kind string, usage_key string, text string, input long, output long, cache_read long, cache_creation long, reasoning long"
    at = f"file://{tmp_path}"
    parts = [[("s", 2, "usage", "k"), ("s", 1, "user", None), ("t", 1, "usage", None)], [("s", 4, "usage", "k"), ("s", 3, "user", None), ("t", 2, "usage", None)], [("s", 5, "usage", "k2"), ("t", 3, "stop", None)]]
    out = []
    for part in parts:
        rows = [(s, o, datetime(2024, 1, 1, o), k, u, f"end {o}", 5, 1, None, 2, 0) for s, o, k, u in part]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = streams.numbered_events(spark.readStream.schema(schema).parquet(f"{at}/in"))
        run = stream.writeStream.outputMode("update").foreachBatch(lambda b, n: out.extend(map(tuple, b.collect())))
        run.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    assert sorted(out) == [("s", 1, "user", 1, False), ("s", 2, "usage", 1, True), ("s", 3, "user", 2, False), ("s", 4, "usage", 2, False), ("s", 5, "usage", 2, True), ("t", 1, "usage", 0, True), ("t", 2, "usage", 0, True), ("t", 3, "stop", 0, False)]


def test_an_idle_session_is_closed(spark, tmp_path):
    schema = "session_id string, ord long, ts timestamp, kind string, usage_key string, text string, input long, output long, cache_read long, cache_creation long, reasoning long"
    at, out = f"file://{tmp_path}", []
    for hour, session in ((1, "old"), (5, "new"), (6, "new")):
        spark.createDataFrame([(session, hour, datetime(2024, 1, 1, hour), "user", None, None, 0, 0, 0, 0, 0)], schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = streams.session_rows(spark.readStream.schema(schema).parquet(f"{at}/in"), idle_seconds=3_600)
        run = stream.writeStream.outputMode("update").foreachBatch(lambda b, n: out.extend((r.session_id, r.turns, r.closed) for r in b.collect()))
        run.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    assert ("old", 1, False) in out and ("old", 1, True) in out and ("new", 2, False) in out and ("new", 2, True) not in out


def test_a_batch_that_is_done_again_writes_nothing(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    write = streams.upsert_once(store, "sessions", "session_id")
    df = lambda n: spark.createDataFrame([("s", n)], "session_id string, n int")
    write(df(1), 0)
    write(df(2), 1)
    write(df(3), 1)
    assert [tuple(r) for r in Store(spark, store).read("sessions").collect()] == [("s", 2)] and Store(spark, store).version == 2
