"""Log files of three agent engines as ordered records, and as one canonical event model.

Events have the columns of ``EVENT``: a record gives up to several events, in the order of ``sub_ord``.
Wrong types in a record are nulls: a value is taken only if the JSON has it as the type asked for.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT = "struct<kind:string,text:string,name:string,call_id:string,payload:string,model:string,is_error:boolean,usage_key:string,input:bigint,output:bigint,cache_read:bigint,cache_creation:bigint,reasoning:bigint>"
FIELDS = ("kind", "text", "name", "call_id", "payload", "model", "is_error", "usage_key", "input", "output", "cache_read", "cache_creation", "reasoning")
LONGS = FIELDS[8:]
# The third engine's tool names -> common names; others stay as they are.
TOOL_NAMES = {
    "read_file": "Read", "read_many_files": "Read", "write_file": "Write", "write_todos": "WriteTodos", "replace": "Edit", "edit_file": "Edit", "run_shell_command": "Bash",
    "list_directory": "Glob", "glob": "Glob", "grep_search": "Grep", "google_web_search": "WebSearch", "web_fetch": "WebFetch", "save_memory": "SaveMemory", "get_internal_docs": "GetInternalDocs",
    "update_topic": "UpdateTopic", "complete_task": "CompleteTask", "ask_user": "AskUser", "cli_help": "CliHelp", "codebase_investigator": "CodebaseInvestigator", "activate_skill": "ActivateSkill",
    "enter_plan_mode": "EnterPlanMode", "exit_plan_mode": "ExitPlanMode",
}


# The record types by which the first engine's logs are known.
TYPES_A = ("user", "assistant", "queue-operation", "progress", "system", "file-history-snapshot")


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def text_at(v: Column, path: str) -> Column:
    """The string at a path, null where something else stands there."""
    return F.when(F.schema_of_variant(at(v, path)) == "STRING", F.try_variant_get(v, path, "string"))


def long_at(v: Column, path: str) -> Column:
    return F.when(F.schema_of_variant(at(v, path)) == "BIGINT", F.try_variant_get(v, path, "bigint"))


def bool_at(v: Column, path: str) -> Column:
    return F.when(F.schema_of_variant(at(v, path)) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def list_at(v: Column, path: str) -> Column:
    return F.coalesce(F.when(F.schema_of_variant(at(v, path)).startswith("ARRAY"), F.try_variant_get(v, path, "array<variant>")), F.expr("CAST(array() AS ARRAY<VARIANT>)"))


def json_at(v: Column, path: str) -> Column:
    """JSON text of whatever stands at a path."""
    return F.to_json(at(v, path))


def event(kind: str | Column, **values: Column) -> Column:
    """One event as a struct; a null ``kind`` drops it."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    types = {"is_error": "boolean", **{c: "bigint" for c in LONGS}}
    return F.struct(kind.alias("kind"), *(values.get(c, F.lit(None)).cast(types.get(c, "string")).alias(c) for c in FIELDS[1:]))


def only(condition: Column, e: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), e)


def read_lines(spark: SparkSession, root: str, glob: str, *, recursive: bool = False, since: datetime | None = None) -> DataFrame:
    """``file, mtime, size, ord, line`` of text logs; ``ord`` puts a file's lines in order, whatever the splits.

    ``since`` leaves out files whose time is more than ten seconds before it. Empty files have no rows.
    """
    reader = spark.read.option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if since is not None:
        reader = reader.option("modifiedAfter", (since - timedelta(seconds=11)).strftime("%Y-%m-%dT%H:%M:%S"))
    # A large log is read in splits by many tasks. A task's rows hold a byte at least each, so its row number stays
    # below the size of a split, and the sum with the split's start grows from line to line of a file.
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    meta = {"file": "file_path", "mtime": "file_modification_time", "size": "file_size"}
    lines = reader.text(root).select(*(F.col(f"_metadata.{v}").alias(k) for k, v in meta.items()), (F.col("_metadata.file_block_start") + nth).alias("ord"), F.col("value").alias("line"))
    return lines.filter("line <> ''")


def engine_a(spark: SparkSession, root: str, since: datetime | None = None) -> DataFrame:
    """Logs of the first engine, one folder deep; child logs and empty files are left out."""
    lines = read_lines(spark, f"{root}/*/", "*.[jJ][sS][oO][nN][lL]", since=since)
    return lines.filter(~F.regexp_extract("file", "([^/]+)$", 1).startswith("agent-"))


def engine_b(spark: SparkSession, root: str, since: datetime | None = None) -> DataFrame:
    return read_lines(spark, root, "rollout-*.jsonl", recursive=True, since=since)


def engine_c(spark: SparkSession, root: str, since: datetime | None = None) -> DataFrame:
    """The third engine's documents, one row each; those that are no JSON are left out."""
    reader = spark.read.option("pathGlobFilter", "session-*.json")
    if since is not None:
        reader = reader.option("modifiedAfter", (since - timedelta(seconds=11)).strftime("%Y-%m-%dT%H:%M:%S"))
    t = reader.text(f"{root}/*/chats/", wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    return t.filter("v IS NOT NULL")


def child_logs(spark: SparkSession, root: str) -> DataFrame:
    """``file, parent_dir, agent_id, size`` of all child logs below a root."""
    t = spark.read.option("pathGlobFilter", "agent-*.jsonl").format("binaryFile").load(f"{root}/*/*/subagents/")
    return t.select(F.col("path").alias("file"), F.regexp_extract("path", "(.*)/subagents/[^/]*$", 1).alias("parent_dir"), F.regexp_extract("path", r"agent-(.*)\.jsonl$", 1).alias("agent_id"), F.col("length").alias("size"))


def _timed(df: DataFrame, path: str = "$.timestamp") -> DataFrame:
    return df.withColumn("ts", F.try_to_timestamp(text_at(F.col("v"), path)))


def _spread(df: DataFrame, events: Column) -> DataFrame:
    """One row per event."""
    spread = df.select("file", "ord", "ts", F.posexplode(F.filter(events, lambda e: e["kind"].isNotNull())).alias("sub_ord", "e"))
    return spread.select("file", "ord", "sub_ord", "ts", "e.*")


def _result_text(b: Column, path: str) -> Column:
    """A tool result's text: a string as it is, the text parts of an array by lines, else JSON."""
    parts = F.array_compact(F.transform(list_at(b, path), lambda x: text_at(x, "$.text")))
    return F.coalesce(text_at(b, path), F.when(F.size(parts) > 0, F.array_join(parts, "\n")), json_at(b, path))


def model_name(m: Column) -> Column:
    return F.when((m != "") & ~m.startswith("<"), m)


def events_a(lines: DataFrame) -> DataFrame:
    """Canonical events of the first engine's lines; broken lines give none. Only a log's first record of metadata counts."""
    out = parsed_a(lines)
    # The window shares its shuffle with what groups by file next.
    first = F.min(F.when(F.col("kind") == "meta", F.col("ord"))).over(Window.partitionBy("file"))
    return out.withColumn("first_meta", first).filter((F.col("kind") != "meta") | (F.col("ord") == F.col("first_meta"))).drop("first_meta")


def parsed_a(lines: DataFrame) -> DataFrame:
    """Each line's events by itself, as :func:`events_a` has them but with all records of metadata."""
    df = _timed(lines.withColumn("v", F.try_parse_json("line")).filter("v IS NOT NULL"))
    v = F.col("v")
    kind, model = text_at(v, "$.type"), model_name(F.coalesce(text_at(v, "$.model"), text_at(v, "$.message.model")))
    content = list_at(v, "$.message.content")
    plain = text_at(v, "$.message.content")
    block_text = lambda b: F.coalesce(F.when(F.schema_of_variant(b) == "STRING", b.cast("string")), F.when(text_at(b, "$.type") == "text", text_at(b, "$.text")))
    texts = F.concat(F.array_compact(F.array(plain)), F.array_compact(F.transform(content, block_text)))
    first = F.get(F.filter(F.transform(texts, lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")), lambda t: t != ""), F.lit(0))

    def block(b: Column) -> Column:
        shape = text_at(b, "$.type")
        text = block_text(b)
        use = event("tool_use", name=text_at(b, "$.name"), call_id=text_at(b, "$.id"), payload=json_at(b, "$.input"))
        result = event("tool_result", text=_result_text(b, "$.content"), call_id=text_at(b, "$.tool_use_id"), is_error=bool_at(b, "$.is_error"))
        return F.when((shape == "tool_use") & (kind == "assistant"), use).when(shape == "tool_result", result).when(text.isNotNull() & (kind == "assistant"), event("assistant_text", text=text, model=model)).otherwise(event(F.lit(None).cast("string")))

    u = lambda name: long_at(v, f"$.message.usage.{name}")
    usage = event("usage", usage_key=text_at(v, "$.message.id"), input=F.coalesce(u("input_tokens"), F.lit(0)), output=F.coalesce(u("output_tokens"), F.lit(0)), cache_read=F.coalesce(u("cache_read_input_tokens"), F.lit(0)), cache_creation=F.coalesce(u("cache_creation_input_tokens"), F.lit(0)), reasoning=F.coalesce(u("reasoning_tokens"), F.lit(0)))
    fixed = F.array(
        only(F.coalesce(text_at(v, "$.sessionId"), text_at(v, "$.cwd"), text_at(v, "$.version"), model).isNotNull(), event("meta", name=text_at(v, "$.sessionId"), text=text_at(v, "$.cwd"), payload=text_at(v, "$.version"), model=model)),
        only(at(v, "$.message.usage").isNotNull(), usage),
        only(text_at(v, "$.message.stop_reason").isNotNull(), event("stop", text=text_at(v, "$.message.stop_reason"))),
        only(kind == "user", event("user", text=first)),
        only((kind == "assistant") & plain.isNotNull(), event("assistant_text", text=plain, model=model)),
        only(kind == "summary", event("summary", text=text_at(v, "$.summary"))),
    )
    blocks = F.when(kind.isin("user", "assistant"), F.transform(content, block)).otherwise(F.expr(f"CAST(array() AS ARRAY<{EVENT}>)"))
    return _spread(df, F.concat(F.array_compact(fixed), blocks))


def is_closing() -> Column:
    """A message that closes a task; it often repeats what was said before."""
    return F.coalesce((F.col("kind") == "assistant_text") & (F.col("name") == "task_complete"), F.lit(False))


def said_key() -> Column:
    """What stands for the text of a reply, null for other events."""
    return F.when(F.col("kind") == "assistant_text", F.sha2("text", 256))


def events_b(lines: DataFrame) -> DataFrame:
    """Canonical events of the second engine's lines.

    A closing message that was said before in the session is dropped; its stop signal stays.
    """
    # Dealt out by file first: the window over a file's equal texts and those of what follows need no further shuffle.
    out = parsed_b(lines).repartition("file").withColumn("said", said_key())
    said_at = F.min("ord").over(Window.partitionBy("file", "said"))
    return out.withColumn("said_at", said_at).filter(~(is_closing() & (F.col("said_at") < F.col("ord")))).drop("said", "said_at")


def parsed_b(lines: DataFrame) -> DataFrame:
    """Each line's events by itself, as :func:`events_b` has them but with all closing messages."""
    df = _timed(lines.withColumn("v", F.try_parse_json("line")).filter("v IS NOT NULL"))
    v = F.col("v")
    kind, sub = text_at(v, "$.type"), text_at(v, "$.payload.type")
    p = lambda name: text_at(v, f"$.payload.{name}")
    n = lambda name: F.coalesce(long_at(v, f"$.payload.info.last_token_usage.{name}"), F.lit(0))
    is_msg, is_item = kind == "event_msg", kind == "response_item"
    cached = F.greatest(n("cached_input_tokens"), n("cache_read_input_tokens"))
    total = long_at(v, "$.payload.info.total_token_usage.total_tokens")
    usage = event("usage", usage_key=F.concat(F.lit("codex_tc_"), total.cast("string")), input=F.greatest(n("input_tokens") - cached, F.lit(0)), output=n("output_tokens"), cache_read=cached, cache_creation=F.lit(0), reasoning=n("reasoning_output_tokens"))
    u = lambda name: F.coalesce(long_at(v, f"$.payload.usage.{name}"), F.lit(0))
    item_cached = F.greatest(u("cached_input_tokens"), u("cache_read_input_tokens"))
    item_usage = event("usage", usage_key=F.coalesce(p("id"), p("call_id")), input=F.greatest(u("input_tokens") - item_cached, F.lit(0)), output=u("output_tokens"), cache_read=item_cached, cache_creation=F.lit(0), reasoning=u("reasoning_output_tokens"))
    # Arguments are JSON inside a string, or plain text.
    raw = F.coalesce(p("arguments"), p("input"))
    arguments = F.coalesce(F.to_json(F.try_parse_json(raw)), raw, json_at(v, "$.payload.arguments"), json_at(v, "$.payload.input"))
    said = p("last_agent_message")
    events = F.array(
        only(kind == "session_meta", event("meta", name=p("id"), text=p("cwd"), payload=p("cli_version"), call_id=p("forked_from_id"))),
        only(kind == "turn_context", event("meta", text=p("cwd"), model=p("model"))),
        only(is_msg & (sub == "user_message"), event("user", text=F.coalesce(p("message"), json_at(v, "$.payload.message")))),
        only(is_msg & (sub == "agent_message"), event("assistant_text", text=F.coalesce(p("message"), json_at(v, "$.payload.message")), model=p("model"))),
        only(is_msg & (sub == "token_count") & at(v, "$.payload.info.last_token_usage").isNotNull(), usage),
        only(is_msg & (sub == "task_complete") & said.isNotNull(), event("assistant_text", text=said, name=F.lit("task_complete"))),
        only(is_msg & (sub == "task_complete"), event("stop", text=F.coalesce(p("stop_reason"), p("reason"), F.lit("task_complete")))),
        only(is_item & (F.schema_of_variant(at(v, "$.payload.usage")) != "VOID"), item_usage),
        only(is_item & sub.isin("function_call", "custom_tool_call"), event("tool_use", name=p("name"), call_id=p("call_id"), payload=arguments)),
        only(is_item & sub.isin("function_call_output", "custom_tool_call_output"), event("tool_result", call_id=p("call_id"), text=F.coalesce(p("output"), json_at(v, "$.payload.output")), is_error=bool_at(v, "$.payload.is_error"))),
    )
    return _spread(df, F.array_compact(events))


def events_c(documents: DataFrame) -> DataFrame:
    """Canonical events of the third engine's documents."""
    doc = documents.select("file", F.col("v").alias("d"))
    head = F.array(event("meta", name=text_at(F.col("d"), "$.sessionId")), only(text_at(F.col("d"), "$.summary").isNotNull(), event("summary", text=text_at(F.col("d"), "$.summary"))))
    first = _spread(doc.select("file", F.lit(-1).alias("ord"), F.try_to_timestamp(text_at(F.col("d"), "$.startTime")).alias("ts"), "d"), F.array_compact(head))
    df = _timed(doc.select("file", F.posexplode(list_at(F.col("d"), "$.messages")).alias("ord", "v")))
    v = F.col("v")
    kind, model = text_at(v, "$.type"), text_at(v, "$.model")
    parts = F.array_join(F.array_compact(F.transform(list_at(v, "$.content"), lambda x: text_at(x, "$.text"))), "\n")
    content = F.coalesce(text_at(v, "$.content"), F.nullif(parts, F.lit("")), json_at(v, "$.content"))
    thought = lambda t: F.concat(F.lit("[Thought: "), F.coalesce(text_at(t, "$.subject"), F.lit("")), F.lit("] "), F.coalesce(text_at(t, "$.description"), F.lit("")))
    said = F.array_join(F.concat(F.transform(list_at(v, "$.thoughts"), thought), F.array_compact(F.array(F.nullif(content, F.lit(""))))), "\n")
    names = F.create_map(*(F.lit(x) for k, t in TOOL_NAMES.items() for x in (k, t)))
    name = lambda t: F.coalesce(names[text_at(t, "$.name")], text_at(t, "$.name"))
    answer = lambda t: F.array_join(F.array_compact(F.transform(list_at(t, "$.result"), lambda r: F.coalesce(text_at(r, "$.functionResponse.response.output"), text_at(r, "$.functionResponse.response.error")))), "\n")
    calls = F.flatten(F.transform(list_at(v, "$.toolCalls"), lambda t: F.array(event("tool_use", name=name(t), call_id=text_at(t, "$.id"), payload=json_at(t, "$.args")), event("tool_result", text=answer(t), call_id=text_at(t, "$.id"), is_error=text_at(t, "$.status") != "success"))))
    k = lambda n: F.coalesce(long_at(v, f"$.tokens.{n}"), F.lit(0))
    usage = event("usage", usage_key=text_at(v, "$.id"), input=k("input"), output=k("output"), cache_read=k("cached"), cache_creation=F.lit(0), reasoning=k("thoughts"))
    note = kind.isin("info", "warning")
    cancelled = (kind == "info") & F.lower(content).contains("cancel")
    events = F.concat(
        F.array_compact(
            F.array(
                only(kind == "user", event("user", text=content)),
                only((kind == "gemini") & (said != ""), event("assistant_text", text=said, model=model)),
                only((kind == "error") | cancelled, event("stop", text=F.coalesce(content, kind))),
                only(note & ~F.coalesce(cancelled, F.lit(False)) & (content != ""), event("assistant_text", text=F.concat(F.lit("["), F.initcap(kind), F.lit("] "), content))),
                only((kind == "gemini") & at(v, "$.tokens").isNotNull(), usage),
            )
        ),
        F.when(kind == "gemini", calls).otherwise(F.expr(f"CAST(array() AS ARRAY<{EVENT}>)")),
    )
    return first.unionByName(_spread(df, events))


def detect_engine(lines: DataFrame) -> DataFrame:
    """``file, engine`` by the first known record among a file's first ten lines, else by its path, else null."""
    v = F.try_parse_json("line")
    kind = text_at(v, "$.type")
    has = lambda name: at(v, f"$.{name}").isNotNull()
    known = F.when(kind.isin("session_meta", "turn_context", "event_msg", "response_item"), "codex").when(has("sessionId") & has("projectHash") & has("messages"), "gemini").when(kind.isin(*TYPES_A), "claude")
    w = Window.partitionBy("file").orderBy("ord")
    head = lines.withColumn("n", F.row_number().over(w)).filter("n <= 10").withColumn("engine", known)
    path = F.when(F.col("file").contains("/.claude/projects/"), "claude").when(F.col("file").contains("/.codex/sessions/"), "codex").when(F.col("file").contains("/.gemini/tmp/"), "gemini")
    return head.groupBy("file").agg(F.min_by("engine", F.when(F.col("engine").isNotNull(), F.col("ord"))).alias("e")).select("file", F.coalesce("e", path).alias("engine"))


def log_heads(lines: DataFrame, engine: str, n: int = 30) -> DataFrame:
    """``file, session_uid, model, cwd, started_at, forked_from``: the first of each that a log's first ``n`` lines name.

    The start is text, as the log has it; in the first engine's logs the time of a snapshot will do. Broken lines count
    among the first, but say nothing. Each task keeps a log's first lines only before they are shuffled.
    """
    order = Window.partitionBy("file").orderBy("ord")
    v = F.try_parse_json("line")
    any_of = lambda *paths: F.coalesce(*(text_at(v, p) for p in paths))
    if engine == "codex":
        found = {"session_uid": any_of("$.payload.id", "$.session_id"), "model": any_of("$.payload.model"), "cwd": any_of("$.payload.cwd", "$.cwd"), "started_at": any_of("$.payload.timestamp", "$.timestamp"), "forked_from": any_of("$.payload.forked_from_id")}
    else:
        found = {"session_uid": any_of("$.sessionId"), "model": any_of("$.message.model"), "cwd": any_of("$.cwd"), "started_at": any_of("$.timestamp", "$.snapshot.timestamp"), "forked_from": F.lit(None).cast("string")}
    head = lines.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= n).select("file", "ord", *(x.alias(c) for c, x in found.items()))
    return head.groupBy("file").agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c) for c in found))


def document_heads(documents: DataFrame) -> DataFrame:
    """The same of the third engine's documents: its first message's model, and no folder."""
    v = F.col("v")
    models = F.array_compact(F.transform(list_at(v, "$.messages"), lambda m: text_at(m, "$.model")))
    none = F.lit(None).cast("string")
    return documents.select("file", text_at(v, "$.sessionId").alias("session_uid"), F.get(models, F.lit(0)).alias("model"), none.alias("cwd"), text_at(v, "$.startTime").alias("started_at"), none.alias("forked_from"))


def needle_scan(lines: DataFrame, token: str) -> DataFrame:
    """Files with a tool output that is the token, trimmed; the first line of each. The parse sees few lines."""
    v = F.try_parse_json("line")
    outputs = F.array(text_at(v, "$.toolUseResult.stdout"), F.when(text_at(v, "$.payload.type") == "exec_command_end", text_at(v, "$.payload.aggregated_output")))
    blocks = F.transform(F.filter(list_at(v, "$.message.content"), lambda b: text_at(b, "$.type") == "tool_result"), lambda b: text_at(b, "$.content"))
    found = F.exists(F.array_compact(F.concat(outputs, blocks)), lambda t: F.trim(F.regexp_replace(t, r"(?U)^\s+|\s+$", "")) == token)
    return lines.filter(F.col("line").contains(token)).filter(F.coalesce(found, F.lit(False))).groupBy("file").agg(F.min("ord").alias("ord"))


def import_summaries(spark: SparkSession, path: str) -> DataFrame:
    """A summary index in JSON: an array, ``entries``, a ``handoffs`` map or a plain map; keys have aliases."""
    v = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    listed = F.concat(list_at(F.col("v"), "$"), list_at(F.col("v"), "$.entries"))
    from_list = v.select(F.explode(listed).alias("e")).select(F.lit(None).cast("string").alias("key"), "e")
    as_map = F.coalesce(F.try_variant_get("v", "$.handoffs", "map<string,variant>"), F.when(at(F.col("v"), "$.entries").isNull(), F.try_variant_get("v", "$", "map<string,variant>")))
    from_map = v.select(F.explode(as_map).alias("key", "e"))
    e = F.col("e")
    any_of = lambda *names: F.coalesce(*(text_at(e, f"$.{n}") for n in names))
    items = lambda *names: F.coalesce(*(F.try_variant_get(e, f"$.{n}", "array<string>") for n in names), *(F.transform(F.split(text_at(e, f"$.{n}"), ","), lambda x: F.trim(x)) for n in names))
    both = from_list.unionByName(from_map)
    plain = {"engine": ("engine",), "model": ("model",), "cwd": ("cwd",), "started_at": ("started_at", "startedAt"), "generated_at": ("generated_at", "generatedAt")}
    out = both.select(F.coalesce(any_of("session_id", "sessionId", "id"), "key").alias("session_id"), any_of("headline", "title").alias("headline"), items("projects", "project").alias("projects"), items("keywords", "tags").alias("keywords"), F.coalesce(long_at(e, "$.substance"), F.lit(0)).alias("substance"), any_of("content_path", "path").alias("content_path"), *(any_of(*names).alias(c) for c, names in plain.items()))
    return out.filter("session_id IS NOT NULL")


def imported(entries: DataFrame, sessions: DataFrame, handoffs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions and handoffs after the ``entries`` of :func:`import_summaries` are taken in, and ``imported, skipped`` counts.

    An entry whose session has a summary is skipped; of several for one session the first by headline counts. A session that isn't
    known gets a row of its own, with the start that the entry names and the first engine unless it names the second.
    """
    there = handoffs.select("session_id").distinct()
    new = entries.join(there, "session_id", "left_anti").groupBy("session_id").agg(F.min_by(F.struct(*(c for c in entries.columns if c != "session_id")), F.struct(F.col("headline").isNull(), "headline")).alias("e")).select("session_id", "e.*")
    start = F.coalesce("started_at", "generated_at").try_cast("timestamp")
    known = F.lower(F.trim("engine"))
    made = {"id": F.col("session_id"), "engine": F.when(known.isin("claude", "codex"), known).otherwise("claude"), "session_type": F.lit("standalone"), "started_at": start, "ended_at": start, "last_event_at": start, "model": F.col("model"), "cwd": F.col("cwd")}
    zero = lambda c: F.lit(0 if sessions.schema[c].dataType.simpleString() in ("bigint", "int") else None).cast(sessions.schema[c].dataType)
    stubs = new.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_anti").select(*(made.get(c, zero(c)).cast(sessions.schema[c].dataType).alias(c) for c in sessions.columns))
    added = new.select(*(F.col(c).cast(handoffs.schema[c].dataType).alias(c) if c in new.columns else F.lit(None).cast(handoffs.schema[c].dataType).alias(c) for c in handoffs.columns))
    both = entries.agg(F.count("*").alias("all")).join(new.agg(F.count("*").alias("imported")))
    return sessions.unionByName(stubs), handoffs.unionByName(added), both.select("imported", (F.col("all") - F.col("imported")).alias("skipped"))


def document_paths(entries: DataFrame, existing: DataFrame, home: str, roots: list[str]) -> DataFrame:
    """``session_id, content_path, path``: where the document of an imported summary is, null where nowhere.

    ``entries`` has ``session_id, content_path, started_at, generated_at`` (times as text), ``existing`` the ``path`` of
    all documents. The path given comes first, then with its ``~`` as ``home``, then the dated path below each root;
    without any time there is no dated path. Equal entries give one row.
    """
    given, day = F.trim("content_path"), F.coalesce("started_at", "generated_at")
    parts = F.split(F.when(F.length(day) >= 10, F.substring(day, 1, 10)).when(day.isNotNull(), "1970-01-01"), "-")
    dated = F.concat_ws("/", F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit("01")), F.coalesce(F.get(parts, F.lit(2)), F.lit("01")), F.concat("session_id", F.lit(".md")))
    below = [F.when(parts.isNotNull(), F.concat(F.lit(f"{r}/"), dated)) for r in roots]
    places = F.array(given, F.when(given.startswith("~/"), F.concat(F.lit(f"{home}/"), F.substr(given, F.lit(3)))), *below)
    there = existing.select("path").distinct().withColumn("there", F.lit(True))
    tried = entries.select("session_id", "content_path", "started_at", "generated_at", F.posexplode(places).alias("nth", "path")).join(there, "path", "left")
    found = tried.groupBy("session_id", "content_path", "started_at", "generated_at").agg(F.min_by("path", F.when(F.col("there"), F.col("nth"))).alias("path"))
    return found.select("session_id", "content_path", "path")


def discovered(logs: list[DataFrame], engine: str | None = None, since: str | None = None) -> DataFrame:
    """The sessions (``engine, id, started_at``) of all engines, or one, newest first, those without a start last.

    ``since`` leaves out those that began before it; an unknown start passes.
    """
    out = logs[0]
    for more in logs[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    if engine is not None:
        out = out.filter(F.col("engine") == engine)
    if since is not None:
        out = out.filter(F.col("started_at").isNull() | (F.col("started_at") >= since))
    return out.orderBy(F.col("started_at").desc_nulls_last(), "id")


def inline_tools(lines: DataFrame) -> DataFrame:
    """The files of the first engine whose replies hold tool calls."""
    v = F.try_parse_json("line")
    calls = F.exists(list_at(v, "$.message.content"), lambda b: F.coalesce(text_at(b, "$.type") == "tool_use", F.lit(False)))
    return lines.filter(F.col("line").contains("tool_use")).filter((text_at(v, "$.type") == "assistant") & calls).select("file").distinct()


# The keys of a call's input that say what it is about, the first one present counts.
ABOUT = ("file_path", "path", "file", "command", "cmd", "url", "query", "directory", "dir", "cwd")


def last_call(v: Column, engine: str) -> Column:
    """``name, summary`` of a record's last call with a name, null where it has none."""
    if engine == "claude":
        calls = F.when(text_at(v, "$.type") == "assistant", F.transform(F.filter(list_at(v, "$.message.content"), lambda b: F.coalesce(text_at(b, "$.type") == "tool_use", F.lit(False))), lambda b: F.struct(F.coalesce(text_at(b, "$.name"), F.lit("tool")).alias("name"), at(b, "$.input").alias("i"))))
    elif engine == "codex":
        sub = text_at(v, "$.payload.type")
        given = F.when(sub == "function_call", text_at(v, "$.payload.arguments")).otherwise(text_at(v, "$.payload.input"))
        call = F.struct(F.coalesce(text_at(v, "$.payload.name"), F.lit("tool")).alias("name"), F.try_parse_json(given).alias("i"))
        calls = F.when((text_at(v, "$.type") == "response_item") & sub.isin("function_call", "custom_tool_call"), F.array(call))
    else:
        return F.lit(None).cast("struct<name:string,summary:string>")

    def told(c: Column) -> Column:
        i = c["i"]
        first = lambda keys: F.coalesce(*(text_at(i, f"$.{k}") for k in keys))
        nothing = i.isNull() | F.coalesce(F.schema_of_variant(i) == "VOID", F.lit(False))
        about = F.coalesce(F.when(c["name"].isin("Bash", "exec_command"), first(("command", "cmd"))), first(ABOUT), F.when(~nothing, F.to_json(i)), F.lit("tool call"))
        return F.struct(c["name"].alias("name"), F.when(F.char_length(about) > 120, F.concat(F.substring(about, 1, 117), F.lit("..."))).otherwise(about).alias("summary"))

    named = F.filter(F.transform(calls, told), lambda c: c["name"] != "")
    return F.try_element_at(named, F.lit(-1))


def runtime_tail(lines: DataFrame, engine: str, n: int) -> DataFrame:
    """``file, session_uid, last_event, action, summary, samples`` from the last ``n`` lines of each log of one engine.

    The id is the first that these lines name, the time the last; the action is the last call (its tool and what it is
    about). A sample (``ts, tokens, input_tokens``) stands for each use of tokens with a time, in order; the third engine has
    neither calls nor samples. Broken lines count, but say nothing. :func:`.growing.last_lines` reads no more lines than these.
    """
    newest = Window.partitionBy("file").orderBy(F.desc("ord"))
    tail = lines.withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= n)
    v = F.try_parse_json("line")
    ts = F.coalesce(text_at(v, "$.timestamp"), text_at(v, "$.payload.timestamp"))
    if engine == "codex":
        uid, at_usage = F.coalesce(text_at(v, "$.payload.id"), text_at(v, "$.session_id")), "$.payload.info.last_token_usage"
        inputs, counts = ("input_tokens", "cached_input_tokens"), text_at(v, "$.payload.type") == "token_count"
    else:
        uid, at_usage = text_at(v, "$.sessionId"), "$.message.usage"
        inputs, counts = ("input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"), F.lit(engine == "claude")
    used = lambda name: F.coalesce(long_at(v, f"{at_usage}.{name}"), F.lit(0))
    read = tail.select("file", "ord", uid.alias("uid"), ts.alias("ts"), last_call(v, engine).alias("call"), counts.alias("counts"), sum(map(used, inputs[1:]), used(inputs[0])).alias("read"), used("output_tokens").alias("output"))
    sample = F.when(F.col("counts") & F.col("ts").isNotNull() & (F.col("read") + F.col("output") > 0), F.struct("ord", "ts", (F.col("read") + F.col("output")).alias("tokens"), F.col("read").alias("input_tokens")))
    samples = F.transform(F.array_sort(F.collect_list(sample)), lambda x: x.dropFields("ord"))
    given = lambda c: F.when(F.col(c).isNotNull(), F.col("ord"))
    return read.groupBy("file").agg(F.min_by("uid", given("uid")).alias("session_uid"), F.max_by("ts", given("ts")).alias("last_event"), F.max_by("call", given("call")).alias("call"), samples.alias("samples")).select("file", "session_uid", "last_event", F.col("call.name").alias("action"), F.col("call.summary").alias("summary"), "samples")
