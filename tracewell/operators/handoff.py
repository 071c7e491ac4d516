"""Data work around session summaries: candidates, context, validation, extraction."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Word stems that make a fact look like a decision.
DECISION_STEMS = ("decid", "choose", "selected", "plan", "will", "next", "use ", "switch", "migrate")
CAPS = {"command": 40, "error": 20, "file": 40, "decision": 20}


def candidates(sessions: DataFrame, handoffs: DataFrame, *, min_turns: int, since: datetime | None = None) -> DataFrame:
    """Sessions without a summary that are long enough, to be taken newest first."""
    s = sessions.filter(F.col("total_turns") >= min_turns)
    if since is not None:
        s = s.filter(F.col("started_at") >= F.lit(since))
    return s.join(handoffs.select(F.col("session_id").alias("id")), "id", "left_anti").select("id", "engine", "started_at", "total_turns")


def looks_like_decision() -> Column:
    text = F.lower(F.concat_ws(" ", "subject", "detail"))
    out = F.lit(False)
    for stem in DECISION_STEMS:
        out = out | text.contains(stem)
    return F.col("fact_type").isin("user_prompt", "assistant_reply", "git_op") & out


def context(facts: DataFrame) -> DataFrame:
    """Per session and group: how many facts there are, how many are left out, and the text of those kept.

    Beyond a group's cap its first quarter and its last three quarters of the cap are kept.
    """
    group = F.when(looks_like_decision(), "decision").when(F.col("fact_type") == "command", "command").when(F.col("fact_type") == "error", "error").when(F.col("fact_type").isin("file_read", "file_write"), "file")
    f = facts.withColumn("grp", group).filter("grp IS NOT NULL")
    w = Window.partitionBy("session_id", "grp").orderBy("ts", "id")
    whole = Window.partitionBy("session_id", "grp")
    f = f.withColumns({"nth": F.row_number().over(w), "n": F.count("*").over(whole)})
    cap = F.create_map(*(F.lit(x) for k, v in CAPS.items() for x in (k, v)))[F.col("grp")]
    kept = (F.col("n") <= cap) | (F.col("nth") <= cap / 4) | (F.col("nth") > F.col("n") - (cap - F.floor(cap / 4)))
    text = F.substring(F.coalesce("detail", "subject"), 1, 400)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(kept, F.struct("nth", text.alias("t"))))), lambda x: x["t"]), "\n")
    return f.groupBy("session_id", "grp").agg(F.max("n").alias("n"), (F.max("n") - F.count_if(kept)).alias("skipped"), lines.alias("text"))


def invalid_reason() -> Column:
    """Why a summary's metadata is not acceptable; null if it is."""
    empty = lambda c: F.coalesce(F.size(c) <= 0, F.lit(True))
    return (
        F.when(F.octet_length(F.coalesce("headline", F.lit(""))) < 5, "headline too short")
        .when(~F.coalesce(F.col("substance").between(0, 3), F.lit(False)), "substance out of range")
        .when((F.col("substance") >= 1) & empty("projects"), "no projects")
        .when((F.col("substance") >= 1) & empty("keywords"), "no keywords")
    )


def extracted(replies: DataFrame) -> DataFrame:
    """``session_id, headline, projects, keywords, substance`` from a model's reply (``text``).

    The reply is JSON, or holds JSON in a fence, or has ``Headline:`` style lines.
    """
    fenced = F.regexp_extract("text", r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    schema = "headline string, projects array<string>, keywords array<string>, substance int"
    parsed = F.coalesce(F.from_json(F.when(F.trim("text").startswith("{"), F.trim("text")), schema), F.from_json(F.nullif(fenced, F.lit("")), schema))
    line = lambda name: F.nullif(F.trim(F.regexp_extract("text", rf"(?im)^\W*{name}\W*:\s*(.+)$", 1)), F.lit(""))
    items = lambda name: F.transform(F.split(line(name), ","), lambda x: F.trim(x))
    substance = F.coalesce(F.col("p.substance"), F.try_to_number(line("substance"), F.lit("99")).cast("int"), F.lit(0))
    return replies.withColumn("p", parsed).select(
        "session_id", F.coalesce("p.headline", line("headline")).alias("headline"), F.coalesce("p.projects", items("projects")).alias("projects"), F.coalesce("p.keywords", items("keywords")).alias("keywords"), F.greatest(F.lit(0), F.least(F.lit(3), substance)).alias("substance")
    )


def front_matter(sessions: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """``id``, the columns ``more`` that tell sessions of one id apart, and ``head``: the YAML head of each session's summary document."""
    minutes = F.floor((F.unix_timestamp(F.coalesce("ended_at", "last_event_at")) - F.unix_timestamp("started_at")) / 60)
    head = F.format_string("---\nid: %s\nengine: %s\ndate: %s\nduration_minutes: %d\n---\n", "id", "engine", F.date_format("started_at", "yyyy-MM-dd"), minutes)
    return sessions.select("id", *more, head.alias("head"))


def summary_input(sessions: DataFrame, transcripts: DataFrame, facts: DataFrame) -> DataFrame:
    """What a summary is written from: the transcript (``id, text``), else the session's context table."""
    ctx = context(facts).groupBy(F.col("session_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("grp", "text"))), lambda x: F.concat(x["grp"], F.lit(":\n"), x["text"])), "\n").alias("context"))
    return sessions.select("id").join(transcripts.select("id", "text"), "id", "left").join(ctx, "id", "left").select("id", F.coalesce("text", "context", F.lit("")).alias("text"))
