"""Fleet listing: filters, sorts, totals, headlines, tags, status, id resolution."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_ci, cut_field, date_parts, estimated_cost, short_id


def cost(prefix: str = "") -> Column:
    names = ("model", "total_input_tokens", "total_output_tokens", "cache_read_tokens", "cache_creation_tokens", "reasoning_tokens")
    return estimated_cost(*(F.col(prefix + n) for n in names))


def duration_seconds(as_of: datetime) -> Column:
    """Whole seconds from start to end, or to ``as_of`` for open sessions; never negative."""
    end = F.coalesce("ended_at", F.lit(as_of).cast("timestamp"))
    return F.greatest(F.unix_timestamp(end) - F.unix_timestamp("started_at"), F.lit(0))


def list_sessions(
    sessions: DataFrame,
    *,
    as_of: datetime,
    engine: str | None = None,
    session_type: str | None = None,
    subagent_type: str | None = None,
    since: datetime | None = None,
    before: datetime | None = None,
    cwd: str | None = None,
    hide_children: bool = False,
    tags: DataFrame | None = None,
    any_tag: str | None = None,
    all_tags: tuple[str, ...] = (),
    show_all: bool = False,
    sort: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Sessions with ``duration_secs`` and ``cost``; noise (no tools, under 30 s) goes unless ``show_all``.

    Filters come before the limit. ``sort``: started, ended, tokens, cost or duration, descending. With neither it nor a
    limit the rows are in no order; a limit alone takes the latest starts.
    """
    df = sessions
    for wanted, column in ((engine, "engine"), (session_type, "session_type"), (subagent_type, "subagent_type")):
        if wanted is not None:
            df = df.filter(F.col(column) == wanted)
    if since is not None:
        df = df.filter(F.col("started_at") >= F.lit(since))
    if before is not None:
        df = df.filter(F.col("started_at") <= F.lit(before))
    if cwd is not None:
        df = df.filter(contains_ci(F.col("cwd"), cwd))
    if hide_children:
        df = df.filter(F.col("session_type") != "subagent")
    if any_tag is not None:
        df = df.join(tags.filter(F.col("tag") == any_tag), df["id"] == tags["session_id"], "left_semi")
    if all_tags:
        having = tags.filter(F.col("tag").isin(*all_tags)).groupBy("session_id").agg(F.count_distinct("tag").alias("n")).filter(F.col("n") == len(set(all_tags)))
        df = df.join(having, df["id"] == having["session_id"], "left_semi")
    df = df.withColumns({"duration_secs": duration_seconds(as_of), "cost": cost()})
    if not show_all:
        df = df.filter(~((F.col("total_tools") == 0) & (F.col("duration_secs") < 30)))
    if sort is None and limit is None:
        return df
    key = {"started": F.col("started_at"), "ended": F.col("ended_at"), "tokens": F.col("total_input_tokens") + F.col("total_output_tokens"), "cost": F.col("cost"), "duration": F.col("duration_secs")}[sort or "started"]
    df = df.orderBy(key.desc_nulls_last(), "id")
    return df if limit is None else df.limit(max(1, limit))


def totals(sessions: DataFrame) -> DataFrame:
    """Sessions, tokens and cost per engine and (engine null, ``level`` all) over everything, in one pass."""
    rows = sessions.withColumn("cost", cost())
    sums = [F.count("*").alias("sessions"), F.sum("total_input_tokens").alias("tokens_in"), F.sum("total_output_tokens").alias("tokens_out"), (F.round(F.sum("cost") * 100) / 100).alias("cost")]
    out = rows.groupingSets([[F.col("engine")], []], F.col("engine")).agg(F.grouping("engine").alias("g"), *sums)
    return out.select(F.when(F.col("g") == 1, "all").otherwise(F.col("engine")).alias("level"), "engine", "sessions", "tokens_in", "tokens_out", "cost")


def first_prompts(facts: DataFrame) -> DataFrame:
    order = F.struct(F.coalesce("turn_number", F.lit(0)).alias("t"), "ts", "id")
    return facts.filter(F.col("fact_type") == "user_prompt").groupBy("session_id").agg(F.min_by("detail", order).alias("first_prompt"))


def headlines(sessions: DataFrame, facts: DataFrame, handoffs: DataFrame, descriptions: DataFrame | None = None) -> DataFrame:
    """``id, headline``: the summary's headline, the parent's description, the log's summary or the first prompt."""
    df = sessions.select("id", "root_summary").join(handoffs.select(F.col("session_id").alias("id"), F.col("headline").alias("h")), "id", "left")
    df = df.join(first_prompts(facts).withColumnRenamed("session_id", "id"), "id", "left")
    described = F.lit(None).cast("string")
    if descriptions is not None:
        df = df.join(descriptions.select(F.col("session_id").alias("id"), "description"), "id", "left")
        described = F.col("description")
    text = F.coalesce(F.nullif(F.trim("h"), F.lit("")), described, "root_summary", "first_prompt")
    return df.select("id", cut_field(F.replace(text, F.lit("\n"), F.lit(" ")), 60).alias("headline"))


def query_window(sessions: DataFrame, as_of: datetime, since: datetime | None = None, before: datetime | None = None) -> DataFrame:
    """One row: from (``since``, else the earliest start, else ten days back) and to."""
    start = F.lit(since).cast("timestamp") if since else F.coalesce(F.min("started_at"), F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 10 DAYS"))
    return sessions.agg(F.min("started_at").alias("m"), start.alias("from")).select("from", F.lit(before or as_of).cast("timestamp").alias("to"))


def session_tags(tags: DataFrame) -> DataFrame:
    return tags.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))


def with_tags_added(tags: DataFrame, more: DataFrame) -> DataFrame:
    return tags.unionByName(more).dropDuplicates(["session_id", "tag"])


def with_tags_removed(tags: DataFrame, gone: DataFrame) -> DataFrame:
    return tags.join(gone, ["session_id", "tag"], "left_anti")


def resolve(sessions: DataFrame, prefix: str) -> DataFrame:
    """Sessions an id stands for, with ``state``: exact, prefix, ambiguous; no row where nothing is found."""
    hit = sessions.filter(F.col("id").startswith(prefix)).select("id", (F.col("id") == prefix).alias("exact"))
    count = hit.agg(F.count("*").alias("n"), F.max("exact").alias("any_exact"), F.min_by("id", F.struct(~F.col("exact"), "id")).alias("id"))
    state = F.when(F.col("any_exact"), "exact").when(F.col("n") == 1, "prefix").otherwise("ambiguous")
    return count.filter("n > 0").select("id", "n", state.alias("state"))


def latest(sessions: DataFrame) -> DataFrame:
    """The newest session of each engine."""
    return sessions.groupBy("engine").agg(F.max_by("id", F.struct("started_at", "id")).alias("id"), F.max("started_at").alias("started_at"))


def status(sessions: DataFrame, facts: DataFrame, handoffs: DataFrame) -> DataFrame:
    """What the tables hold: one row per measure, and one per engine."""
    one = lambda df, name, value: df.agg(value.cast("string").alias("value")).select(F.lit(name).alias("measure"), "value")
    clock = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    s = sessions.agg(F.count("*").cast("string").alias("sessions"), clock(F.min("started_at")).alias("first_start"), clock(F.max("started_at")).alias("last_start"), clock(F.max("last_event_at")).alias("last_event"))
    s = s.unpivot([], ["sessions", "first_start", "last_start", "last_event"], "measure", "value")
    engines = sessions.groupBy("engine").agg(F.count("*").cast("string").alias("value")).select(F.concat(F.lit("engine "), "engine").alias("measure"), "value")
    return s.unionByName(engines).unionByName(one(facts, "facts", F.count("*"))).unionByName(one(handoffs, "handoffs", F.count("*")))


def envelope(rows: DataFrame, shown: int) -> DataFrame:
    """A result's envelope: how many rows there are, how many are shown, and those as JSON in order of ``id``."""
    top = rows.orderBy("id").limit(shown).agg(F.count("*").alias("shown"), F.to_json(F.array_sort(F.collect_list(F.struct("id")))).alias("rows"))
    return top.withColumn("k", F.lit(1)).join(rows.agg(F.count("*").alias("total")).withColumn("k", F.lit(1)), "k").drop("k")


def type_badge() -> Column:
    """How a listing marks children and coordinators."""
    kind = F.col("session_type")
    return F.when(kind == "subagent", F.coalesce(F.concat(F.lit("["), "subagent_type", F.lit("]")), F.lit("[sub]"))).when(kind == "coordinator", "[coord]").otherwise("-")


def of_day(sessions: DataFrame, day: str) -> DataFrame:
    """The sessions that began on a day (``yyyy-MM-dd``), the oldest first."""
    return sessions.filter(F.date_format("started_at", "yyyy-MM-dd") == day).orderBy("started_at", "id")


def artefacts(sessions: DataFrame, root: str, existing: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``id, kind, path, there`` and ``carry``: where a session's transcript and summary belong, and whether they are in ``existing`` (``path``)."""
    kinds = F.explode(F.array(F.lit("sessions"), F.lit("handoffs")))
    parts = date_parts(F.col("started_at"))
    s = sessions.select("id", kinds.alias("kind"), "engine", short_id(F.col("id"), F.col("engine") == "codex").alias("short"), *(parts[k].alias(k) for k in "ymd"), *carry)
    path = F.concat(F.lit(f"{root}/data/"), "engine", F.lit("/"), "kind", F.lit("/"), "y", F.lit("/"), "m", F.lit("/"), "d", F.lit("/"), "short", F.lit(".md"))
    there = existing.select("path").distinct().withColumn("found", F.lit(True))
    return s.select("id", "kind", path.alias("path"), *carry).join(there, "path", "left").select("id", "kind", "path", F.coalesce("found", F.lit(False)).alias("there"), *carry)


def needle_details(hits: DataFrame, sessions: DataFrame, handoffs: DataFrame, root: str, existing: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """What is known of the session of each hit (``file, engine``), of its transcript and of its handoff.

    ``handoffs`` has ``session_id, generated_at``. A hit of an unknown session stays, with nulls; of several sessions with its id,
    which the columns ``more`` of sessions and handoffs tell apart, each gives a row.
    """
    stem = F.regexp_replace(F.regexp_extract("file", "([^/]+)$", 1), "[.]jsonl?$", "")
    h = hits.select("file", short_id(stem, F.col("engine") == "codex").alias("id"))
    met = sessions.join(h.select("id").distinct(), "id", "left_semi")
    shown = ("model", "cwd", "session_type", "last_event_at", "turns", "total_input_tokens", "total_output_tokens")
    known = artefacts(met.withColumnRenamed("total_turns", "turns"), root, existing, (*shown, *more)).filter("kind = 'sessions'").select("id", *shown, *more, F.col("path").alias("transcript"), F.col("there").alias("transcript_there"))
    written = handoffs.groupBy(F.col("session_id").alias("id"), *more).agg(F.max("generated_at").alias("handoff_at"), F.lit(True).alias("of"))
    out = h.join(known, "id", "left").join(written, ["id", *more], "left").drop(*more)
    is_known = F.col("transcript_there").isNotNull()
    return out.withColumns({"handoff_there": F.when(is_known, F.col("of").isNotNull()), "handoff_at": F.when(is_known, F.col("handoff_at"))}).drop("of")
