"""Registered queries over helpers that listings, summaries and ingest plans are made of."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..functions.timebounds import time_bound, window_label
from ..operators import activity, attribution, handoff, inspection, links, listing, recall, rollup, tables, transcript
from ..sources import adapter as fx
from ..sources import logs
from .queries import APART, AS_OF, _clock, _json, _said, _sessions, _text, query


@query
def format_more(spark: SparkSession, d: str) -> DataFrame:
    """Shortened paths, times of day, model names, ages."""
    name = F.element_at(F.array(*map(F.lit, ("claude-opus-4", "gpt-5.3-codex", "codex-1", "o4-mini", "other-2", ""))), F.length("id") * 0 + F.dayofmonth("started_at") % 6 + 1)
    as_of = F.lit(datetime(2024, 1, 20, 12)).cast("timestamp")
    return _sessions(spark, d).select(
        "id", fn.shorten_path(F.col("cwd"), 16).alias("path"), fn.shorten_path(F.col("cwd"), 9).alias("short"), fn.time_text(F.col("started_at"), as_of, "Asia/Dubai").alias("time"), fn.model_family(name).alias("family"),
        activity.is_stale(F.col("ended_at"), datetime(2024, 1, 20), 60).alias("stale"), activity.age_seconds(F.col("started_at"), datetime(2024, 1, 20)).alias("age"), attribution.attribution_label(F.col("parent_id"), F.col("id")).alias("label"),
    )


@query
def ls_window(spark: SparkSession, d: str) -> DataFrame:
    """A listing between bounds as users type them, its label, and the window that another without bounds covers."""
    since, before = time_bound("10d", AS_OF), time_bound("2024-01-25", AS_OF, upper=True)
    s = _sessions(spark, d)
    window = listing.query_window(s, AS_OF, before=before).select(_clock("from").alias("from"), _clock("to").alias("to"))
    return listing.list_sessions(s, as_of=AS_OF, since=since, before=before).select("id", F.lit(window_label("10d")).alias("label")).join(window)


@query
def ls_envelope(spark: SparkSession, d: str) -> DataFrame:
    return listing.envelope(_sessions(spark, d).filter("engine = 'codex'"), 7)


@query
def tags_of_sessions(spark: SparkSession, d: str) -> DataFrame:
    tags = fx.fx_tags(spark, d)
    return listing.session_tags(listing.with_tags_removed(tags, tags.filter("tag = 't2'")))


@query
def who_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Attribution with all filters at once."""
    found = attribution.who(fx.fx_facts(spark, d), _sessions(spark, d), fx.fx_handoffs(spark, d), "changed", since=datetime(2024, 1, 8), before=datetime(2024, 1, 28), engine="codex", cwd="PROJ", tags=fx.fx_tags(spark, d), tag="t0")
    return found.select("id", "session_id", "fact_type", "subject")


@query
def fact_trace(spark: SparkSession, d: str) -> DataFrame:
    """All errors of the sessions of one day, with ids that stay when a log is read again."""
    day = _sessions(spark, d).filter(F.col("id").endswith("d09")).select("id")
    t = inspection.trace(fx.fx_facts(spark, d), day, "error").withColumnsRenamed({"id": "event"})
    ids = tables.fact_ids(t.withColumns({"ord": F.col("event"), "sub_ord": F.lit(0)}))
    return ids.groupBy("session_id").agg(F.count("*").alias("errors"), F.count_distinct("id").alias("ids"), F.min("event").alias("first"))


@query
def ingest_plan(spark: SparkSession, d: str) -> DataFrame:
    """What to do with each log, given what is known of it, what its facts look like, and what stands in it."""
    s = _sessions(spark, d, APART[1:])
    n = F.col("total_tools") + F.col("total_turns")
    lines = _said(spark, d).filter("fact_type = 'file_read' AND k % 9 = 0")
    called = logs.inline_tools(lines.select("file", "ord", F.lit('{"type":"assistant","message":{"content":[{"type":"tool_use","name":"x"}]}}').alias("line"))).select(F.col("file").alias("id"), F.lit(True).alias("called"))
    bad = rollup.doubtful_sessions(fx.fx_facts(spark, d)).select(F.col("session_id").alias("id"), F.lit(True).alias("bad"))
    found = s.join(called, "id", "left").join(bad, "id", "left").select(*APART, n.alias("size"), F.coalesce("called", F.lit(False)).alias("has_tool_blocks"), (F.coalesce("bad", F.lit(False)) & (F.col("total_tools") % 2 == 0)).alias("bad_errors"))
    known = s.filter("total_tools % 7 > 0").select(*APART, (n - F.col("total_tools") % 3 + 1).alias("last_indexed_offset"), "peak_context", F.when(F.col("total_tools") % 5 == 0, 0).otherwise(F.col("total_tools")).alias("total_tools"))
    return rollup.ingest_plan(found, known, largest_peak=12_000, more=APART[1:])


@query
def handoff_documents(spark: SparkSession, d: str) -> DataFrame:
    """Heads of summary documents, and whether a transcript is to be rendered again."""
    s = _sessions(spark, d, APART[1:])
    docs = s.select(*APART, F.when(F.col("total_tools") % 3 > 0, F.col("total_tools") % 3).alias("render_version"), F.repeat(F.lit("é"), F.col("total_tools").cast("int")).alias("text"))
    body = recall.without_front_matter(F.concat("head", F.lit("body of "), "id"))
    heads = handoff.front_matter(s, APART[1:]).withColumn("body", body)
    return heads.join(transcript.stale_documents(docs, 2, APART[1:]), [*APART]).drop("user_id")


@query
def handoff_extract(spark: SparkSession, d: str) -> DataFrame:
    """Summaries read from replies: JSON, JSON in a fence, or lines with names."""
    h = fx.fx_handoffs(spark, d).withColumn("n", F.substring("session_id", 4, 9).cast("int"))
    made = _json(headline=F.col("headline"), projects=F.col("projects"), keywords=F.col("keywords"), substance=F.col("substance") + 2)
    fenced = F.concat(F.lit("Here it is:\n```json\n"), made, F.lit("\n```\nthat is all"))
    named = F.concat(F.lit("**Headline**: "), "headline", F.lit("\nProjects: "), F.array_join("projects", ", "), F.lit("\n- Keywords: "), F.array_join("keywords", ","), F.lit("\nSubstance: "), _text(F.col("substance")))
    text = F.when(F.col("n") % 3 == 0, made).when(F.col("n") % 3 == 1, fenced).otherwise(named)
    got = handoff.extracted(h.filter("headline <> '' AND size(keywords) > 0").select("session_id", text.alias("text")))
    return got.select("session_id", "headline", F.array_join("projects", ",").alias("projects"), F.array_join("keywords", ",").alias("keywords"), "substance")


@query
def orphan_parents(spark: SparkSession, d: str) -> DataFrame:
    """Children whose parents' logs are gone: the parents that are made up for them, and the children with what they inherit."""
    s = _sessions(spark, d).filter("NOT endswith(id, '10')")
    ghosts = links.orphans(s)
    parents = ghosts.select(F.col("parent_id").alias("id"), "started_at", F.lit("/made").alias("cwd"))
    kids = s.join(ghosts.select("parent_id"), "parent_id", "left_semi").select("id", "parent_id", F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("string").alias("cwd"))
    return links.inherit(kids, parents).select("id", "parent_id", _clock("started_at").alias("started_at"), "cwd")


@query
def forked_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Forks of the second engine linked with the sessions they came of, which become coordinators."""
    s = _sessions(spark, d).filter("parent_id IS NULL").withColumn("session_type", F.lit("standalone"))
    # Full ids: their last eight hex digits, without dashes, are the short ones.
    digits = F.concat(F.substring("id", 2, 4), F.lit("d"), F.substring("id", 7, 2))
    s = s.withColumns({"id": F.concat(F.lit("0"), digits), "forked_from": F.when(F.substring("id", 7, 2) == "10", F.concat(F.lit("0190-a0-"), F.substring("id", 2, 4), F.lit("-d05"))), "agent_role": F.when(F.col("total_tools") % 2 == 0, "scout")})
    return links.forked(s).select("id", "engine", "parent_id", "session_type", "subagent_type")
