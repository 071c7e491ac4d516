"""Per-session documents from ordered turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What marks a line as an open thread.
MARKERS = ("todo", "fixme", "next step", "remain", "still need")
LONG, PREVIEW = 100_000, 5_000


def open_threads(turns: DataFrame, limit: int = 5) -> DataFrame:
    """``session_id, nth, thread``: marked lines of the replies of a session's last two turns.

    ``turns``: ``session_id, turn, ord, text``, one row per assistant text.
    """
    w = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    lines = turns.withColumn("back", F.dense_rank().over(w)).filter("back <= 2").select("session_id", "turn", "ord", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))
    marked = F.lit(False)
    for m in MARKERS:
        marked = marked | F.lower("line").contains(m)
    clean = F.trim(F.regexp_replace(F.trim("line"), "^[-*#]+", ""))
    found = lines.filter(marked).withColumn("thread", clean).filter((F.col("thread") != "") & (F.octet_length("thread") < 200))
    order = Window.partitionBy("session_id").orderBy("turn", "ord", "line_no", "thread")
    return found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= limit).select("session_id", "nth", "thread")


def turn_islands(turns: DataFrame, is_text: Column, order: list[str]) -> DataFrame:
    """Tool-only turns merged up to the next text: ``session_id, island, turns, first_ord, last_ord, has_text``."""
    w = Window.partitionBy("session_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    t = turns.withColumn("__text", is_text).withColumn("island", F.coalesce(F.sum(F.col("__text").cast("int")).over(w), F.lit(0)))
    return t.groupBy("session_id", "island").agg(F.count("*").alias("turns"), F.min(order[0]).alias("first_ord"), F.max(order[0]).alias("last_ord"), F.max("__text").alias("has_text"))


def conversation(turns: DataFrame, order: list[str]) -> DataFrame:
    """``session_id, text``: the turns of each session in order, with their speakers."""
    line = F.concat(F.lit("**"), "kind", F.lit("**: "), preview(strip_markup(F.col("text"))))
    ordered = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return turns.groupBy("session_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n\n").alias("text"), F.count("*").alias("turns"))


def strip_markup(text: Column) -> Column:
    return F.regexp_replace(text, "</?[^>]+>", "")


def preview(text: Column) -> Column:
    """Very long texts are cut to their head, with a note."""
    return F.when(F.length(text) > LONG, F.concat(F.substring(text, 1, PREVIEW), F.format_string("\n[%d characters more]", F.length(text) - PREVIEW))).otherwise(text)


def document_stats(events: DataFrame) -> DataFrame:
    """Turns, sorted models and time span of each session; ``events``: ``session_id, ts, kind, model``."""
    secs = F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))
    return events.groupBy("session_id").agg(F.count_if(F.col("kind") == "user_prompt").alias("turns"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"), secs.alias("duration_secs"))


def tool_annotation(name: Column, subject: Column) -> Column:
    return F.when(name == "Bash", F.concat(F.lit("> Bash: "), F.substring(F.get(F.split(subject, "\n"), F.lit(0)), 1, 60))).otherwise(F.concat(F.lit("> "), name, F.lit(": "), F.coalesce(subject, F.lit(""))))


def summary_section(files: DataFrame, first: int = 20) -> DataFrame:
    """``session_id, section``: the first files with their last action, and how many more there are."""
    line = F.concat(F.lit("- "), "path", F.lit(" ("), "action", F.lit(")"))
    all_lines = F.transform(F.array_sort(F.collect_list(F.struct("nth", line.alias("l")))), lambda x: x["l"])
    more = F.greatest(F.count("*") - first, F.lit(0))
    text = F.array_join(F.slice(all_lines, 1, first), "\n")
    return files.groupBy("session_id").agg(F.when(more > 0, F.concat(text, F.format_string("\n- %d more", more))).otherwise(text).alias("section"))


def stale_documents(documents: DataFrame, version: int, more: tuple[str, ...] = ()) -> DataFrame:
    """Documents (``id, render_version, text``) to render again, with size and estimated tokens; ``more`` tells those of one id apart."""
    stale = F.coalesce(F.col("render_version") != version, F.lit(True))
    return documents.select("id", *more, stale.alias("stale"), F.octet_length("text").alias("bytes"), F.floor(F.octet_length("text") / 4).alias("tokens"))
