"""Inverted attribution: which session read, wrote, ran or deleted something."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_ci, startswith_ci, ws_trim

# Verb -> fact types and how the target is matched.
VERBS = {
    "read": (("file_read",), "subject"),
    "wrote": (("file_write",), "subject"),
    "ran": (("command",), "program"),
    "touched": (("file_read", "file_write", "command"), "either"),
    "changed": (("file_write", "git_op"), "either"),
    "installed": (("command",), "installed"),
    "deleted": (("command", "file_write"), "deleted"),
}
# Phrases that show the verb in a command.
PHRASES = {
    "installed": ("install", "add ", "brew ", "cargo add", "pip install", "npm install", "apt install", "go get"),
    "deleted": ("rm ", "rm -", "unlink", "remove", "del "),
}
# Segments of a shell command between &&, ||, | and ; outside quotes. Possessive: it never backtracks.
SEGMENT = r"""((?:[^;|&'"]++|'[^']*+(?:'|\z)|"[^"]*+(?:"|\z)|&(?!&))*+)(?:&&|\|\||[;|]|\z)"""
WRAPPERS = ("env", "sudo", "nohup", "time", "exec")


def program_names(command: Column) -> Column:
    """The base name of the program that each segment of a shell command runs."""
    segments = F.filter(F.regexp_extract_all(command, F.lit(SEGMENT), F.lit(1)), lambda s: F.trim(s) != "")

    def program(segment: Column) -> Column:
        words = F.filter(F.split(F.trim(segment), r"\s+"), lambda w: (w != "") & ~w.rlike("^[^-/][^=]*=") & ~w.isin(*WRAPPERS))
        return F.regexp_replace(F.get(words, F.lit(0)), "^.*/", "")

    return F.filter(F.transform(segments, program), lambda p: p.isNotNull())


def subject_matches(target: str) -> Column:
    """A folder (ending in ``/``) is matched at the start, anything else anywhere."""
    return startswith_ci(F.col("subject"), target) if target.endswith("/") else contains_ci(F.col("subject"), target)


def verb_matches(verb: str, target: str | None) -> Column:
    mode = VERBS[verb][1]
    if mode in PHRASES:
        shown = F.lit(False)
        for phrase in PHRASES[mode]:
            shown = shown | contains_ci(F.col("detail"), phrase)
        if target is not None:
            shown = shown & contains_ci(F.col("detail"), target)
            if mode == "deleted":
                shown = shown | ((F.col("fact_type") == "file_write") & subject_matches(target))
        return shown
    if target is None:
        return F.lit(True)
    if mode == "program":
        return F.coalesce(F.exists(program_names(F.col("detail")), lambda p: contains_ci(p, target)), F.lit(False))
    return subject_matches(target) if mode == "subject" else subject_matches(target) | contains_ci(F.col("detail"), target)


def who(
    facts: DataFrame,
    sessions: DataFrame,
    handoffs: DataFrame,
    verb: str,
    target: str | None = None,
    *,
    since: datetime | None = None,
    before: datetime | None = None,
    engine: str | None = None,
    cwd: str | None = None,
    tags: DataFrame | None = None,
    tag: str | None = None,
    failed_only: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Matching facts with their session's engine, parent and headline.

    A limit takes the newest facts, sorted; without one the rows are in no order, since what groups them needs none.
    """
    f = facts.filter(F.col("fact_type").isin(*VERBS[verb][0]) & verb_matches(verb, target))
    if since is not None:
        f = f.filter(F.col("ts") >= F.lit(since))
    if before is not None:
        f = f.filter(F.col("ts") <= F.lit(before))
    if failed_only:
        f = f.filter(F.coalesce(F.col("exit_code") != 0, F.lit(False)) | F.coalesce(~F.col("success"), F.lit(False)))
    if tag is not None:
        f = f.join(tags.filter(F.col("tag") == tag), "session_id", "left_semi")
    s = sessions.select(F.col("id").alias("session_id"), "engine", "cwd", "parent_id")
    if engine is not None:
        s = s.filter(F.col("engine") == engine)
    if cwd is not None:
        s = s.filter(contains_ci(F.col("cwd"), cwd))
    out = f.join(s, "session_id").join(handoffs.select("session_id", "headline"), "session_id", "left")
    return out if limit is None else out.orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def clean_subject(subject: Column) -> Column:
    """The path of a patch text, else the subject itself."""
    path = F.regexp_extract(subject, r"\*\*\* Update File:(.*?)(?:\\n|\n|$)", 1)
    bare = F.regexp_replace(ws_trim(path), '^"+|"+$', "")
    return F.when(bare != "", bare).otherwise(subject)


def group_by_session(found: DataFrame) -> DataFrame:
    """Facts per session: count, newest time, up to five distinct subjects from the newest on, first headline."""
    command = F.substring(F.get(F.split("detail", "\n"), F.lit(0)), 1, 80)
    subject = F.coalesce(clean_subject(F.col("subject")), command)
    newest = F.array_sort(F.collect_list(F.struct((-F.unix_micros("ts")).alias("t"), (-F.col("id")).alias("i"), subject.alias("s"))))
    subjects = F.slice(F.array_distinct(F.filter(F.transform(newest, lambda x: x["s"]), lambda s: s.isNotNull())), 1, 5)
    order = F.struct("ts", "id")
    return found.groupBy("session_id", "engine", "parent_id").agg(
        F.count("*").alias("fact_count"), F.max("ts").alias("latest_ts"), F.array_join(subjects, " | ").alias("subjects"), F.max_by("headline", order).alias("headline")
    )


def attribution_label(parent: Column, child: Column) -> Column:
    return F.when(parent.isNotNull(), F.concat_ws(" → ", F.substring(parent, 1, 8), F.substring(child, 1, 8))).otherwise(F.substring(child, 1, 8))
