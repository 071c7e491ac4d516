"""Ranked recall of session summaries."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import startswith_ci, ws_trim

# Words that a query and headlines lose.
STOP_WORDS = "the a an is was are were it its in on at to for of with and or but not this that by from".split()
WEIGHTS = {"projects": 3.0, "keywords": 2.0, "headline": 2.5}


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def query_tokens(query: str) -> list[str]:
    return [t for t in dict.fromkeys(re.findall("[a-z0-9]+", query.lower())) if t not in STOP_WORDS]


def parse_list(c: Column) -> Column:
    """A list given as a JSON array, of which only strings are taken, or as one plain string."""
    v = F.try_parse_json(c)
    is_list = F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))
    strings = F.transform(F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING"), lambda x: x.cast("string"))
    return F.when(is_list, strings).when(ws_trim(c) != "", F.array(c)).otherwise(F.expr("CAST(array() AS ARRAY<STRING>)"))


def recall(handoffs: DataFrame, query: str, *, as_of: date, days: int = 14, min_substance: int = 1, limit: int | None = 10) -> DataFrame:
    """``session_id, score``: IDF over all summaries, boosts for age and length; newest ones if nothing scores.

    ``handoffs`` has ``session_id, headline, projects, keywords, substance, duration_minutes, started_on``.
    Rows of the fallback have score 0. One pass: the idf table has as many rows as the query has words.
    """
    words = query_tokens(query)
    in_field = {
        "projects": F.flatten(F.transform("projects", lambda x: tokens(x))),
        "keywords": F.flatten(F.transform("keywords", lambda x: tokens(x))),
        "headline": F.array_except(tokens(F.col("headline")), F.array(*map(F.lit, STOP_WORDS))),
    }
    h = handoffs.withColumns({f"_{k}": F.coalesce(v, F.array().cast("array<string>")) for k, v in in_field.items()})
    fields = [F.col(f"_{k}") for k in WEIGHTS]
    hit = lambda w: F.greatest(*(F.array_contains(f, w).cast("int") for f in fields))
    wanted = [F.lit(w) for w in words]
    stats = h.agg(F.count("*").alias("n"), *(F.sum(hit(w)).alias(f"df{i}") for i, w in enumerate(words))).withColumn("one", F.lit(1))
    h = h.withColumn("one", F.lit(1)).join(F.broadcast(stats), "one")
    base = F.lit(0.0)
    for i, w in enumerate(words):
        idf = F.when(F.col(f"df{i}") > 0, F.greatest(F.log(F.col("n") / F.col(f"df{i}")), F.lit(0.0))).otherwise(0.0)
        weight = F.lit(0.0)
        for (k, v), f in zip(WEIGHTS.items(), fields):
            weight = weight + F.array_contains(f, w).cast("double") * v
        base = base + idf * weight
    age = F.greatest(F.datediff(F.lit(as_of), "started_on"), F.lit(1))
    recent = F.when(age <= days, 1 + 1 / F.sqrt(age.cast("double"))).otherwise(F.pow(F.lit(0.5), (age - days) / F.lit(7.0)))
    longer = 1 + 0.1 * F.log(F.col("duration_minutes") + 1.0)
    ranked = h.filter(F.col("substance") >= min_substance).select("session_id", "started_on", F.round(base * recent * longer, 6).alias("score"), (base > 0).alias("hit") if wanted else F.lit(False).alias("hit"))
    found = ranked.agg(F.count_if("hit").alias("hits")).withColumn("one", F.lit(1))
    out = ranked.withColumn("one", F.lit(1)).join(F.broadcast(found), "one").filter(F.col("hit") | (F.col("hits") == 0))
    out = out.select("session_id", "started_on", F.when(F.col("hit"), F.col("score")).otherwise(0.0).alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), F.desc("started_on"), "session_id").limit(limit)


def without_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A\s*---.*?\n---\n?", "")


def session_date(started_at: Column) -> Column:
    """The date a start is written with, in its own offset; null where its first ten characters are no date."""
    return F.try_to_date(F.substring(started_at, 1, 10), "yyyy-MM-dd")


def by_id(handoffs: DataFrame, sessions: DataFrame, prefix: str | None = None) -> DataFrame:
    """The summary of the one session whose id starts so, whatever the case, or of the newest session, with score 0.

    No row where several ids start so, even if one of them is no longer than that, where none does, or where the session has
    no summary.
    """
    if prefix is None:
        wanted = sessions.orderBy(F.col("started_at").desc_nulls_last(), "id").limit(1).select("id")
    else:
        wanted = sessions.filter(startswith_ci(F.col("id"), prefix)).agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n = 1").select("id")
    found = handoffs.join(wanted.withColumnRenamed("id", "session_id"), "session_id", "left_semi")
    return found.withColumn("score", F.lit(0.0))


def brief(found: DataFrame) -> DataFrame:
    """``session_id, text``: a short block for each summary."""
    listed = lambda c: F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit("-"))
    text = F.format_string("%s (%s)\nprojects: %s\nkeywords: %s", F.coalesce("headline", F.lit("-")), F.coalesce(F.col("started_on").cast("string"), F.lit("-")), listed("projects"), listed("keywords"))
    return found.select("session_id", text.alias("text"))


def with_facts(found: DataFrame, facts: DataFrame) -> DataFrame:
    """Summaries with the distinct files and the error texts of their sessions, sorted."""
    kinds = {"files": F.col("fact_type").isin("file_read", "file_write"), "errors": F.col("fact_type") == "error"}
    text = {"files": F.col("subject"), "errors": F.col("detail")}
    sides = facts.groupBy("session_id").agg(*(F.array_sort(F.collect_set(F.when(k, text[n]))).alias(n) for n, k in kinds.items()))
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    return found.join(sides, "session_id", "left").withColumns({n: F.coalesce(n, none) for n in kinds})
