"""Parent and child sessions: linking, matching, promotion, orphans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import short_id


def last_earlier(results: DataFrame, calls: DataFrame, keys: list[str], take: list[str], order: str = "ord") -> DataFrame:
    """``results`` with the columns ``take`` of the last call before each (or at the same place), per key.

    Both sides are stacked and a running last value is taken: one shuffle on the keys, and no join that
    pairs every call with every result.
    """
    side = lambda df, is_call: df.select(*keys, order, F.lit(is_call).alias("__call"), *(F.col(c) if is_call else F.lit(None).cast(calls.schema[c].dataType).alias(c) for c in take), (F.struct(*results.columns) if not is_call else F.lit(None).cast(results.select(F.struct(*results.columns).alias("r")).schema["r"].dataType)).alias("__r"))
    both = side(calls, True).unionByName(side(results, False))
    w = Window.partitionBy(*keys).orderBy(order, F.desc("__call")).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("__call"), F.struct(*take)), ignorenulls=True).over(w)
    return both.withColumn("__last", last).filter("NOT __call").select("__r.*", *(F.col(f"__last.{c}").alias(c) for c in take))


def coordinators(sessions: DataFrame) -> DataFrame:
    """Sessions with ``session_type`` set to coordinator where another session names them as parent."""
    parents = sessions.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("id")).distinct().withColumn("has_children", F.lit(True))
    kind = F.when(F.col("has_children") & F.col("parent_id").isNull(), "coordinator").otherwise(F.col("session_type"))
    return sessions.join(parents, "id", "left").withColumn("session_type", kind).drop("has_children")


def orphans(sessions: DataFrame) -> DataFrame:
    """Missing parents, made up from their children: earliest start and its working folder, tag ``_recovered``."""
    kids = sessions.filter("parent_id IS NOT NULL")
    known = sessions.select(F.col("id").alias("parent_id"))
    lost = kids.join(known, "parent_id", "left_anti")
    first = F.struct("started_at", "id")
    return lost.groupBy("parent_id").agg(F.count("*").alias("children"), F.min("started_at").alias("started_at"), F.min_by("cwd", first).alias("cwd"), F.lit("_recovered").alias("tag"))


def inherit(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children take their parent's start and folder where their own are unknown."""
    p = parents.select(F.col("id").alias("parent_id"), F.col("started_at").alias("p_start"), F.col("cwd").alias("p_cwd"))
    joined = children.join(p, "parent_id", "left").withColumns({"started_at": F.coalesce("started_at", "p_start"), "cwd": F.coalesce("cwd", "p_cwd")})
    return joined.select(*children.columns)


def match_files(summaries: DataFrame, files: DataFrame) -> DataFrame:
    """Child summaries (``parent, agent_id``) with the file (``parent, file_id``) whose id is a prefix of theirs, or the other way round.

    Each side's prefixes of the lengths that the other side's ids have meet these ids by equality, so that ids of any
    length are matched without pairing all with all. Of several files the longest wins; without one it is null.
    """
    bare = lambda c: F.regexp_replace(c, "^agent-", "")
    s = summaries.select("parent", "agent_id", bare("agent_id").alias("__a")).distinct()
    f = files.select("parent", "file_id", bare("file_id").alias("__f")).distinct()

    def prefixes(df: DataFrame, name: str, lengths: list[int]) -> DataFrame:
        """``__k``: those of its id's prefixes that have one of the lengths (as many as ids have different lengths)."""
        fits = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length(name))
        return df.withColumn("__k", F.explode(F.transform(fits, lambda n: F.substr(F.col(name), F.lit(1), n))))

    lengths = lambda df, name: sorted(r[0] for r in df.select(F.length(name)).distinct().collect() if r[0])
    shorter_file = prefixes(s, "__a", lengths(f, "__f")).join(f.withColumnRenamed("__f", "__k"), ["parent", "__k"])
    shorter_agent = prefixes(f, "__f", lengths(s, "__a")).join(s.withColumnRenamed("__a", "__k"), ["parent", "__k"])
    hits = shorter_file.select("parent", "agent_id", "file_id").unionByName(shorter_agent.select("parent", "agent_id", "file_id"))
    best = hits.groupBy("parent", "agent_id").agg(F.max_by("file_id", F.struct(F.length("file_id"), "file_id")).alias("file_id"))
    return summaries.join(best, ["parent", "agent_id"], "left").select(*summaries.columns, "file_id")


def child_ids(children: DataFrame, sessions: DataFrame) -> DataFrame:
    """``id`` for each child (``parent_id, uid``): eight characters of its uid, twelve where another parent has these, else null.

    ``sessions`` (``id, parent_id, session_type``) are those stored before. An id that they don't have is free, and one that belongs
    to the child's own parent stays its id; so does that of an orphan (a child without a parent), which the child claims. Of
    several parents that want a free id in one run the smallest gets it.
    """
    orphan = F.col("parent_id").isNull() & (F.col("session_type") == "subagent")
    out = children.withColumn("id", F.lit(None).cast("string"))
    for length in (8, 12):
        owners = sessions.select(F.col("id").alias("__c"), F.col("parent_id").alias("__p"), orphan.alias("__orphan"), F.lit(True).alias("__known"))
        # A name of eight characters or less has no longer id to try.
        tries = F.col("id").isNull() & (F.length("uid") > (0 if length == 8 else 8))
        out = out.withColumn("__c", F.when(tries, F.substring("uid", 1, length))).join(owners, "__c", "left")
        # Its own comes before one that is free; null where another parent has it, or where it isn't tried.
        claim = F.when(F.col("__c").isNull(), None).when(F.col("__p") == F.col("parent_id"), 0).when(F.coalesce("__orphan", F.lit(False)) | F.col("__known").isNull(), 1)
        won = F.min(F.when(claim.isNotNull(), F.struct(claim.alias("claim"), F.col("parent_id").alias("p")))).over(Window.partitionBy("__c"))
        out = out.withColumn("__w", won).withColumn("id", F.coalesce("id", F.when(F.col("__w.p") == F.col("parent_id"), F.col("__c")))).drop("__c", "__p", "__orphan", "__known", "__w")
    return out


def indexed_children(sessions: DataFrame, tags: DataFrame, summaries: DataFrame, files: DataFrame, rows: DataFrame, stage: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions and tags after the children of one run are taken in, and the summaries that no session came of.

    ``summaries`` (``parent, agent_id, subagent_type``) say what parents know of their children, ``files`` (``parent, file_id``) what
    logs there are, ``rows`` (``file_id`` and the columns of sessions) what these hold. A child has the start and the folder of
    its parent where its own are unknown; it is tagged with its type; its parent becomes a coordinator. ``stage``
    may write what several of the results are made of.
    """
    known = summaries.join(sessions.select(F.col("id").alias("parent")), "parent", "left_semi")
    matched = match_files(known, files).withColumnRenamed("parent", "parent_id").withColumn("uid", F.col("agent_id"))
    named = stage(child_ids(matched.filter("file_id IS NOT NULL"), sessions).unionByName(matched.filter("file_id IS NULL").withColumn("id", F.lit(None).cast("string"))))
    # Two logs of one parent with one id are one session: the longer name wins.
    made = named.filter("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct("file_id", "parent_id", "subagent_type"), F.struct(F.length("file_id"), "file_id")).alias("x")).select("id", "x.*")
    new = rows.drop("id", "parent_id", "session_type", "subagent_type").join(made, "file_id").drop("file_id").withColumn("session_type", F.lit("subagent"))
    new = stage(inherit(new.select(*sessions.columns), sessions))
    parents = new.select(F.col("parent_id").alias("id")).distinct().withColumn("__has", F.lit(True))
    old = sessions.join(new.select("id"), "id", "left_anti").join(parents, "id", "left").withColumn("session_type", F.when(F.col("__has"), "coordinator").otherwise(F.col("session_type"))).drop("__has")
    typed = new.filter("subagent_type <> ''").select(F.col("id").alias("session_id"), F.col("subagent_type").alias("tag"))
    lost = named.groupBy("parent_id", "agent_id").agg(F.count("id").alias("n")).filter("n = 0").drop("n")
    return old.select(*sessions.columns).unionByName(new), tags.unionByName(typed.select(*tags.columns)).distinct(), lost


def forked(sessions: DataFrame) -> DataFrame:
    """Sessions (with ``forked_from``, ``agent_role``) of the second engine linked with those that they were forked from.

    A fork is a child of the session whose id is the short form of ``forked_from``, with its role as its type. Standalone
    sessions of that engine that a child of it names as its parent become coordinators.
    """
    codex, fork = F.col("engine") == "codex", F.col("forked_from").isNotNull()
    s = sessions.withColumns({
        "parent_id": F.when(codex & fork, short_id(F.col("forked_from"), F.lit(True))).otherwise(F.col("parent_id")),
        "session_type": F.when(codex & fork, "subagent").otherwise(F.col("session_type")),
        "subagent_type": F.when(codex & fork, F.col("agent_role")).otherwise(F.col("subagent_type")),
    })
    named = s.filter(codex & (F.col("session_type") == "subagent") & F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("id")).distinct().withColumn("__named", F.lit(True))
    kind = F.when(codex & (F.col("session_type") == "standalone") & F.col("__named"), "coordinator").otherwise(F.col("session_type"))
    return s.join(named, "id", "left").withColumn("session_type", kind).select(*sessions.columns)


def unlinked_files(files: DataFrame, sessions: DataFrame) -> DataFrame:
    """Child logs (``parent, agent_id, path``) that no session with a parent was read from; a path counts once."""
    linked = sessions.filter("parent_id IS NOT NULL").select("path")
    return files.dropDuplicates(["path"]).filter("parent <> ''").join(linked, "path", "left_anti")


def recovery_counts(files: DataFrame, sessions: DataFrame) -> DataFrame:
    """What a recovery would work on, without doing it: ``orphan_files, parent_groups``."""
    return unlinked_files(files, sessions).agg(F.count("*").alias("orphan_files"), F.count_distinct("parent").alias("parent_groups"))


def recovered(sessions: DataFrame, tags: DataFrame, files: DataFrame, rows: DataFrame, stage: Callable[[DataFrame], DataFrame] = lambda df: df, more: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions and tags after child logs without a session are taken in, and ``ghosts_created, subagents_indexed, errors``.

    ``rows`` (``path`` and the columns of sessions) is what the logs hold. A parent is named by the first eight characters of its
    folder. One that isn't known is made up, with the earliest start among its children and the folder of that child, and
    tagged ``_recovered``; a standalone one becomes a coordinator. A log without a row, or without a free id, is an error.
    Two logs of one parent with one id are one session unless the columns ``more`` of ``files`` tell them apart.
    """
    lost = unlinked_files(files, sessions).withColumn("parent_id", F.substring("parent", 1, 8))
    read = stage(lost.join(rows.select("path", "started_at", "cwd"), "path", "left").join(rows.select("path").withColumn("there", F.lit(True)), "path", "left"))
    groups = read.groupBy("parent_id").agg(F.count_if("there").alias("readable"), F.min("started_at").alias("started_at"), F.min_by("cwd", F.struct(F.col("started_at").isNull(), "started_at", "path")).alias("cwd"))
    missing = groups.filter("readable > 0").join(sessions.select(F.col("id").alias("parent_id")), "parent_id", "left_anti")
    typed = lambda c, made: (made if made is not None else F.lit(0 if sessions.schema[c].dataType.simpleString() in ("bigint", "int") else None)).cast(sessions.schema[c].dataType).alias(c)
    ghost = {"id": F.col("parent_id"), "engine": F.lit("claude"), "session_type": F.lit("coordinator"), "path": F.lit("(recovered)"), "started_at": F.col("started_at"), "cwd": F.col("cwd")}
    ghosts = stage(missing.select(*(typed(c, ghost.get(c)) for c in sessions.columns)))
    all_known = sessions.unionByName(ghosts)
    kids = child_ids(read.filter("there").withColumn("uid", F.col("agent_id")), all_known)
    kids = stage(kids.join(all_known.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("path", "id", "parent_id", "agent_id", *more))
    named = kids.filter("id IS NOT NULL").groupBy("id", *more).agg(F.max_by(F.struct("path", "parent_id"), F.struct(F.length("agent_id"), "agent_id", "path")).alias("x")).select("id", "x.*")
    new = stage(rows.drop("id", "parent_id", "session_type").join(named, "path").withColumn("session_type", F.lit("subagent")).select(*sessions.columns))
    parents = groups.select(F.col("parent_id").alias("id")).withColumn("__has", F.lit(True))
    kind = F.when(F.col("__has") & (F.col("session_type") == "standalone"), "coordinator").otherwise(F.col("session_type"))
    old = all_known.join(new.select("id"), "id", "left_anti").join(parents, "id", "left").withColumn("session_type", kind).select(*sessions.columns)
    more = ghosts.select(F.col("id").alias("session_id"), F.lit("_recovered").alias("tag")).select(*tags.columns)
    done = ghosts.agg(F.count("*").alias("ghosts_created")).join(kids.agg(F.count("id").alias("subagents_indexed"))).join(read.agg(F.count("*").alias("all")))
    counts = done.select("ghosts_created", "subagents_indexed", (F.col("all") - F.col("subagents_indexed")).alias("errors"))
    return old.unionByName(new), tags.unionByName(more).distinct(), counts


def child_description(description, prompt):
    """At most 80 characters of a description, else the first line of the prompt that isn't blank."""
    first = F.trim(F.regexp_extract(F.coalesce(prompt, F.lit("")), r"(?m)^\s*(\S.*)$", 1))
    text = F.coalesce(F.nullif(F.trim(description), F.lit("")), F.nullif(first, F.lit("")), F.lit("subagent task"))
    return F.when(F.length(text) > 80, F.concat(F.substring(text, 1, 77), F.lit("..."))).otherwise(text)
