"""A stored search index: postings in buckets of their term, added to in segments, merged when there are many.

Tables of a :mod:`.versions` store: ``postings`` by term, ``lengths`` by session (what an indexed fact counts for), and ``gone`` by
fact (facts whose postings in earlier segments no longer hold). Sums over all facts that are live stand in the manifest, so that
a query reads only the buckets of its own terms, and no fact. An update adds a segment and commits all of it at once.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import search
from .versions import Store

FIELDS = ("subject", "detail")
STORED = ("session_id", "fact_type", "turn_number", "ts")
SEGMENTS = 8  # more than so many are merged


def _postings(facts: DataFrame, segment: int) -> DataFrame:
    """``term, field, doc, tf, doc_len, segment`` and the stored columns."""
    t = search._texts(facts, "id", FIELDS, STORED)
    spread = t.select("doc", *STORED, "field", F.size("t").alias("doc_len"), F.explode("t").alias("term"))
    return spread.groupBy("doc", *STORED, "field", "doc_len", "term").agg(F.count("*").alias("tf")).withColumn("segment", F.lit(segment))


def _lengths(facts: DataFrame) -> DataFrame:
    """``doc, session_id`` and the number of terms of each field."""
    return facts.select(F.col("id").alias("doc"), "session_id", *(F.size(search.terms(F.col(f))).cast("bigint").alias(f) for f in FIELDS))


def _sums(lengths: DataFrame) -> dict[str, int]:
    row = lengths.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in FIELDS)).first()
    return row.asDict()


def update(spark: SparkSession, store: str, facts: DataFrame, touched: DataFrame | None = None, *, buckets: int = 64) -> int:
    """Adds ``facts`` (``id`` and the columns of ``FIELDS`` and ``STORED``) as a segment, and gives the index's version.

    All facts of the ``touched`` sessions (``session_id``) that are in the index go; those of ``facts`` take their place.
    Without ``touched`` facts are only added. Only buckets of touched sessions and, at a merge, the postings are read.
    """
    s = Store(spark, store, buckets=buckets)
    notes = s.notes() or {"segment": 0, "n": 0, **dict.fromkeys(FIELDS, 0)}
    segment = notes["segment"] + 1
    new = s.staged(_lengths(facts), "lengths")
    sums = {k: notes[k] + v for k, v in _sums(new).items()}
    if touched is not None and "lengths" in s:
        ids = touched.select("session_id").distinct()
        old = s.staged(s.read("lengths").join(ids, "session_id", "left_semi"), "replaced")
        sums = {k: v - _sums(old)[k] for k, v in sums.items()}
        s.rewrite("lengths", new.join(ids, "session_id", "left_semi"), ids, "session_id")
        new = new.join(ids, "session_id", "left_anti")
        s.append("gone", old.select("doc", F.lit(segment).alias("before")), "doc")
    s.append("lengths", new, "session_id")
    s.append("postings", _postings(facts, segment), "term", sort_by=("term", "field"))
    if max(map(len, s.pending("postings")["parts"].values()), default=0) > SEGMENTS:
        merged = s.read_pending("postings")
        if s.pending("gone"):
            merged = live(merged, s.read_pending("gone"))
        s.replace("postings", merged, "term", sort_by=("term", "field"))
        if s.pending("gone"):
            s.replace("gone", s.read_pending("gone").limit(0), "doc")
    return s.commit(segment=segment, **sums)


def live(postings: DataFrame, gone: DataFrame) -> DataFrame:
    """Postings without those of facts that a later segment has replaced."""
    last = gone.groupBy("doc").agg(F.max("before").alias("before"))
    return postings.join(last, "doc", "left").filter(F.col("before").isNull() | (F.col("segment") >= F.col("before"))).drop("before")


def term_buckets(s: Store, wanted: list[str]) -> list[int]:
    """The buckets of a few terms, as the store deals them out."""
    terms = s.spark.createDataFrame([(t,) for t in wanted], "term string")
    return sorted({r.b for r in terms.select(s.bucket("term", s.manifest["tables"]["postings"]["buckets"]).alias("b")).collect()})


def find(spark: SparkSession, store: str, sessions: DataFrame, query: str, *, field: str = "all", engine: str | None = None, cwd: str | None = None, since: datetime | None = None, limit: int | None = 20) -> DataFrame:
    """What :func:`.search.search_facts` gives for the indexed facts, read from the buckets of the query's terms; of lengths those of shared session ids are summed."""
    s, wanted = Store(spark, store), search.query_terms(query)
    hits = s.read("postings", term_buckets(s, wanted) if wanted else []).filter(F.col("term").isin(wanted) if wanted else F.lit(False))
    if "gone" in s:
        hits = live(hits, s.read("gone"))
    notes = s.notes()
    counts = search.session_counts(sessions, engine, cwd)
    # The notes count each fact once; those whose session's id several sessions have stand there more often.
    shared = counts.filter("times > 1").select("session_id", (F.col("times") - 1).alias("more"))
    again = s.read("lengths").join(shared, "session_id").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(a) for a, c in (("n", F.col("more")), *((f, F.col(f) * F.col("more")) for f in FIELDS)))).first()
    sums = {c: notes[c] + again[c] for c in ("n", *FIELDS)}
    stats = spark.createDataFrame([(f, sums["n"], sums[f] / max(sums["n"], 1)) for f in FIELDS], "field string, n bigint, mean double")
    keep = search.field_filter(field)
    if since is not None:
        keep = keep & (F.col("ts") >= F.lit(since))
    df, kept = search.counted_hits(hits, counts, F.coalesce(keep, F.lit(False)), int(engine is None and cwd is None))
    return search.enriched(search.ranked(kept, df, stats, ("session_id",), limit), sessions)
