"""Secret scans that link the parts of multi-part credentials.

Strong kinds (assignments, access identifiers, long hex runs) are reported by themselves. Weak kinds
(long base-64 runs, endpoints) are reported only when a complementary part stands within ``reach``
characters in the same document: an interval join of the parts' spans, bucketed by position. Built-in
expressions only. Offsets are code points: a text's matches and the gaps between them are summed up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, stored

# kind: pattern, group that must be long enough, least length, role in a credential, reported alone
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, "secret", True),
    "access": (r"AKIA[A-Z0-9]+", 0, 16, "id", True),
    "hex": (r"[0-9a-f]+", 0, 32, "secret", True),
    "key40": (r"[A-Za-z0-9+/]+", 0, 40, "secret", False),
    "endpoint": (r"https?://[A-Za-z0-9._~:/-]+", 0, 12, "endpoint", False),
}
BASE = ("assign", "access", "hex")
# What a text must contain for its matches of a kind to be worked out at all.
NEEDED = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)",
    "access": "AKIA[A-Z0-9]{12}",
    "hex": "[0-9a-f]{32}",
    "key40": "[A-Za-z0-9+/]{40}",
    "endpoint": "https?://[A-Za-z0-9._~:/-]",
}


def text_key(id_col: Column, text: Column) -> list[Column]:
    return [id_col.alias("doc_id"), F.xxhash64(text).alias("text_key")]


def _matches(text: str, kind: str) -> Column:
    """Array of (kind, ordinal, gap before the match, its length, length of the tested group) of one kind."""
    pattern, group, *_ = KINDS[kind]
    if group == 0 and kind not in ("endpoint",):
        # Runs of one class: asking for the least length at once skips the short runs and finds the same long ones.
        pattern = pattern[:-1] + "{%d,}" % (KINDS[kind][2] - (4 if kind == "access" else 0))
    rx = F.lit(pattern)
    found = F.regexp_extract_all(F.col(text), rx, F.lit(0))
    tested = F.regexp_extract_all(F.col(text), rx, F.lit(group))
    gaps = F.split(F.col(text), pattern, -1)
    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("g"), found.alias("m"), tested.alias("t"))
    row = lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("size"), F.length(x["t"]).alias("tested"))
    return F.when(F.col(text).rlike(NEEDED[kind]), F.transform(zipped, row)).otherwise(F.array().cast("array<struct<kind: string, nth: int, gap: int, size: int, tested: int>>"))


def spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All spans long enough, weak ones included: ``doc_id, text_key, kind, start, end``, once per text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(*text_key(F.col(id_col), text), text.alias("text"))
    # One pass over each text; the outer form keeps Spark from working the matches out once more in a filter.
    matches = F.concat(*(_matches("text", kind) for kind in KINDS))
    rows = df.select("doc_id", "text_key", F.explode_outer(matches).alias("x")).filter("x IS NOT NULL")
    rows = rows.select("doc_id", "text_key", "x.*").dropDuplicates(["doc_id", "text_key", "kind", "nth"])
    w = Window.partitionBy("doc_id", "text_key", "kind").orderBy("nth")
    end = F.sum(F.col("gap") + F.col("size")).over(w)
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    enough = F.lit(False)
    for kind, (_, _, least, _, _) in KINDS.items():
        enough = enough | ((F.col("kind") == kind) & (F.col("tested") >= least))
    return rows.filter(enough).select("doc_id", "text_key", "kind", "start", "end")


def linked_spans(found: DataFrame, *, reach: int = 200) -> DataFrame:
    """Strong spans, and weak ones with a complementary part (another role) within ``reach`` characters."""
    role = F.create_map(*(F.lit(x) for k, v in KINDS.items() for x in (k, v[3])))
    strong = [k for k, v in KINDS.items() if v[4]]
    parts = found.withColumn("role", role[F.col("kind")])
    weak = parts.filter(~F.col("kind").isin(*strong)).withColumn("bucket", F.explode(F.sequence(F.floor((F.col("start") - reach) / reach), F.floor((F.col("end") + reach) / reach))))
    others = parts.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), F.col("role").alias("other"), F.col("kind").alias("other_kind"), F.col("start").alias("s"), F.col("end").alias("e"), F.explode(F.sequence(F.floor(F.col("start") / reach), F.floor(F.col("end") / reach))).alias("b"))
    near = (F.col("doc_id").eqNullSafe(F.col("d"))) & (F.col("text_key") == F.col("k")) & (F.col("bucket") == F.col("b"))
    near = near & (F.col("role") != F.col("other")) & (F.col("s") < F.col("end") + reach) & (F.col("e") > F.col("start") - reach)
    # A run that is an assignment's value or a hex run already has been reported as such.
    # It is looked for among the runs that reach over the stretch it starts in, so that a text of very many spans isn't compared all with all.
    stretch = lambda c: F.floor(F.col(c) / reach)
    own = found.filter(F.col("kind").isin(*strong)).select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), F.col("start").alias("s"), F.col("end").alias("e"), F.explode(F.sequence(stretch("start"), stretch("end"))).alias("b"))
    inside = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")) & (stretch("start") == F.col("b")) & (F.col("s") <= F.col("start")) & (F.col("e") >= F.col("end"))
    kept = weak.join(others, near, "left_semi").select(*found.columns).distinct().join(own, inside, "left_anti")
    return found.filter(F.col("kind").isin(*strong)).unionByName(kept)


def secret_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """One row per input row: ``doc_id``, ``text_key``, counts of the strong kinds and ``spans``.

    ``spans`` is an array of (start, rank, kind, end), ordered by start and then kind. Null and empty
    texts have none; repeated rows give repeated results; null ids are allowed; other columns are ignored. An empty
    table gives no rows; texts of any length are read whole; spans that begin at one place are in the order of their kinds.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rank = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
    # Written once: the link step reads the spans several times, and each reading would search the texts again.
    rows = linked_spans(stored(spans(docs, id_col=id_col, text_col=text_col), "spans"), reach=reach)
    listed = F.array_sort(F.collect_list(F.struct("start", rank[F.col("kind")].alias("rank"), "kind", "end")))
    by_text = rows.groupBy("doc_id", "text_key").agg(listed.alias("spans"), *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE))
    left = docs.select(*text_key(F.col(id_col), text)).alias("l")
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.text_key") == F.col("r.text_key"))
    none = F.expr("CAST(array() AS ARRAY<STRUCT<start: BIGINT, rank: INT, kind: STRING, end: BIGINT>>)")
    return left.join(by_text.alias("r"), same, "left").select(
        "l.doc_id", "l.text_key", *(F.coalesce(f"r.n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in BASE), F.coalesce("r.spans", none).alias("spans")
    )


def listed(found: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]", reach: int = 200) -> DataFrame:
    """``docs`` with every span replaced by ``mask`` in the text; overlapping spans are masked as one.

    Columns of ``docs`` keep their values, whatever their names. An empty table gives no rows.
    """
    found = secret_scan(docs, id_col=id_col, text_col=text_col, reach=reach).filter(F.size("spans") > 0)
    own, other, key, spans_ = (free_name(docs, n) for n in ("__k", "__id", "__key", "__spans"))
    found = found.select(F.col("doc_id").alias(other), F.col("text_key").alias(key), F.col("spans").alias(spans_)).dropDuplicates([other, key])
    joined = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).join(found, F.col(id_col).eqNullSafe(F.col(other)) & (F.col(own) == F.col(key)), "left")
    step = lambda acc, x: F.struct(
        F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.substring(F.col(text_col), (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.lit(mask))).otherwise(acc["out"]).alias("out"),
        F.greatest(acc["at"], x["end"]).alias("at"),
    )
    merged = F.aggregate(spans_, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), step, lambda a: F.concat(a["out"], F.substring(F.col(text_col), (a["at"] + 1).cast("int"), 2**31 - 1)))
    return joined.withColumn(text_col, F.when(F.col(spans_).isNotNull(), merged).otherwise(F.col(text_col))).select(*docs.columns)
