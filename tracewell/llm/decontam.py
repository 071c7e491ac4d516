"""Benchmark decontamination over a distributed positional inverted index.

Each benchmark window is looked up by its rarest terms in the corpus. The index holds the postings
(term, document, position) of just those terms. A window's lists, each shifted by its term's offset,
are intersected on (document, start), within a slop if asked for; what all lists share is checked word by
word against the text, as an exact phrase or as most of its words close together.
Built-in expressions only; the benchmark side is broadcast only while its counted size is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NON_WORD, ascii_lower, stored, words

BROADCAST_ROWS = 200_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_windows(items: DataFrame, size: int, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows of ``size`` words per item; an item of fewer words, but not none, is one window."""
    w = items.select(F.col(id_col).cast("string").alias("item_id"), words(ascii_lower(F.col(text_col)), NON_WORD).alias("w")).filter((F.size("w") > 0) & F.col("item_id").isNotNull())
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return w.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.slice("w", F.col("at"), size).alias("terms")).distinct()


def index(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """Postings ``doc_id, text_key, term, pos`` of the wanted terms; equal rows of documents share theirs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    each = docs.select("doc_id", F.xxhash64(text).alias("text_key"), F.posexplode(words(ascii_lower(text), NON_WORD)).alias("pos", "term"))
    return each.join(_small(terms, n_terms), "term", "left_semi")


def phrase_matches(docs: DataFrame, items: DataFrame, *, window: int = 10, lists: int = 2, slop: int | None = None, share: int = 80) -> DataFrame:
    """Where windows of ``items`` occur in ``docs``: ``doc_id, text_key, item_id, start, n, exact``.

    ``docs`` has ``doc_id, text``; ``items`` has ``item_id, text``. All places are verified on the text.
    With ``slop`` also proximity matches of whole windows are returned (``exact`` false): the ``lists``
    rarest terms of a window that the corpus holds lie at most ``slop`` words from where the rarest one
    puts them, and at least ``share`` percent of the window's distinct terms stand in the window's place
    widened by ``slop`` words on either side. ``start`` and ``n`` are cut to the text.
    """
    reach = slop or 0
    windows = stored(item_windows(items, window).withColumn("window_id", F.xxhash64(F.array_join("terms", " "))), "windows")
    distinct = windows.select("window_id", "terms").dropDuplicates(["window_id"])
    vocabulary = windows.select(F.explode("terms").alias("term")).distinct()
    counts = index(docs, vocabulary, vocabulary.count()).groupBy("term").agg(F.count("*").alias("n"))
    used = distinct.select("window_id", F.size("terms").alias("size"), F.size(F.array_distinct("terms")).alias("n_terms"), F.posexplode("terms").alias("offset", "term"))
    by_rarity = F.array_sort(F.collect_list(F.struct("n", "offset", "term")))
    ranked = used.join(counts, "term").groupBy("window_id", "size", "n_terms").agg(F.slice(by_rarity, 1, lists).alias("rare"), F.count("*").alias("found"), F.size(F.collect_set("term")).alias("found_terms"))
    # A window with a term that no document has can't occur; near it can be, if the others suffice.
    possible = F.col("found") == F.col("size")
    if slop is not None:
        possible = possible | ((F.col("size") == window) & (100 * F.col("found_terms") >= share * F.col("n_terms")))
    lookups = stored(ranked.filter(possible).select("window_id", F.posexplode("rare").alias("nth", "x"), F.size("rare").alias("needed")).select("window_id", "nth", "needed", "x.offset", "x.term"), "lookups")
    n_lookups = lookups.count()
    terms = lookups.select("term").distinct()
    postings = stored(index(docs, terms, n_lookups), "postings")
    placed = postings.join(_small(lookups, n_lookups), "term").select("doc_id", "text_key", "window_id", "nth", "needed", (F.col("pos") - F.col("offset")).alias("start"))
    # The shifted lists of a window and a text are intersected round each posting of the rarest term.
    round_it = Window.partitionBy("doc_id", "text_key", "window_id").orderBy("start").rangeBetween(-reach, reach)
    met = placed.filter(F.col("start") >= -reach).withColumn("met", F.size(F.collect_set("nth").over(round_it)))
    candidates = met.filter((F.col("nth") == 0) & (F.col("met") == F.col("needed"))).select("doc_id", "text_key", "window_id", "start").distinct()
    n_windows = distinct.count()
    wanted = candidates.join(_small(distinct, n_windows), "window_id")
    per_doc = wanted.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("window_id", "start", F.size("terms").alias("n"), F.array_join("terms", " ").alias("phrase"))).alias("c"))
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(F.col("doc_id").alias("d"), F.xxhash64(text).alias("k"), text.alias("text"))
    joined = per_doc.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")))
    checked = joined.select("doc_id", "text_key", "c", words(ascii_lower(F.col("text")), NON_WORD).alias("w"))

    def exact(x: Column) -> Column:
        return (x["start"] >= 0) & (F.array_join(F.slice("w", F.greatest(x["start"], F.lit(0)) + 1, x["n"]), " ") == x["phrase"])

    def near(x: Column) -> Column:
        first, wanted_terms = F.greatest(x["start"] - reach, F.lit(0)), F.array_distinct(F.split(x["phrase"], " "))
        around = F.slice("w", first + 1, x["start"] + x["n"] + reach - first)
        return (x["n"] == window) & (100 * F.size(F.array_intersect(wanted_terms, around)) >= share * F.size(wanted_terms))

    if slop is None:
        judged = F.transform(F.filter("c", exact), lambda x: x.withField("exact", F.lit(True)))
    else:
        judged = F.filter(F.transform("c", lambda x: x.withField("exact", exact(x))), lambda x: x["exact"] | near(x))
    hits = checked.select("doc_id", "text_key", F.size("w").alias("n_words"), F.explode(judged).alias("x")).distinct()
    first, end = F.greatest("x.start", F.lit(0)), F.least(F.col("x.start") + F.col("x.n"), F.col("n_words"))
    out = hits.select("doc_id", "text_key", "x.window_id", first.alias("start"), (end - first).alias("n"), "x.exact")
    return out.join(_small(windows.select("window_id", "item_id"), windows.count()), "window_id").select("doc_id", "text_key", "item_id", "start", "n", "exact")


def _word_count(text: Column) -> Column:
    # The words of the lower-cased text, counted without lower-casing it; a split takes a fifth of regexp_count's time.
    return F.size(F.array_remove(F.split(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")).cast("long")


def contamination(docs: DataFrame, items: DataFrame, *, window: int = 10, lists: int = 2, slop: int | None = None) -> DataFrame:
    """Per row of ``docs``: ``doc_id, text_key, n_words, n_hit, n_items, item_ids, n_near, near_item_ids, contaminated``.

    ``docs`` needs ``doc_id, text``, ``items`` needs ``item_id, text``; other columns are ignored. Null
    and empty texts have no words and are clean; items without words or without an id never match; repeated rows give repeated
    results; items with equal ids count once. Null ids of documents are allowed; an empty table on either side
    gives no hits. Of equally rare terms the first ones of a window are looked up. Texts are searched whole.
    With ``slop``, ``n_near`` counts the words of proximity matches that no exact one covers and
    ``near_item_ids`` are the items with proximity matches alone; they report and don't contaminate.
    """
    found = stored(phrase_matches(docs, items, window=window, lists=lists, slop=slop), "matches")
    places = found.select("doc_id", "text_key", "exact", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("pos"))
    places = places.groupBy("doc_id", "text_key", "pos").agg(F.max("exact").alias("exact"))
    hit = places.groupBy("doc_id", "text_key").agg(F.count_if("exact").alias("n_hit"), F.count_if(~F.col("exact")).alias("n_near"))
    by_item = found.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("item_id")))).alias("item_ids"), F.collect_set("item_id").alias("all_ids"))
    text = F.coalesce(F.col("text"), F.lit(""))
    left = docs.select("doc_id", F.xxhash64(text).alias("text_key"), _word_count(text).alias("n_words")).alias("l")
    same = lambda r: F.col("l.doc_id").eqNullSafe(F.col(f"{r}.doc_id")) & (F.col("l.text_key") == F.col(f"{r}.text_key"))
    out = left.join(hit.alias("h"), same("h"), "left").join(by_item.alias("i"), same("i"), "left")
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    items_, near_ = F.coalesce("i.item_ids", none), F.coalesce(F.array_sort(F.array_except("i.all_ids", "i.item_ids")), none)
    n_hit, n_near = (F.coalesce(f"h.{c}", F.lit(0).cast("long")) for c in ("n_hit", "n_near"))
    return out.select("l.doc_id", "l.text_key", "l.n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"), items_.alias("item_ids"), n_near.alias("n_near"), near_.alias("near_item_ids"), (n_hit > 0).alias("contaminated"))
