"""Near-duplicate groups: one-permutation MinHash, optimal densification, banded buckets, star edges.

A document's shingles are hashed once; the hash picks a bin and the smallest value of a bin is kept.
An empty bin takes the value of the first non-empty bin that a fixed sequence of draws, its own and the
same for all documents, points to. Bands of bins make buckets. Documents with equal shingle sets are
one node. In each bucket the node with most company is the centre of a star; only star edges are candidates, and
at first each node checks the one to the centre it shares most bands with, on full sets. Buckets whose
members all end in one component are done. In the others all star edges are checked, and then members
that differ from the centre in the same shingles, by a bound that no linked pair can miss. So no link is
lost to the star's shape, and most members are of one component before they meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, hash64, mix64, space_tokens, stored

DRAWS = 64


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words of one document; the whole sequence if it is shorter."""
    if not len(h):
        return h
    k = min(size, len(h))
    with np.errstate(over="ignore"):
        x = mix64(h[: len(h) - k + 1] + np.uint64(k))
        for j in range(1, k):
            x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j])
    return x


def draws(bins: int) -> np.ndarray:
    """For each bin the fixed sequence of bins it asks when it is empty."""
    i, j = np.meshgrid(np.arange(bins, dtype=np.uint64), np.arange(DRAWS, dtype=np.uint64), indexing="ij")
    return (mix64(i * np.uint64(1_000_003) + j + np.uint64(17)) % np.uint64(bins)).astype(np.int64)


def densified(owner: np.ndarray, x: np.ndarray, n_docs: int, table: np.ndarray) -> np.ndarray:
    """Signatures (documents x bins) of the hashes ``x`` of documents ``owner``, each with one at least."""
    bins = len(table)
    sig = np.full(n_docs * bins, np.iinfo(np.uint64).max, np.uint64)
    where = owner * bins + (x % np.uint64(bins)).astype(np.int64)
    np.minimum.at(sig, where, x)
    full = np.zeros(n_docs * bins, bool)
    full[where] = True
    sig, full = sig.reshape(n_docs, bins), full.reshape(n_docs, bins)
    doc, empty = np.nonzero(~full)
    draw = 0
    while len(doc):
        asked = table[empty, draw] if draw < DRAWS else (mix64(empty.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(draw + 17)) % np.uint64(bins)).astype(np.int64)
        met = full[doc, asked]
        sig[doc[met], empty[met]] = sig[doc[met], asked[met]]
        doc, empty, draw = doc[~met], empty[~met], draw + 1
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Bucket of each document (row of ``sig``) in each band."""
    parts = sig.reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sig), bands))
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def _sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, ascending."""
    tokens = [space_tokens(t) for t in texts]
    h, at, out = hash64([w for t in tokens for w in t]), 0, []
    runs = shingle_hashes(h, size) if len(h) >= size else h
    for t in tokens:
        n = len(t)
        out.append(np.unique(runs[at : at + n - size + 1] if n >= size else shingle_hashes(h[at : at + n], size)))
        at += n
    return out


def signatures(docs: DataFrame, *, shingle: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, text_key, n_shingles, set_a, set_b`` (128 bits that stand for the shingle set) and ``keys``."""
    out = T.StructType([docs.schema["doc_id"], docs.schema["text_key"], *(T.StructField(n, T.LongType()) for n in ("n_shingles", "set_a", "set_b")), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches):
        table = draws(bands * rows)
        for b in batches:
            texts = b.column("text")
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for lo, hi in blocks(sizes, 2_000_000):
                sets = _sets(texts.slice(lo, hi - lo).to_pylist(), shingle)
                n = np.array([len(x) for x in sets])
                some = np.flatnonzero(n)
                keys: list = [None] * len(sets)
                a, z = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
                if len(some):
                    x, owner = np.concatenate(sets), np.repeat(np.arange(len(some)), n[some])
                    begin = np.cumsum(n[some]) - n[some]
                    a[some] = np.add.reduceat(x, begin).view(np.int64)
                    z[some] = np.add.reduceat(mix64(x ^ np.uint64(0xA5A5A5A5)), begin).view(np.int64)
                    for i, k in zip(some, band_keys(densified(owner, x, len(some), table), bands, rows)):
                        keys[i] = k
                columns = [pa.array(n, pa.int64()), pa.array(a), pa.array(z), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, hi - lo) for c in ("doc_id", "text_key")), *columns], out.fieldNames())

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, out)


def shingle_sets(docs: DataFrame, *, shingle: int) -> DataFrame:
    """``node, shingles`` (sorted distinct 64-bit hashes) of documents with ``node, text``."""
    out = T.StructType([docs.schema["node"], T.StructField("shingles", T.ArrayType(T.LongType()))])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = [x.view(np.int64) for x in _sets(part.column("text").to_pylist(), shingle)]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return docs.select("node", "text").mapInArrow(run, out)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` (the smallest node reachable) of all nodes in ``edges`` (``a``, ``b``).

    Smallest labels travel over edges and then along labels, so that chains shorten fast; every round
    is written to the shared folder. Hubs are no hot spot: minima are combined before each shuffle.
    """
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = stored(edges.select(ways.alias("e")).select("e.a", "e.b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    for _ in range(max_rounds):
        seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("c"))
        lower = labels.join(seen, labels["node"] == seen["a"]).select("node", F.col("component").alias("old"), F.least("component", "c").alias("component"))
        up = labels.select(F.col("node").alias("p"), F.col("component").alias("pc"))
        new = lower.join(up, F.col("component") == F.col("p"), "left").select("node", "old", F.least("component", F.coalesce("pc", "component")).alias("component"))
        new = stored(new, "labels")
        changed = new.filter("component <> old").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def extended_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after the further ``links`` (``a``, ``b``): components are worked out between old labels.

    Only links between two components take part, once for each pair of components, so that the rounds
    carry no row for links inside one component. A node that ``labels`` lacks is a component by itself.
    """
    old = [labels.select(F.col("node").alias(n), F.col("component").alias(f"l{n}")) for n in ("a", "b")]
    named = links.join(old[0], "a", "left").join(old[1], "b", "left")
    moved = connected_components(named.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).filter("a <> b"))
    single = moved.select("node", F.col("node").alias("component")).join(labels.select("node"), "node", "left_anti")
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
    new = labels.select("node", "component").union(single).join(to, "component", "left")
    return stored(new.select("node", F.coalesce("to", "component").alias("component")), "labels")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b`` with ``shared`` and ``total``: the sizes of intersection and union of their full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("sa", "sb")))
    return both.select("a", "b", "shared", (F.size("sa") + F.size("sb") - F.col("shared")).alias("total"))


def alike(members: DataFrame, sets: DataFrame, *, percent: int) -> DataFrame:
    """Pairs ``a, b`` of stars' members that may be linked though a component parts them.

    ``members``: ``centre, node, label, stranger`` (its component isn't the centre's, so that it isn't linked
    with the centre). Of two linked members of different components one at least is a stranger.
    With D the shingles in which a member A and the centre C differ, and k = (1 - t) / (1 + t) for the
    similarity t, A and B are linked if and only if |D_A| + |D_B| - 2 |D_A & D_B| <= k (|A| + |B|).
    Where A is a stranger, |D_A| > k (|A| + |C|), and as |B| <= |C| + |D_B|, the differences share more
    than (1 - k) |D_B| / 2 shingles, and (|D_A| - k (|A| + |C|)) / (1 + k) or more. So each member shows
    only so many of its rarest differences that a partner must have one of them, and a pair meets there,
    if the differences that follow in both orders can still make up the number the pair has to share.
    """
    k = (100 - percent) / (100 + percent)
    of_node = sets.select("node", F.col("shingles").alias("sn"))
    of_centre = sets.select(F.col("node").alias("centre"), F.col("shingles").alias("sc"))
    both = members.join(of_node, "node").join(of_centre, "centre")
    both = both.withColumn("differ", F.concat(F.array_except("sn", "sc"), F.array_except("sc", "sn"))).withColumn("n", F.size("sn"))
    own = (F.size("differ") - k * (F.col("n") + F.size("sc"))) / (1 + k)
    need = F.greatest(F.ceil(F.when(F.col("stranger"), own).otherwise((1 - k) / 2 * F.size("differ")) - 1e-6), F.lit(1))
    shown = stored(both.select("centre", "node", "label", "stranger", "n", need.alias("need"), F.size("differ").alias("d"), F.explode("differ").alias("x")), "differences")
    common = shown.groupBy("centre", "x").agg(F.count("*").alias("f"), F.max("stranger").alias("met")).filter("f > 1 AND met").drop("met")
    own_rows = Window.partitionBy("centre", "node")
    ranked = shown.join(common, ["centre", "x"]).withColumn("nth", F.row_number().over(own_rows.orderBy("f", "x"))).withColumn("has", F.count("*").over(own_rows))
    rare = stored(ranked.filter(F.col("nth") <= F.col("has") - F.col("need") + 1).select("centre", "x", "node", "label", "stranger", "n", "d", (F.col("has") - F.col("nth") + 1).alias("left")), "rare")
    left = rare.filter("stranger").select("centre", "x", F.col("node").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("d").alias("da"), F.col("left").alias("fa"))
    right = rare.select("centre", "x", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("d").alias("db"), F.col("left").alias("fb"), F.col("stranger").alias("sb"))
    enough = 2 * F.least("fa", "fb") >= F.col("da") + F.col("db") - k * (F.col("na") + F.col("nb")) - 1e-6
    fits = (F.col("la") != F.col("lb")) & (~F.col("sb") | (F.col("a") < F.col("b"))) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return left.join(right, ["centre", "x"]).filter(fits & enough).select("a", "b")


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    bands: int = 40,
    rows: int = 6,
) -> DataFrame:
    """One row per input row: ``doc_id, text_key, n_shingles, component, component_id, kept`` (``doc_id = component_id``).

    Ids are integers. Two documents are linked when ``100 * intersection >= percent * union`` of their
    distinct shingles; with fewer words the whole sequence is the one shingle; without words (or null) a
    document is linked with nothing. Rows with words and equal ids count as linked, whatever their texts. A row with a null id
    is linked like others; it takes the smallest id of its group, if any, and isn't kept. ``component`` is a number of the
    group, also where no row of it has an id; null without words. An empty table gives no rows; other columns, of any
    name, are not looked at; long texts are read whole. At similarity 0.8 a pair shares no bucket, and so is lost,
    with a chance of (1 - 0.8^6)^40, about 5 in a million; more similar pairs far less.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"))
    sigs = stored(signatures(src, shingle=shingle, bands=bands, rows=rows), "signatures")
    # Documents of one shingle set are one class: a node of its own, with or without ids. One of its texts stands for all.
    sample = F.min(F.struct("text_key", "doc_id"))
    classes = sigs.filter("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("first_id"), sample.alias("sample"), F.first("keys").alias("keys"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    named = classes.select("node", F.col("set_a").alias("sa"), F.col("set_b").alias("sb"), F.col("n_shingles").alias("ns"))
    same = (F.col("set_a") == F.col("sa")) & (F.col("set_b") == F.col("sb")) & (F.col("n_shingles") == F.col("ns"))
    owned = stored(sigs.drop("keys").join(named, same, "left").select("doc_id", "text_key", "n_shingles", "node"), "owned")

    slots = classes.select("node", "n_shingles", F.posexplode("keys").alias("band", "key"))
    shared = slots.groupBy("band", "key").agg(F.count("*").alias("members")).filter("members > 1")
    grouped = stored(slots.join(shared, ["band", "key"]), "grouped")
    # A bucket's centre is the member with the most company in all its buckets: of many edited copies of one
    # text that is the text itself or the copy nearest to it, and its star links them all at once.
    company = grouped.groupBy("node").agg(F.sum("members").alias("company"))
    ranked = grouped.drop("members").join(company, "node")
    chosen = ranked.groupBy("band", "key").agg(F.max_by("node", F.struct("company", -F.col("node"))).alias("centre"))
    members = stored(ranked.join(chosen, ["band", "key"]), "members")
    involved = members.select("node").distinct()
    chosen_text = classes.join(involved, "node", "left_semi").select("node", F.col("sample.text_key").alias("k"), F.col("sample.doc_id").alias("d"))
    texts = src.join(chosen_text, (F.col("text_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("node", "text")
    sets = stored(shingle_sets(texts, shingle=shingle).dropDuplicates(["node"]), "sets")
    linked = 100 * F.col("shared") >= percent * F.col("total")

    # First every node is compared with one centre, the one it shares most bands with.
    star = members.filter("centre <> node").groupBy("node", "centre").agg(F.count("*").alias("n"))
    star = star.groupBy(F.col("node").alias("b")).agg(F.max_by("centre", F.struct("n", -F.col("centre"))).alias("a"))
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # Pairs that have been compared, with the sizes found; none is compared twice.
    seen = stored(compared(ordered(star), sets), "compared")
    # Texts of one id are linked without a comparison.
    by_id = owned.filter("doc_id IS NOT NULL AND node IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z")
    of_id = owned.join(by_id, "doc_id").filter("node > a").select("a", F.col("node").alias("b"))
    labels = connected_components(seen.filter(linked).select("a", "b").unionByName(of_id))

    def mixed(base: DataFrame) -> DataFrame:
        """Those rows of ``base``, with labels, whose buckets more than one component shares."""
        labelled = base.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
        ends = labelled.groupBy("band", "key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.when(F.col("node") == F.col("centre"), F.col("label"))).alias("centre_label"))
        return labelled.join(ends.filter("low < high").drop("low", "high"), ["band", "key"])

    def compare(pairs: DataFrame) -> None:
        nonlocal seen, labels
        new = stored(compared(ordered(pairs).join(seen, ["a", "b"], "left_anti"), sets), "compared")
        found = new.filter(linked).select("a", "b")
        seen = seen.union(new)
        if found.limit(1).count():
            labels = extended_components(labels, found)

    # Then, in buckets not yet of one component, all members are compared with their bucket's centre.
    # Components only grow together, so a bucket of one component is done.
    unsettled = stored(mixed(members).drop("label", "centre_label"), "mixed")
    compare(unsettled.filter("centre <> node").select(F.col("centre").alias("a"), F.col("node").alias("b")))

    # Last, in buckets that still aren't of one component, members that differ from the centre alike are compared.
    rest = mixed(unsettled).filter("node <> centre").select("centre", "node", "label", (F.col("label") != F.col("centre_label")).alias("stranger")).distinct()
    compare(alike(rest, sets, percent=percent))

    groups = classes.select("node", "first_id").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = groups.groupBy("component").agg(F.min("first_id").alias("component_id"))
    found = groups.select("node", "component").join(smallest, "component")
    out = owned.join(found, "node", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "text_key", "n_shingles", "component", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
