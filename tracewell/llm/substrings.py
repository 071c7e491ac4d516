"""Substring deduplication with prefix-partitioned suffix trees, truncated at the window's depth.

Every word position starts a suffix. Suffixes are split into groups by a prefix of variable length: it
takes words until it holds ``PREFIX_CHARS`` characters, so that frequent short words don't make large
groups. Groups are dealt to so many partitions that each fits in memory. A group's suffixes form
subtrees; the only nodes that matter are those ``window`` words deep, which are told apart by a 64-bit
hash of the path to them. Such a node with two or more leaves is a deep internal node: its window
repeats, and all its leaves but the first in (document, start) order are reported. Runs of reported
windows in a document are its maximal repeats. Inside a block of documents equal suffixes are combined
before anything is shuffled, so that a passage found everywhere is one leaf per block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, hash64, mix64, shuffle_width
from .packing import pack, unpack

PREFIX_CHARS = 12
PREFIX_WORDS = 8
BLOCK_BYTES = 6_000_000
GROUP_BYTES = 12_000_000
LEAVES = "grp int, block long, nodes binary, docs binary, starts binary"
FOUND = "block long, docs binary, starts binary"


def word_list(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def path_hashes(h: np.ndarray, depth: int) -> np.ndarray:
    """Hash of the ``depth`` words from each position on, where so many follow."""
    n = len(h) - depth + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    # Doubling: runs of 1, 2, 4 ... words are combined to runs of any length.
    power, width, out, done = mix64(h), 1, None, 0
    while width <= depth:
        if depth & width:
            out = power[:n] if out is None else mix64(out * np.uint64(0x9E3779B97F4A7C15) + power[done : done + n])
            done += width
        if width * 2 <= depth:
            power = mix64(power[: len(power) - width] * np.uint64(0xD6E8FEB86659FD93) + power[width:])
        width *= 2
    return out


def prefix_hashes(h: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Hash of each position's prefix: words until it holds ``PREFIX_CHARS`` characters."""
    key, size = mix64(h[:n]), lengths[:n].copy()
    for j in range(1, PREFIX_WORDS):
        short = size < PREFIX_CHARS
        if not short.any():
            break
        key = np.where(short, mix64(key + h[j : j + n]), key)
        size = np.where(short, size + lengths[j : j + n], size)
    return key


def leaves(docs: DataFrame, window: int, groups: int) -> DataFrame:
    """Rows of packed leaves per block and group. Leaves that a block itself found repeated need no group:
    they have no nodes, and a ``grp`` below 0 of their block's own."""

    def run(batches):
        from pyspark import TaskContext

        task, nth = TaskContext.get().partitionId(), 0
        with np.errstate(over="ignore"):
            for b in batches:
                sizes = pc.fill_null(pc.binary_length(b.column("text")), 0).to_pylist()
                for lo, hi in blocks(sizes, BLOCK_BYTES):
                    texts = [word_list(t) for t in b.column("text").slice(lo, hi - lo).to_pylist()]
                    ids = np.array(b.column("doc_id").slice(lo, hi - lo).to_pylist(), np.int64)
                    yield _block(task << 32 | nth, texts, ids, window, groups)
                    nth += 1

    return docs.select("doc_id", "text").mapInArrow(run, LEAVES)


def _block(block: int, texts: list[list[bytes]], ids: np.ndarray, window: int, groups: int) -> pa.RecordBatch:
    tokens = [w for t in texts for w in t]
    n = np.array([len(t) for t in texts])
    h = hash64(tokens)
    rows: list[tuple] = []
    if len(h) >= window:
        first = np.cumsum(n) - n
        owner = np.repeat(np.arange(len(n)), n)
        start = np.arange(len(h)) - first[owner]
        whole = (n[owner] - start >= window)[: len(h) - window + 1]
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        del tokens
        node, group = path_hashes(h, window), prefix_hashes(h, lengths, len(h) - window + 1)
        at = np.flatnonzero(whole)
        node, doc, start = node[at], ids[owner[at]], start[at]
        group = (mix64(group[at] ^ np.uint64(0x5555)) % np.uint64(groups)).astype(np.int64)
        order = np.lexsort((start, doc, node))
        node, doc, start, group = node[order], doc[order], start[order], group[order]
        again = np.zeros(len(node), bool)
        again[1:] = node[1:] == node[:-1]
        begin = np.maximum.accumulate(np.where(again, 0, np.arange(len(node))))
        known = again & ((doc != doc[begin]) | (start != start[begin]))  # a row that is there twice is one document
        if known.any():
            d, s = doc[known], start[known]
            o = np.lexsort((s, d))
            rows.append((-1 - (block ^ block >> 32) % 65_536, block, b"", pack(d[o], True), pack(s[o], True)))
        g, d, s, x = (a[~again] for a in (group, doc, start, node))
        o = np.lexsort((s, d, g))
        g, d, s, x = g[o], d[o], s[o], x[o]
        ends = np.cumsum(np.bincount(g, minlength=groups))
        for k in np.unique(g):
            i, j = (ends[k - 1] if k else 0), ends[k]
            rows.append((int(k), block, x[i:j].tobytes(), pack(d[i:j], True), pack(s[i:j], True)))
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    columns = list(zip(*rows)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["grp", "block", "nodes", "docs", "starts"])


def _found(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 3, (pa.int64(), pa.binary(), pa.binary()))], ["block", "docs", "starts"])


def _deep_nodes(table: pa.Table) -> pa.Table:
    """Leaves of a group's deep internal nodes other than each node's first, packed by the block they came from."""
    if table.column("grp")[0].as_py() < 0:
        return table.select(["block", "docs", "starts"])
    sources = table.column("block").to_pylist()
    node = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("nodes")]
    source, node = np.repeat(np.arange(len(node)), [len(x) for x in node]), np.concatenate(node)
    # Only leaves of internal nodes are unpacked further and sorted in full.
    order = np.argsort(node)
    ordered = node[order]
    twice = np.zeros(len(node), bool)
    twice[1:] = ordered[1:] == ordered[:-1]
    twice[:-1] |= twice[1:]
    at = np.sort(order[twice])
    node, source = node[at], source[at]
    doc, start = (np.concatenate([unpack(x.as_py(), np.int64, True) for x in table.column(c)])[at] for c in ("docs", "starts"))
    order = np.lexsort((start, doc, node))
    node, doc, start, source = node[order], doc[order], start[order], source[order]
    again = np.zeros(len(node), bool)
    again[1:] = node[1:] == node[:-1]
    begin = np.maximum.accumulate(np.where(again, 0, np.arange(len(node))))
    again &= (doc != doc[begin]) | (start != start[begin])
    doc, start, source = doc[again], start[again], source[again]
    order = np.lexsort((start, doc, source))
    doc, start = doc[order], start[order]
    which, first = np.unique(source[order], return_index=True)
    parts = zip(which, first, [*first[1:], len(doc)])
    return _found([(sources[k], pack(doc[i:j], True), pack(start[i:j], True)) for k, i, j in parts])


def _of_block(table: pa.Table) -> pa.Table:
    """``doc_id, starts`` of the documents of one block."""
    doc, start = (np.concatenate([unpack(x.as_py(), np.int64, True) for x in table.column(c)]) for c in ("docs", "starts"))
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    ids, at = np.unique(doc, return_index=True)
    offsets = np.append(at, len(doc)).astype(np.int32)
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "starts": pa.ListArray.from_arrays(pa.array(offsets), pa.array(start.astype(np.int32)))})


def repeated_windows(docs: DataFrame, *, window: int = 20) -> DataFrame:
    """``doc_id, starts``: each document's windows whose words also start earlier; one row per document."""
    volume = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    groups = max(shuffle_width(docs.sparkSession), 1 + int(volume // GROUP_BYTES))
    known = docs.filter(F.col("doc_id").isNotNull())
    found = leaves(known, window, groups).groupBy("grp").applyInArrow(_deep_nodes, FOUND)
    # A document's places come together by block first: rows per block and group, not per document and group.
    by_doc = found.groupBy("block").applyInArrow(_of_block, "doc_id long, starts array<int>")
    return by_doc.groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("starts"))).alias("starts"))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text, repeats`` per input row.

    Words covered by a repeated window go; ``kept_text`` joins the others by one blank; ``repeats`` holds
    the removed spans (start, end) in words: the document's maximal repeats. Ids are integers. Rows with
    equal ids are one document: they don't repeat each other at the same place. Rows without an id are
    neither sources nor changed. Null text has no words; other columns are ignored. An empty table gives no rows; texts of
    any length are read whole. Of places with one window the smallest id, and in it the first place, is the one that stays.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    starts = repeated_windows(src, window=window)
    joined = src.join(starts, "doc_id", "left")
    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("repeats", spans)])

    def run(batches):
        span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                n, removed, kept, repeats = [], [], [], []
                for text, found in zip(part.column("text").to_pylist(), part.column("starts")):
                    words = word_list(text)
                    edges: list[dict] = []
                    if found.is_valid:
                        s = found.values.to_numpy()
                        s = s[s + window <= len(words)]
                        cut = np.flatnonzero(np.diff(s) > window) + 1
                        edges = [{"start": int(x[0]), "end": int(x[-1]) + window} for x in np.split(s, cut) if len(x)]
                    rest, last = [], 0
                    for e in edges:
                        rest += words[last : e["start"]]
                        last = e["end"]
                    rest = rest + words[last:] if edges else words
                    n.append(len(words))
                    removed.append(len(words) - len(rest))
                    kept.append(b" ".join(rest).decode("utf-8", "surrogatepass"))
                    repeats.append(edges)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(repeats, span_type)], out.fieldNames()
                )

    return joined.select("doc_id", "text", "starts").mapInArrow(run, out)
