"""Byte-level BPE encoding by overlapping chunks, and decoding.

A text of at most ``chunk_chars`` characters is pre-tokenised where it is read. A longer one is cut into
overlapping chunks that different tasks pre-tokenise; a chunk's boundaries are kept from the first place
in the overlap where they coincide with those of the chunk before it, and the pieces between the kept
boundaries are encoded. The pattern looks ahead only, so pre-tokenisation from a shared boundary on is the
same in both. A chunk's last ``GUARD`` characters are never trusted, because a match there may have been
cut short. If no boundary is shared within an overlap (a run without any), the whole text is pre-tokenised
in one go.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks

GUARD = 4
#: Bytes of pieces and ids that a worker's cache may hold.
CACHE_BYTES = 12_000_000
BLOCK_BYTES = 2_000_000


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Encodes pre-tokens by merge ranks, each distinct one once while it stays in the cache."""

    def __init__(self, path: str, pattern: str):
        self.ranks = _ranks(path)
        self.pattern = regex.compile(pattern)
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.cache: dict[str, bytes] = {}
        self.cached = 0
        self.bytes_of = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, i in self.ranks.items():
            self.bytes_of[i] = token

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def packed(self, pieces: list[str]) -> bytes:
        """The ids of all pieces in order, packed as 32-bit integers."""
        cache = self.cache
        if self.cached > CACHE_BYTES:
            cache.clear()
            self.cached = 0
        for p in set(pieces).difference(cache):
            raw = p.encode("utf-8", "surrogatepass")
            one = self.ranks.get(raw)
            ids = np.array([one] if one is not None else self.core._encode_single_piece(raw), np.int32).tobytes()
            cache[p] = ids
            self.cached += 150 + len(raw) + len(ids)
        return b"".join(map(cache.__getitem__, pieces))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(self.pieces(text)), np.int32)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _id_lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32, copy=False), pa.int32()))


def encode_documents(
    docs: DataFrame,
    *,
    ranks_path: str,
    pattern: str = public_tokenizers.PATTERN,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_chars: int = 32_768,
    overlap_chars: int = 1_024,
    decode: bool = False,
) -> DataFrame:
    """One row per input row: ``doc_id`` (any type, kept), ``ids`` (array of int).

    With ``decode`` also ``decoded``, the raw bytes that the ids stand for, worked out in the same pass.
    Null and empty texts give an empty array, an empty table gives no rows; repeated rows give repeated
    results; other columns, whatever their names, are ignored. There are no ties: a text has one encoding.
    Very long texts are pre-tokenised in chunks by many tasks; one task stitches and encodes each of them.
    ``ranks_path`` must be readable on every executor.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    fields = [T.StructField("doc_id", src.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    out = T.StructType([*fields, *([T.StructField("decoded", T.BinaryType())] if decode else [])])

    def columns(ids: list[np.ndarray], c: Codec) -> list[pa.Array]:
        return [_id_lists(ids), *([pa.array([c.decode(x.tolist()) for x in ids], pa.binary())] if decode else [])]

    def encode_whole(batches):
        c = codec(ranks_path, pattern)
        for b in batches:
            column = b.column("text")
            for lo, hi in blocks(pc.binary_length(column).to_pylist(), BLOCK_BYTES):
                ids = [c.encode(t) for t in column.slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), *columns(ids, c)], out.fieldNames())

    short = src.filter(F.length("text") <= chunk_chars).mapInArrow(encode_whole, out)

    step = chunk_chars - overlap_chars
    long = src.filter(F.length("text") > chunk_chars)
    chunks = long.select(
        "doc_id",
        F.xxhash64("text").alias("text_key"),
        F.length("text").alias("n_chars"),
        F.explode(F.sequence(F.lit(0), F.length("text") - overlap_chars - 1, F.lit(step))).alias("start"),
        "text",
    ).select("doc_id", "text_key", "n_chars", "start", F.substring("text", F.col("start") + 1, chunk_chars).alias("chunk"))
    # Chunks are dealt out evenly so that one long text is worked on by many tasks.
    chunks = chunks.repartition("doc_id", "text_key", "start")
    split = T.StructType([*chunks.schema.fields, T.StructField("ends", T.BinaryType())])

    def split_chunks(batches):
        c = codec(ranks_path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                ends = [np.cumsum([len(p) for p in c.pieces(chunk)], dtype=np.int32).tobytes() for chunk in part.column("chunk").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ends, pa.binary())], split.fieldNames())

    def encode_stitched(table: pa.Table) -> pa.Table:
        c = codec(ranks_path, pattern)
        rows = sorted(table.to_pylist(), key=lambda r: r["start"])
        copies = sum(r["start"] == 0 for r in rows)
        parts = stitched_pieces([r for i, r in enumerate(rows) if i == 0 or r["start"] != rows[i - 1]["start"]], c)
        ids = np.frombuffer(b"".join(map(c.packed, parts)), np.int32)
        return pa.table([pa.array([rows[0]["doc_id"]] * copies, table.schema.field("doc_id").type), *columns([ids] * copies, c)], out.fieldNames())

    return short.unionByName(chunks.mapInArrow(split_chunks, split).groupBy("doc_id", "text_key").applyInArrow(encode_stitched, out))


def stitched_pieces(rows: list[dict], c: Codec):
    """The pieces of one text, a list for each of its pre-tokenised chunks in order; see the module's docstring."""
    n, begin, parts = len(rows), 0, []
    ends = [np.frombuffer(r["ends"], np.int32) + r["start"] for r in rows]
    for k in range(n):
        stop = len(ends[k])
        if k < n - 1:
            trusted = rows[k]["start"] + len(rows[k]["chunk"]) - GUARD
            mine = ends[k][(ends[k] > rows[k + 1]["start"]) & (ends[k] <= trusted)]
            shared = np.intersect1d(mine, ends[k + 1], assume_unique=True)
            shared = shared[shared > (ends[k][begin - 1] if begin else 0)]
            if not len(shared):
                text = rows[0]["chunk"] + "".join(r["chunk"][p["start"] + len(p["chunk"]) - r["start"] :] for p, r in zip(rows, rows[1:]))
                assert len(text) == rows[0]["n_chars"]
                return [c.pieces(text)]
            stop = int(np.searchsorted(ends[k], shared[0])) + 1
        chunk, edges = rows[k]["chunk"], [0, *(ends[k] - rows[k]["start"]).tolist()]
        parts.append([chunk[edges[i] : edges[i + 1]] for i in range(begin, stop)])
        if k < n - 1:
            begin = int(np.searchsorted(ends[k + 1], shared[0])) + 1
    return parts


def decode_ids(encoded: DataFrame, *, ranks_path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id``, ``ids`` and the decoded raw bytes as ``decoded``; a null ``ids`` decodes to no bytes.

    An id without a token raises: such ids can't come from this vocabulary.
    """
    out = T.StructType([*encoded.select("doc_id", "ids").schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches):
        c = codec(ranks_path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                decoded = [c.decode(ids) if ids else b"" for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, out)


def digests(decoded: DataFrame) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of rows with ``ids`` and ``decoded``."""
    ids = F.coalesce("ids", F.expr("CAST(array() AS ARRAY<INT>)"))
    return decoded.select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256")
    )
