"""Token counts from distinct pre-tokens.

Texts are read in blocks. Each block sends its distinct pre-tokens, with their frequencies in its documents,
to the pre-tokens' buckets. There every distinct pre-token of the corpus is tokenised once; its count is
joined to the frequencies, and the products are summed per document, first in the bucket and then over
all buckets. No ids are kept. A pre-token found in every document is one entry per block.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, hash64, shuffle_width
from .packing import ROW, own_bucket, pack, row_table, runs, table_rows, task_number, unpack

BLOCK_BYTES = 4_000_000
BUCKET_BYTES = 24_000_000
OWN, FREQUENCIES, SUMS = 1, 2, 3


class PieceCounter:
    """Token counts of pre-tokens by a ``tokenizers`` file whose pre-tokenizer is byte-level."""

    def __init__(self, path: str, pattern: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            special = sorted((t["content"] for t in json.load(f).get("added_tokens", [])), key=len, reverse=True)
        # By default the library takes added tokens out of a text before it splits the rest.
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern = regex.compile(pattern)

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and how many added tokens stood between them."""
        if self.special is None or not self.special.search(text):
            return self.pattern.findall(text), 0
        parts = self.special.split(text)
        return [p for part in parts for p in self.pattern.findall(part)], len(parts) - 1

    def counts(self, pieces: list[str]) -> np.ndarray:
        out = np.empty(len(pieces), np.int64)
        for at in range(0, len(pieces), 4096):
            part = pieces[at : at + 4096]
            out[at : at + len(part)] = [len(e.ids) for e in self.tokenizer.encode_batch(part, add_special_tokens=False)]
        return out


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> PieceCounter:
    return PieceCounter(path, pattern)


def _packed_texts(pieces: list[bytes]) -> list[bytes]:
    return [zstandard.ZstdCompressor(level=1).compress(b"".join(pieces)), pack(np.fromiter(map(len, pieces), np.uint32, len(pieces)))]


def _texts(joined: bytes, sizes: bytes) -> list[bytes]:
    data, ends = zstandard.ZstdDecompressor().decompress(joined), np.cumsum(unpack(sizes, np.uint32), dtype=np.int64).tolist()
    return [data[i:j] for i, j in zip([0, *ends], ends)]


def _frequencies(block: int, part: pa.RecordBatch, c: PieceCounter, buckets: int) -> pa.Table:
    """A block's row of its own (ids, bytes and added tokens of its documents) and its frequencies per bucket."""
    numbers: dict[str, int] = {}
    codes, added = [], []
    for text in part.column("text").to_pylist():
        pieces, extra = c.pieces(text)
        added.append(extra)
        codes.append(np.fromiter((numbers.setdefault(p, len(numbers)) for p in pieces), np.int64, len(pieces)))
    n_docs = part.num_rows
    docs = pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(added, pa.int64())], ["doc_id", "n_bytes", "added"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema) as writer:
        writer.write_batch(docs)
    rows = [(OWN, own_bucket(block), block, n_docs, [sink.getvalue().to_pybytes()])]
    distinct = [p.encode("utf-8", "surrogatepass") for p in numbers]
    del numbers
    bucket = (hash64(distinct) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    owner = np.repeat(np.arange(n_docs), [len(x) for x in codes])
    entries, times = np.unique(place[np.concatenate(codes)] * n_docs + owner, return_counts=True)
    which, doc = entries // n_docs, (entries % n_docs).astype(np.uint32)
    sizes = np.bincount(which, minlength=len(order)).astype(np.uint32)
    ends = np.cumsum(sizes)
    for b, i, j in runs(bucket[order], buckets):
        k, m = (ends[i - 1] if i else 0), ends[j - 1]
        rows.append((FREQUENCIES, b, block, n_docs, [*_packed_texts([distinct[x] for x in order[i:j]]), pack(sizes[i:j]), pack(doc[k:m]), pack(times[k:m].astype(np.uint32))]))
    return row_table(rows)


def _sums(table: pa.Table, c: PieceCounter) -> pa.Table:
    """Tokens of each block's documents in one bucket's pre-tokens, each of which is tokenised once."""
    rows = table_rows(table)
    bucket = rows[0][1]
    if bucket < 0:
        return table
    numbers: dict[bytes, int] = {}
    codes = [np.fromiter((numbers.setdefault(p, len(numbers)) for p in _texts(*r[4][:2])), np.int64) for r in rows]
    counts = c.counts([p.decode("utf-8", "surrogatepass") for p in numbers])
    out = []
    for (_, _, block, n_docs, parts), code in zip(rows, codes):
        sizes, doc, times = (unpack(x, np.uint32) for x in parts[2:])
        tokens = np.bincount(doc, np.repeat(counts[code], sizes) * times, n_docs)
        out.append((SUMS, bucket, block, n_docs, [pack(tokens.astype(np.uint32))]))
    return row_table(out)


def token_counts(
    docs: DataFrame,
    *,
    tokenizer_path: str,
    pattern: str = public_tokenizers.PATTERN,
    limit: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per input row.

    Null and empty texts have 0 bytes and 0 tokens; an empty table gives no rows; repeated rows give repeated
    results; other columns are ignored; there are no ties. A text, however long, is one block's at most.
    ``over_limit`` is ``n_tokens > limit``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    volume = src.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    buckets = max(shuffle_width(docs.sparkSession), int(volume // BUCKET_BYTES) + 1)
    out = T.StructType([src.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def read(batches):
        c, nth = counter(tokenizer_path, pattern), 0
        for b in batches:
            for lo, hi in blocks(pc.binary_length(b.column("text")).to_pylist(), BLOCK_BYTES):
                yield from _frequencies(task_number() << 32 | nth, b.slice(lo, hi - lo), c, buckets).to_batches()
                nth += 1

    def add(table: pa.Table) -> pa.Table:
        rows = table_rows(table)
        docs = pa.ipc.open_stream(next(r[4][0] for r in rows if r[0] == OWN)).read_all()
        tokens = docs.column("added").to_numpy() + sum(unpack(r[4][0], np.uint32).astype(np.int64) for r in rows if r[0] == SUMS)
        return pa.table([docs.column("doc_id"), docs.column("n_bytes"), pa.array(tokens, pa.int64())], out.fieldNames())

    summed = src.mapInArrow(read, ROW).groupBy("bucket").applyInArrow(lambda t: _sums(t, counter(tokenizer_path, pattern)), ROW)
    return summed.groupBy("block").applyInArrow(add, out).withColumn("over_limit", F.col("n_tokens") > limit)
