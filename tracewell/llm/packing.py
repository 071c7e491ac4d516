"""Blocks of postings as rows: how numpy arrays travel between the stages of the corpus-wide operators.

A task reads its documents in blocks of bounded size. For each block and bucket of keys one row goes
out, with the block's distinct keys of that bucket and the documents of each. Combining inside the
block first means that even a key found in every document is one entry per block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

#: What a block (a bounded run of texts in one task) sends to a bucket, or says of itself: packed arrays.
ROW = "kind int, bucket int, block long, n_docs int, parts array<binary>"


def row_table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.binary()))
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, kinds)], ["kind", "bucket", "block", "n_docs", "parts"])


def table_rows(table: pa.Table) -> list[tuple]:
    return list(zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "block", "n_docs", "parts"))))


def task_number() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def own_bucket(block: int) -> int:
    """A bucket below 0 for what a block says of itself; few blocks share one."""
    return -1 - (block ^ block >> 32) * 0x9E3779B1 % 65_536


def runs(part: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of each bucket in the ascending ``part``."""
    ends = np.cumsum(np.bincount(part, minlength=buckets))
    return [(b, ends[b - 1] if b else 0, ends[b]) for b in range(buckets) if ends[b] > (ends[b - 1] if b else 0)]


def pack(a: np.ndarray, delta: bool = False) -> bytes:
    """An array as bytes; ``delta`` suits ascending values. Bytes of equal weight stand together."""
    if delta:
        a = np.diff(a, prepend=a.dtype.type(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() if len(a) else b"")


def unpack(data: bytes, dtype, delta: bool = False) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    a = np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).reshape(-1) if len(raw) else np.empty(0, dtype)
    return np.cumsum(a, dtype=dtype) if delta else a


def combined(*columns: np.ndarray) -> np.ndarray:
    """One 64-bit key per row of ``columns`` (of non-negative integers) that sorts as the rows do."""
    key = columns[0].astype(np.uint64)
    for c in columns[1:]:
        width = int(c.max()).bit_length() if len(c) else 0
        if len(key) and int(key.max()).bit_length() + width > 64:
            key = grouped(key)[2].astype(np.uint64)
        key = key << np.uint64(width) | c.astype(np.uint64)
    return key


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys ascending, one place of each, and which of them stands at every place."""
    order = np.argsort(key).astype(np.uint32 if len(key) < 1 << 32 else np.int64)
    key = key[order]
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    nth = np.empty(len(key), np.uint32)
    nth[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    return key[new], order[new], nth
