"""Spelling variants: generated edits probe Bloom filters, and positives alone meet the vocabulary.

A filter stands for the vocabulary's words of one length, in blocks of one 64-bit word: a word's hash picks
the block and a few bits of it. Hashes are polynomial, so those of all words with one character deleted or
replaced come from the word's own by a few operations on arrays. Two words of different length are near if
the longer one loses a character, and of two words of equal length one has the larger character where they
differ, so each pair is probed from one side only. What a filter says yes to is joined with the vocabulary
itself, which removes its false positives. A round broadcasts ``filter_bytes`` at most; a vocabulary that
needs more takes more rounds, each over other lengths or other parts of one length's hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, mix64, shuffle_width, stored

RUNS = r"[A-Za-zÀ-ÿ]+"
BITS_PER_WORD, BITS = 24, 5
SEGMENT = 4_096  # 64-bit blocks of a filter that travel as one row
PROBES = 1 << 20  # edits worked out at a time
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def runs(text: Column) -> Column:
    """Maximal runs of letters, A-Z lowered."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(RUNS), F.lit(0))


def vocabulary(words: DataFrame, *, length: int, least: int) -> DataFrame:
    """``word, n`` of the words (column ``word``) of so many code points and occurrences."""
    return words.filter(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def powers(length: int) -> np.ndarray:
    out = np.ones(length, np.uint64)
    out[1:] = BASE
    return np.multiply.accumulate(out)


def spelt(words: list[str], length: int) -> np.ndarray:
    """The code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), length).astype(np.uint64)


def bits(x: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash and the bits it sets there."""
    x = mix64(x)
    where = ((x >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    mask = np.zeros(len(x), np.uint64)
    for i in range(BITS):
        mask |= np.uint64(1) << (x >> np.uint64(6 * i) & np.uint64(63))
    return where.astype(np.int64), mask


def part_of(x: np.ndarray, parts: int) -> np.ndarray:
    """The part of a length's filter that a hash belongs to."""
    return (mix64(x ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(parts)).astype(np.int64)


def by_length(batch: pa.RecordBatch):
    """(length, rows, code points) for each length of the words in a batch."""
    words = batch.column("word").to_pylist()
    sizes = np.array([len(w) for w in words], int)
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield int(n), at, spelt([words[i] for i in at], int(n))


def filter_rounds(sizes: list[tuple[int, int]], filter_bytes: int) -> list[dict[tuple[int, int, int], int]]:
    """Filters by round: (length, part, parts) -> blocks; the sizes of a round sum to ``filter_bytes`` at most."""
    most, out, used = max(1, filter_bytes // 8), [{}], 0
    for length, n in sizes:
        parts = -(-n * BITS_PER_WORD // (64 * most))
        blocks = max(1, -(-n * BITS_PER_WORD // (64 * parts)))
        for p in range(parts):
            if used and used + blocks > most:
                out, used = [*out, {}], 0
            out[-1][length, p, parts] = blocks
            used += blocks
    return out


def filters(words: DataFrame, wanted: dict[tuple[int, int, int], int]) -> dict[tuple[int, int, int], np.ndarray]:
    """The filters of one round; executors build their segments, the driver puts these together."""
    names = list(wanted)

    def marks(batches):
        for b in batches:
            for length, _, codes in by_length(b):
                x = (codes * powers(length)).sum(1, dtype=np.uint64)
                for i, (n, p, parts) in enumerate(names):
                    if n == length:
                        where, mask = bits(x[part_of(x, parts) == p], wanted[n, p, parts])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(where), i, np.int32)), pa.array((where // SEGMENT).astype(np.int32)), pa.array((where % SEGMENT).astype(np.int32)), pa.array(mask.view(np.int64))], ["f", "segment", "at", "mask"])

    def segment(key: tuple, t: pa.Table) -> pa.Table:
        out = np.zeros(SEGMENT, np.uint64)
        np.bitwise_or.at(out, np.asarray(t.column("at")), np.asarray(t.column("mask")).view(np.uint64))
        return pa.table({"f": pa.array([key[0].as_py()], pa.int32()), "segment": pa.array([key[1].as_py()], pa.int32()), "data": pa.array([out.tobytes()], pa.binary())})

    marked = words.select("word").mapInArrow(marks, "f int, segment int, at int, mask long").groupBy("f", "segment", "at").agg(F.bit_or("mask").alias("mask"))
    made = {k: np.zeros(-(-n // SEGMENT) * SEGMENT, np.uint64) for k, n in wanted.items()}
    rows = marked.groupBy("f", "segment").applyInArrow(segment, "f int, segment int, data binary").toArrow()
    for f, n, data in zip(*(rows.column(c).to_pylist() for c in ("f", "segment", "data"))):
        made[names[f]][n * SEGMENT : (n + 1) * SEGMENT] = np.frombuffer(data, np.uint64)
    return made


def probed(words: DataFrame, shared: Broadcast, alphabet: list[int]) -> DataFrame:
    """``edit, word, n``: the generated edits that the filters (and their blocks) in ``shared`` say may be words."""
    letters = np.array(alphabet, np.uint64)

    def hits(x: np.ndarray, length: int) -> np.ndarray:
        data, sizes = shared.value
        out = np.zeros(len(x), bool)
        for (n, p, parts), many in sizes.items():
            if n == length:
                own = np.flatnonzero(part_of(x, parts) == p) if parts > 1 else slice(None)
                where, mask = bits(x[own], many)
                out[own] = data[n, p, parts][where] & mask == mask
        return out

    def edits(codes: np.ndarray):
        """(row, place, character or 0 for none) of the positives among one matrix of words."""
        m, length = codes.shape
        weight = powers(length)
        terms = codes * weight
        x = terms.sum(1, dtype=np.uint64)
        before = np.cumsum(terms, axis=1, dtype=np.uint64)
        lost = before - terms + (x[:, None] - before) * INVERSE
        # Of a run of equal characters any one may go: the first stands for all.
        row, place = np.nonzero(np.concatenate([np.ones((m, 1), bool), codes[:, 1:] != codes[:, :-1]], axis=1))
        hit = hits(lost[row, place], length - 1)
        yield row[hit], place[hit], np.zeros(hit.sum(), np.uint32)
        for i in range(length):
            row, which = np.nonzero(letters[None, :] > codes[:, i, None])
            new = x[row] + (letters[which] - codes[row, i]) * weight[i]
            hit = hits(new, length)
            yield row[hit], np.full(hit.sum(), i), letters[which[hit]].astype(np.uint32)

    def run(batches):
        for b in batches:
            for length, at, codes in by_length(b):
                step = max(1, PROBES // max(len(letters), length))
                for lo in range(0, len(at), step):
                    rows = at[lo : lo + step]
                    names = b.column("word").take(pa.array(rows)).to_pylist()
                    n = np.asarray(b.column("n"))[rows]
                    for row, place, c in edits(codes[lo : lo + step]):
                        made_ = [names[r][:p] + (chr(k) if k else "") + names[r][p + 1 :] for r, p, k in zip(row, place, c)]
                        yield pa.RecordBatch.from_arrays([pa.array(made_, pa.string()), pa.array([names[r] for r in row], pa.string()), pa.array(n[row], pa.int64())], ["edit", "word", "n"])

    # Probing is work by word, not by byte: the words are dealt out evenly, however small the table is.
    return words.select("word", "n").repartition(shuffle_width(words.sparkSession)).mapInArrow(run, "edit string, word string, n long")


def spelling_variants(words: DataFrame, *, length: int = 6, least: int = 5, factor: int = 5, filter_bytes: int = 32 << 20) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for the words of at least ``length`` code points and ``least`` occurrences.

    ``words`` has a row per occurrence (column ``word``; null ones don't count, other columns are not looked at). Words are
    near if they differ by exactly one inserted, deleted or replaced code point. A word's form is its near word
    with most occurrences, the smallest in code-point order among equals, if it has ``factor`` times the word's or more. The
    root follows forms to their end; a word without a form is its own root. No words give no rows. Words of any length
    are handled; the characters that may replace others are all those of the vocabulary, a bounded list.
    """
    known = stored(vocabulary(words, length=length, least=least), "words")
    sizes = sorted(tuple(r) for r in known.groupBy(F.length("word")).count().collect())
    characters = known.select(F.explode(F.regexp_extract_all("word", F.lit("(?s)."), F.lit(0))).alias("c")).distinct()
    alphabet = sorted(ord(r.c) for r in characters.collect())
    exact = known.select(F.col("word").alias("edit"), F.col("n").alias("other_n"))
    pairs = exact.select(F.col("edit").alias("word"), F.col("other_n").alias("n"), F.col("edit").alias("other"), "other_n").limit(0)
    for wanted in filter_rounds(sizes, filter_bytes) if sizes else []:
        shared = words.sparkSession.sparkContext.broadcast((filters(known, wanted), wanted))
        found = probed(known, shared, alphabet).join(exact, "edit").select("word", "n", F.col("edit").alias("other"), "other_n")
        pairs = pairs.unionByName(stored(found, "pairs"))
        shared.unpersist()
    both = F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    near = pairs.select(F.explode(both).alias("p")).select("p.*")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    is_form = -F.col("best.less") >= factor * F.col("n")
    formed = known.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    formed = stored(formed, "formed")
    return formed.join(roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(formed: DataFrame) -> DataFrame:
    """``word, root`` of the words that have a form. Counts grow along forms, so that there is no circle; steps double by round."""
    steps = stored(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("to"))
        new = stored(steps.join(further, "root", "left").select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")), "roots")
        if not new.filter("moved").limit(1).count():
            return new.select("word", "root")
        steps = new.select("word", "root")
