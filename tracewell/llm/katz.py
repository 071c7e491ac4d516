"""Language-model scoring with a Katz back-off model of order three.

Counts of single words, pairs and triples are discounted by Good-Turing at each order. A context's
left-over probability goes to its unseen successors in proportion to the next lower order, with weights
that make the probabilities of every context sum to one; a context that training lacks backs off with
weight one. All words that training lacks share one slot, which holds what the discounts of single words
leave. Every text is preceded by two end tokens.

Documents are never joined to the model one token at a time, and no part of the model is dropped. Texts are
read in blocks. First each block sends its distinct words to the words' buckets and gets their numbers and
counts back. Then it sends its distinct triples, with the documents they stand in, to the bucket of their
middle word: there all pairs and triples with that middle word meet, so that counts and all that back-off
weights are made of are at hand for both orders. What needs no factor of the whole corpus is summed per
document there; triples that training lacks are kept with the sums of their contexts, in a partitioned
table, until the factors are known, and then evaluated from order three down.

Middle words with more than a bucket's share of the tokens, by a bounded sample, are dealt by their first
word too, and contexts that large also by the last word. Counts of a large word's pairs come with the
words' counts; sums of large words and contexts (fewer than buckets) meet on the driver. The sample decides
only who works on what: results don't depend on it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, blocks, hash64, mix64, shuffle_width, space_tokens, stored, stored_by, words
from .packing import ROW, combined, grouped, own_bucket, pack, row_table, runs, table_rows, task_number, unpack

END = b" end"  # no word holds a blank
CUTOFF = 7  # counts above it are not discounted
CLASSES = CUTOFF + 1  # counts from 1 to CUTOFF, and all higher ones
BLOCK_BYTES = 4_000_000
BUCKET_BYTES = 8_000_000
SAMPLE_BYTES = 8_000_000
FIXED = 1 << 24  # a bucket's sums of logarithms travel as multiples of 1 / FIXED: half the bytes, errors below 1e-7
OWN, COUNTS, STATS, LARGE_PAIRS, NGRAMS, LOWER, LARGE_CONTEXTS, CLOSED, OPEN = range(1, 10)


def discounts(n: list[float]) -> np.ndarray:
    """Factors for counts from 1 to ``CUTOFF`` (and 1 for more, last) from n[r], the number of n-grams seen r times.

    Where Good-Turing gives no factor between 0 and 1, as on small tables, half a count is taken off.
    """
    d = np.ones(CLASSES + 1)
    common = CLASSES * n[CLASSES] / n[1] if n[1] else 1.0
    for r in range(1, CLASSES):
        value = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        d[r] = value if 0 < value < 1 else (r - 0.5) / r
    return d


def _class(count: np.ndarray) -> np.ndarray:
    return np.minimum(count, CLASSES)


def _seen(count: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Per group: how many n-grams have each count up to ``CUTOFF``, and the sum of all higher counts."""
    weight = np.where(count > CUTOFF, count, 1.0)
    return np.bincount((_class(count) - 1)[count > 0] * n + group[count > 0], weight[count > 0], CLASSES * n).reshape(CLASSES, n)


def _sums(seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts' counts from :func:`_seen`, and the same with one more where no discount leaves anything."""
    counts = np.append(np.arange(1, CLASSES), 1.0) @ seen
    return counts, counts + (seen[:CUTOFF].sum(0) == 0) * (counts > 0)


def _left(seen: np.ndarray, totals: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The probability that discounted counts leave."""
    kept = np.append(factors[1:CLASSES] * np.arange(1, CLASSES), 1.0)
    return 1 - kept @ seen / np.maximum(totals, 1)


class Unigrams:
    """Discounted probabilities of words by their counts; a count of 0 is the slot of all unseen words."""

    def __init__(self, tokens: float, n: list[float]):
        self.factors = discounts(n)
        seen = np.array([[*n[1:CLASSES], tokens - sum(r * n[r] for r in range(1, CLASSES))]]).T
        self.total = max(float(_sums(seen)[1][0]), 1.0)
        self.unseen = float(_left(seen, np.array([self.total]), self.factors)[0])

    def __call__(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.factors[_class(count)] * count / self.total, self.unseen)


def _contexts(seq: np.ndarray, n_tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last and the last but one token before each token; a block's last token is an end token."""
    starts = np.cumsum(n_tokens) - n_tokens
    one = np.roll(seq, 1)
    one[starts] = seq[-1]
    two = np.roll(one, 1)
    two[starts] = seq[-1]
    return one, two


def _large_pairs(seq: np.ndarray, one: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the distinct pairs with a large first word, by second word, and which tokens have one."""
    some = np.flatnonzero(large[one])
    return seq[some].astype(np.uint64) << np.uint64(16) | large[one[some]].astype(np.uint64), some


def _words_of_block(block: int, part: pa.RecordBatch, texts: list[list[bytes]], buckets: int, large_words: np.ndarray, large_contexts: list[tuple[int, int]]) -> pa.Table:
    """A block's row of its own, with its documents and its tokens as indices of its distinct words, in the order
    of their buckets and hashes; and its words, and pairs with a large first word, per bucket of the (last) word."""
    sizes = np.array([len(t) for t in texts])
    h = hash64([w for t in texts for w in t])
    distinct, _, seq = grouped(h)
    order = np.argsort(mix64(distinct) % np.uint64(buckets), kind="stable")
    place = np.empty(len(distinct), np.int64)
    place[order] = np.arange(len(distinct))
    keys, seq = distinct[order], place[seq]
    trained = np.repeat(part.column("trained").to_numpy(zero_copy_only=False).astype(np.uint8), sizes)
    counts = np.bincount(seq, trained, len(keys)).astype(np.uint32)
    large = np.zeros(len(keys), np.uint16)
    where = np.full(len(large_words), -1)
    for i, w in enumerate(large_words):
        at = np.searchsorted(distinct, w)
        if at < len(distinct) and distinct[at] == w:
            where[i] = place[at]
            large[where[i]] = i + 1
    at_hash = dict(zip(large_words.tolist(), where.tolist()))

    def local(word: int) -> int:
        if word not in at_hash:
            at = int(np.searchsorted(distinct, np.uint64(word)))
            at_hash[word] = int(place[at]) if at < len(distinct) and int(distinct[at]) == word else -1
        return at_hash[word]

    found = [(local(a), local(b), i + 1) for i, (a, b) in enumerate(large_contexts)]
    found = np.array([x for x in found if x[0] >= 0 and x[1] >= 0], np.int64).reshape(-1, 3)
    pairs, some = _large_pairs(seq, _contexts(seq, sizes)[0], large)
    pairs, nth = np.unique(pairs, return_inverse=True)
    pair_counts = np.bincount(nth, trained[some], len(pairs)).astype(np.uint32)
    docs = pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("trained"), pa.array(sizes, pa.int64())], ["doc_id", "trained", "n_tokens"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema) as writer:
        writer.write_batch(docs)
    rows = [(OWN, own_bucket(block), block, len(sizes), [sink.getvalue().to_pybytes(), pack(seq.astype(np.uint32)), pack(large), pack(found.reshape(-1))])]
    ends = np.cumsum(np.bincount((pairs >> np.uint64(16)).astype(np.int64), minlength=len(keys)))
    for b, i, j in runs((mix64(keys) % np.uint64(buckets)).astype(np.int64), buckets):
        k, m = (ends[i - 1] if i else 0), ends[j - 1]
        word = ((pairs[k:m] >> np.uint64(16)) - np.uint64(i)).astype(np.uint32)
        rows.append((NGRAMS, b, block, len(sizes), [pack(keys[i:j], True), pack(counts[i:j]), pack(word, True), pack((pairs[k:m] & np.uint64(0xFFFF)).astype(np.uint16)), pack(pair_counts[k:m])]))
    return row_table(rows)


def _count_words(table: pa.Table, n_large: int) -> pa.Table:
    """Counts of a bucket's words and of their pairs after large words, back to each block; training words are
    numbered from the most frequent on, from 1. One block a pair is told to report it further."""
    rows = table_rows(table)
    bucket = rows[0][1]
    if bucket < 0:
        return table
    parts = [[unpack(x, t, d) for x, t, d in zip(r[4], (np.uint64, np.uint32, np.uint32, np.uint16, np.uint32), (True, False, True, False, False))] for r in rows]
    distinct, _, word = grouped(np.concatenate([p[0] for p in parts]))
    total = np.bincount(word, np.concatenate([p[1] for p in parts]), len(distinct)).astype(np.int64)
    number = np.empty(len(total), np.uint32)
    number[np.argsort(-total, kind="stable")] = np.arange(1, len(total) + 1)
    number[total == 0] = 0
    starts = np.cumsum([0, *(len(p[0]) for p in parts)])
    pair = np.concatenate([word[s + p[2]] for s, p in zip(starts, parts)]).astype(np.uint64) << np.uint64(16) | np.concatenate([p[3] for p in parts]).astype(np.uint64)
    pairs, first, nth = grouped(pair)
    pair_total = np.bincount(nth, np.concatenate([p[4] for p in parts]), len(pairs)).astype(np.int64)
    report = np.zeros(len(pair), np.uint8)
    report[first] = pair_total > 0
    out = [(STATS, bucket, 0, 0, [pack(np.array([total.sum(), (total > 0).sum(), *((total == r).sum() for r in range(1, CLASSES + 1)), *((pair_total == r).sum() for r in range(1, CLASSES + 1))], np.float64))])]
    if n_large:
        out.append((LARGE_PAIRS, bucket, 0, 0, [pack(_seen(pair_total, (pairs & np.uint64(0xFFFF)).astype(np.int64), n_large + 1).reshape(-1))]))
    at = 0
    for r, p, s in zip(rows, parts, starts):
        mine, k = word[s : s + len(p[0])], slice(at, at + len(p[2]))
        at = k.stop
        out.append((COUNTS, bucket, r[2], r[3], [pack(number[mine]), pack(total[mine].astype(np.uint32)), pack(pair_total[nth[k]].astype(np.uint32)), pack(report[k])]))
    return row_table(out)


def _ngrams_of_block(table: pa.Table, unigrams: Unigrams, n_large: int, buckets: int) -> pa.Table:
    """The distinct triples of one block whose middle word is known, dealt to buckets, and a row of its own with
    the block's documents and what single words add to them."""
    rows = table_rows(table)
    _, bucket, block, n_docs, own = next(r for r in rows if r[0] == OWN)
    seq, large, found = unpack(own[1], np.uint32).astype(np.int64), unpack(own[2], np.uint16), unpack(own[3], np.int64).reshape(-1, 3)
    docs = pa.ipc.open_stream(own[0]).read_all()
    n_tokens, trained = docs.column("n_tokens").to_numpy(), docs.column("trained").to_numpy(zero_copy_only=False).astype(np.uint8)
    parts = sorted((r for r in rows if r[0] == COUNTS), key=lambda r: r[1])
    known = np.concatenate([unpack(r[4][1], np.uint32) for r in parts])
    pair_totals, report = (np.concatenate([unpack(r[4][i], t) for r in parts]) for i, t in ((2, np.uint32), (3, np.uint8)))
    # A word's id is its number in its bucket and the bucket; 0 stands for all words that training lacks.
    ids = np.concatenate([np.where(x > 0, (x - np.uint64(1)) * np.uint64(buckets) + np.uint64(r[1] + 1), np.uint64(0)) for r in parts for x in [unpack(r[4][0], np.uint32).astype(np.uint64)]])
    if ids.max() >> np.uint64(32):
        raise OverflowError("more words than 32 bits number")
    owner = np.repeat(np.arange(n_docs), n_tokens)
    count = known[seq]
    one, two = _contexts(seq, n_tokens)
    lone = ids[one] == 0  # its context is unknown: just the word's own probability
    by_doc = lambda x: pack(np.bincount(owner, x, n_docs))
    out = [(OWN, bucket, block, n_docs, [own[0], by_doc(np.log10(count + 1.0)), by_doc(count == 0), by_doc(np.where(lone, np.log10(unigrams(count)), 0.0))])]
    pairs = np.unique(_large_pairs(seq, one, large)[0])
    if n_large:
        mine = pairs[report > 0]
        share = unigrams(known[(mine >> np.uint64(16)).astype(np.int64)])
        out.append((LOWER, bucket, block, n_docs, [pack(np.bincount((mine & np.uint64(0xFFFF)).astype(np.int64), share, n_large + 1))]))
    seq, one, two, owner = (x[~lone] for x in (seq, one, two, owner))
    _, first, nth = grouped(combined(one, two, seq))
    entries, times = np.unique(nth.astype(np.int64) * n_docs + owner, return_counts=True)
    which, doc = entries // n_docs, entries % n_docs
    learnt, sizes = np.bincount(which, times * trained[doc], len(first)), np.bincount(which, minlength=len(first))
    seq, one, two = seq[first], one[first], two[first]
    of_large, of_context = large[one], np.zeros(len(first), np.uint16)
    for a, b, i in found:
        of_context[(two == a) & (one == b)] = i
    pair_count = np.zeros(len(first), np.uint32)
    some = of_large > 0
    pair_count[some] = pair_totals[np.searchsorted(pairs, seq[some].astype(np.uint64) << np.uint64(16) | of_large[some].astype(np.uint64))]
    w1, w2, w3 = ids[two], ids[one], ids[seq]
    deal = np.where(of_context > 0, mix64(w3), np.where(some, mix64(w2 << np.uint64(32) | w1), w2 - np.uint64(1))) % np.uint64(buckets)
    deal = deal.astype(np.int64)
    # By bucket and middle word; a triple's documents follow in the same order.
    order = np.argsort(combined(deal, w2), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    spots = np.argsort(rank[which], kind="stable")
    columns = [x[order].astype(t) for x, t in ((w1, np.uint32), (w2, np.uint32), (w3, np.uint32), (known[seq], np.uint32), (of_large, np.uint16), (of_context, np.uint16), (pair_count, np.uint32), (learnt, np.uint32), (sizes, np.uint32))]
    docs_of, times_of = doc[spots].astype(np.uint32), times[spots].astype(np.uint32)
    for (b, i, j), (_, k, m) in zip(runs(deal, buckets), runs(deal[which], buckets)):
        out.append((NGRAMS, b, block, n_docs, [*(pack(x[i:j], at == 1) for at, x in enumerate(columns)), pack(docs_of[k:m]), pack(times_of[k:m])]))
    return row_table(out)


def _count_ngrams(table: pa.Table, unigrams: Unigrams, large_seen: np.ndarray, n_contexts: int) -> pa.Table:
    """Counts a bucket's pairs and triples; per block the sums of seen triples (``CLOSED``), and the other triples
    with all that their contexts' weights are made of (``OPEN``)."""
    rows = table_rows(table)
    bucket = rows[0][1]
    if bucket < 0:
        return table
    kinds = (np.uint32, np.uint32, np.uint32, np.uint32, np.uint16, np.uint16, np.uint32, np.uint32)
    column = lambda i: np.concatenate([unpack(r[4][i], kinds[i], i == 1) for r in rows])
    shift = np.uint64(32)
    w2, w3 = column(1), column(2)
    high = w2.astype(np.uint64) << shift
    word_count, of_large, of_context, learnt = column(3), column(4), column(5), column(7)
    # Pairs, and their middle words.
    pairs, first, pair = grouped(high | w3)
    large = of_large[first].astype(np.int64)
    r = np.bincount(pair, learnt, len(pairs)).astype(np.int64)
    if large.any():
        r = np.where(large > 0, column(6)[first], r)
    begin = np.flatnonzero(np.diff(pairs >> shift, prepend=np.uint64(0)))  # middle words are known: not 0
    middle = np.repeat(np.arange(len(begin), dtype=np.uint32), np.diff(begin, append=len(pairs)))
    large_middle = large[begin]
    seen2 = _seen(r, middle, len(begin))
    if large.any():
        seen2 = np.where(large_middle > 0, large_seen[:, large_middle], seen2)
    total2 = _sums(seen2)[1]
    lower2 = np.bincount(middle, (r > 0) * unigrams(word_count[first]), len(begin))
    relative = r / np.maximum(total2, 1)[middle]
    # Triples, and their contexts.
    high |= column(0)
    contexts, _, context = grouped(high)
    del high, w2
    triples, first, nth = grouped(context.astype(np.uint64) << shift | w3)
    del w3
    total = np.bincount(nth, learnt, len(triples)).astype(np.int64)
    del learnt
    of_triple = (triples >> shift).astype(np.int64)
    del triples
    n_of = len(contexts)
    del contexts
    seen3 = _seen(total, of_triple, n_of)
    total3 = _sums(seen3)[1]
    # By the class of the pair's count: what the seen triples' words have at order two, before the factors.
    some = np.flatnonzero(total)
    back = pair[first[some]]
    lower3 = np.bincount((_class(r[back]) - 1) * n_of + of_triple[some], relative[back], CLASSES * n_of).reshape(CLASSES, -1)
    del back, some, first, of_triple, relative
    light = r[large == 0]
    out = [(STATS, bucket, 0, 0, [pack(np.array([(x == k).sum() for x in (light, total) for k in range(1, CLASSES + 1)], np.float64))])]
    hot = np.zeros(n_of, np.int64)
    if of_context.any():
        hot[context] = of_context
        at = np.flatnonzero(hot)
        sums = np.zeros((2 * CLASSES, n_contexts + 1))
        sums[:, hot[at]] = np.concatenate([seen3, lower3])[:, at]
        out.append((LARGE_CONTEXTS, bucket, 0, 0, [pack(sums.reshape(-1))]))
    start = 0
    for _, _, block, n_docs, parts in rows:
        sizes, doc, times = (unpack(x, np.uint32) for x in parts[8:])
        mine = slice(start, start + len(sizes))
        start = mine.stop
        t, c, p = total[nth[mine]], context[mine], pair[mine]
        closed = (t > 0) & (of_context[mine] == 0)
        inside = np.repeat(closed, sizes)
        if inside.any():
            value, k = np.log10(np.maximum(t, 1) / np.maximum(total3[c], 1)), _class(t) - 1
            d, n = doc[inside].astype(np.int64), times[inside]
            docs = np.flatnonzero(np.bincount(d, minlength=n_docs))
            values = np.bincount(d, np.repeat(value, sizes)[inside] * n, n_docs)[docs]
            classes = np.bincount(np.repeat(k, sizes)[inside] * n_docs + d, n, CLASSES * n_docs).reshape(CLASSES, -1)[:, docs]
            out.append((CLOSED, bucket, block, n_docs, [pack(docs.astype(np.uint32), True), pack(np.rint(values * FIXED).astype(np.int64)), pack(classes.reshape(-1).astype(np.uint32))]))
        left = np.flatnonzero(~closed)
        if len(left):
            cs, c = np.unique(c[left], return_inverse=True)
            ms, m = np.unique(middle[p[left]], return_inverse=True)
            doubles = (seen2[:, ms].reshape(-1), lower2[ms], seen3[:, cs].reshape(-1), lower3[:, cs].reshape(-1))
            longs = (t[left], r[p[left]], word_count[mine][left], c, m, large_middle[ms], hot[cs], sizes[left], doc[~inside], times[~inside])
            out.append((OPEN, bucket, block, n_docs, [*map(pack, doubles), *(pack(x.astype(np.uint32)) for x in longs)]))
    return row_table(out)


def open_values(parts: list[bytes], unigrams: Unigrams, factors2: np.ndarray, factors3: np.ndarray, large: tuple, contexts: tuple) -> tuple[np.ndarray, ...]:
    """log10 probabilities of an ``OPEN`` row's triples, from order three down, and their sizes, documents and times."""
    seen2, lower2, seen3, lower3 = (unpack(x, np.float64) for x in parts[:4])
    t, r, word_count, c, m, large_middle, hot, sizes, doc, times = (unpack(x, np.uint32).astype(np.int64) for x in parts[4:])
    seen2, seen3, lower3 = seen2.reshape(CLASSES, -1), seen3.reshape(CLASSES, -1), lower3.reshape(CLASSES, -1)
    lower2 = np.where(large_middle > 0, large[1][large_middle], lower2)
    seen3, lower3 = (np.where(hot > 0, whole[:, hot], x) for whole, x in zip(contexts, (seen3, lower3)))
    total2, total3 = _sums(seen2)[1], _sums(seen3)[1]
    with np.errstate(divide="ignore"):
        back2 = np.log10(np.where(total2 > 0, _left(seen2, total2, factors2) / (1 - lower2), 1.0))
        value2 = np.where(r > 0, np.log10(factors2[_class(r)] * r / np.maximum(total2, 1)[m]), back2[m] + np.log10(unigrams(word_count)))
        back3 = np.log10(np.where(total3 > 0, _left(seen3, total3, factors3) / (1 - factors2[1:] @ lower3), 1.0))
        return np.where(t > 0, np.log10(factors3[_class(t)] * t / np.maximum(total3, 1)[c]), back3[c] + value2), sizes, doc, times


def _totals(rows: DataFrame, kind: int, length: int) -> np.ndarray:
    """The sum of all vectors of a kind; ``length`` numbers reach the driver at most."""

    def add(batches):
        total = np.zeros(length)
        for b in batches:
            for parts in b.column("parts").to_pylist():
                total += unpack(parts[0], np.float64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["i", "v"])

    out = np.zeros(length)
    for r in rows.filter(F.col("kind") == kind).select("parts").mapInArrow(add, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


def large_keys(src: DataFrame, volume: int, share: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Hashes of the words, and of the pairs of words, that have more than ``share`` of the tokens of a sample of
    at most about ``SAMPLE_BYTES``; fewer than 1 / share of each reach the driver."""
    part = src.sample(SAMPLE_BYTES / volume, 7) if volume > SAMPLE_BYTES else src
    end = F.array(F.lit(END.decode()))
    tokens = F.concat(words(ascii_lower(F.col("text"))), end)
    zipped = F.arrays_zip(F.slice(F.concat(end, tokens), 1, F.size(tokens)).alias("a"), tokens.alias("b"))
    pairs = stored(part.select(F.explode(zipped).alias("x")).groupBy("x.a", "x.b").agg(F.count("*").alias("n")), "sample")
    least = (pairs.agg(F.sum("n").alias("n")).first()["n"] or 0) * share
    frequent = pairs.groupBy("b").agg(F.sum("n").alias("n")).filter(F.col("n") > least).select("b").collect()
    contexts = pairs.filter(F.col("n") > least).select("a", "b").collect()
    known = np.unique(hash64([r["b"].encode() for r in frequent]))[:60_000]
    a, b = (hash64([r[c].encode() for r in contexts]).tolist() for c in "ab")
    return known, sorted(x for x in zip(a, b) if x[1] in set(known.tolist()))[:60_000]


def katz_scores(docs: DataFrame, *, training: Column, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """``doc_id, trained, n_tokens, n_known, train_tokens, base_score, score`` per input row.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered, then one end token. Null text is empty: just the end
    token. Repeated rows count as often as they are there and get equal results; an empty table gives no
    rows; without any training row every word is unseen. ``training`` that is null counts as false. Other
    columns are ignored. A text, however long, is one block's at most; equal counts are numbered in the order
    of hashes, which no result shows. ``buckets`` overrides their number, which grows with the input.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(training, F.lit(False)).alias("trained"))
    volume = src.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = buckets or max(shuffle_width(spark), int(volume // BUCKET_BYTES) + 1)
    large_words, large_contexts = large_keys(src, volume, 1 / buckets)
    n_large, n_contexts = len(large_words), len(large_contexts)

    def read_words(batches):
        nth = 0
        for b in batches:
            lengths = pc.fill_null(pc.binary_length(b.column("text")), 0).to_pylist()
            for lo, hi in blocks(lengths, BLOCK_BYTES):
                part = b.slice(lo, hi - lo)
                texts = [space_tokens(t) + [END] for t in part.column("text").to_pylist()]
                yield from _words_of_block(task_number() << 32 | nth, part, texts, buckets, large_words, large_contexts).to_batches()
                nth += 1

    counted = src.mapInArrow(read_words, ROW).groupBy("bucket").applyInArrow(lambda t: _count_words(t, n_large), ROW)
    counted = stored_by(counted, "katz1", "block", ("kind",))
    tokens, types, *n = _totals(counted, STATS, 2 + 2 * CLASSES)
    unigrams = Unigrams(tokens, [0, *n[:CLASSES]])
    large_seen = _totals(counted, LARGE_PAIRS, CLASSES * (n_large + 1)).reshape(CLASSES, -1)
    sent = counted.filter(F.col("kind").isin(OWN, COUNTS)).groupBy("block").applyInArrow(lambda t: _ngrams_of_block(t, unigrams, n_large, buckets), ROW)
    scored = stored(sent.groupBy("bucket").applyInArrow(lambda t: _count_ngrams(t, unigrams, large_seen, n_contexts), ROW), "katz2", ("kind",))
    stats = _totals(scored, STATS, 2 * CLASSES)
    factors2, factors3 = discounts([0, *(stats[:CLASSES] + np.array(n[CLASSES:]))]), discounts([0, *stats[CLASSES:]])
    large = large_seen, _totals(scored, LOWER, n_large + 1)
    contexts = np.split(_totals(scored, LARGE_CONTEXTS, 2 * CLASSES * (n_contexts + 1)).reshape(2 * CLASSES, -1), 2)
    out = T.StructType([*(src.schema[c] for c in ("doc_id", "trained")), *(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")), *(T.StructField(n, T.DoubleType()) for n in ("base_score", "score"))])

    def scores(table: pa.Table) -> pa.Table:
        rows = table_rows(table)
        own = next(r for r in rows if r[0] == OWN)[4]
        docs = pa.ipc.open_stream(own[0]).read_all()
        share, unseen, score = (unpack(x, np.float64) for x in own[1:4])
        size = docs.column("n_tokens").to_numpy()
        for kind, _, _, n_docs, parts in rows:
            if kind == CLOSED:
                doc, classes = unpack(parts[0], np.uint32, True), unpack(parts[2], np.uint32).reshape(CLASSES, -1)
                score[doc] += unpack(parts[1], np.int64) / FIXED + np.log10(factors3[1:]) @ classes
            elif kind == OPEN:
                value, sizes, doc, times = open_values(parts, unigrams, factors2, factors3, large, contexts)
                score += np.bincount(doc, np.repeat(value, sizes) * times, n_docs)
        base = share - size * np.log10(tokens + types + 1)
        longs = (size, (size - unseen).astype(np.int64), np.full(len(size), int(tokens)))
        return pa.table([docs.column("doc_id"), docs.column("trained"), *(pa.array(x, pa.int64()) for x in longs), pa.array(base), pa.array(np.minimum(score, 0.0))], out.fieldNames())

    return scored.filter(F.col("kind").isin(OWN, CLOSED, OPEN)).groupBy("block").applyInArrow(scores, out)
