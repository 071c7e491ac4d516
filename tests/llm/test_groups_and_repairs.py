"""Conversation repair, embedding groups and spelling variants against their plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import queries, spelling, turns, vectors

SPACE = " \t\n\x0b\x0c\r"


# ---- conversations -------------------------------------------------------------------------------------------


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        fault, role, text = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20, name(role), name(text)
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        out += [(conv, turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def plain_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of one conversation's rows after damage."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        last = text.strip(SPACE)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    known = {r[1] for r in rows if r[1] is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i, state, inserted=0):
        ways = []
        if i == len(rows) and state in ("", "a"):
            ways.append((0, "", ()))
        if inserted < 4:
            for new in "ua":
                if (to := step.get((state, new))) is not None:
                    cost, audit, left = best(i, to, inserted + 1)
                    ways.append((3 + cost, "I" + audit, ({"u": "user:", "a": "assistant:"}[new], *left)))
        if i < len(rows):
            cut = 3 if faults[i] == "truncated" else 0
            cost, audit, left = best(i + 1, state)
            ways.append((4 + cost, "D" + audit, left))
            if faults[i] not in ("blank", "duplicate"):
                role, text = rows[i][2:]
                if (to := step.get((state, role[:1]))) is not None:
                    cost, audit, left = best(i + 1, to)
                    ways.append((cut + cost, "K" + audit, (f"{role}:{text}", *left)))
                for new in "ua":
                    if (to := step.get((state, new))) is not None:
                        cost, audit, left = best(i + 1, to)
                        ways.append((3 + cut + cost, "R" + audit, ({"u": "user:", "a": "assistant:"}[new] + text, *left)))
        return min(ways) if ways else (10**9, "", ())

    for i in range(len(rows), 0, -1):
        best(i, "")
    cost, audit, left = best(0, "")
    digest = hashlib.sha256("\n".join(left).encode()).hexdigest()
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest)


def conversations(seed, many, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(many):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "sudo", "User"])
            text = rng.choice(["Yes.", "No!", "so what", "", " \n", "Why?", "Yes.", "é..", "a b c.\n", None, f"unique {rng.random()}.", f"cut {rng.random()}"])
            rows.append((rng.choice([conv, conv, conv, None]) if conv % 7 == 0 else conv, rng.choice([turn, turn, turn, None, 3]) if conv % 3 == 0 else turn * 2, role, text))
    return rows


@pytest.mark.parametrize("most_rows", [4_096, 3])
def test_conversations_are_repaired_by_the_cheapest_edits(spark, most_rows):
    rows = damaged(conversations(1, 60, 12)) + damaged(conversations(2, 2, 300))
    rows += [(900, None, "user", "Same."), (900, None, "user", "Same."), (901, 5, "system", "Alone."), (902, 1, "user", "long. " * 40_000), (903, 2**62, "user", "Far."), (903, -(2**61), "assistant", "Near.")]
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], schema + ", kind int, key string").repartition(5)
    got = turns.report(turns.repaired(df, most_rows=most_rows)).collect()
    want = {}
    for r in rows:
        want.setdefault(r[0], []).append(r)
    assert {r.conv_id: tuple(r)[1:] for r in got} == {c: plain_repair(v) for c, v in want.items()}
    assert len(got) == len(want)


def test_conversations_in_many_pieces(spark):
    """One conversation over all tasks, its repaired messages in order."""
    rows = [(1, t, random.Random(t).choice(["user", "assistant", "tool"]), f"text {t % 50}" + ".?x"[t % 3]) for t in range(700)] + [(2, 1, "user", "Hm.")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    parts = turns.repaired(df, most_rows=16)
    assert parts.filter("conv_id = 1").count() > 40
    got = {r.conv_id: tuple(r)[1:] for r in turns.report(parts).collect()}
    assert got == {c: plain_repair([r for r in rows if r[0] == c]) for c in (1, 2)}
    cost = {r.conv_id: r.cost for r in parts.groupBy("conv_id").agg(F.sum("cost").alias("cost")).collect()}
    assert cost == {c: got[c][5] for c in got}


@pytest.mark.parametrize("name", ["given", "none", "made"])
def test_conversation_query(spark, sf, tmp_path, name):
    given = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect()]
    folder = sf
    if name != "given":
        rows = conversations(5, 30, 10) if name == "made" else []
        folder = str(tmp_path)
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    got = queries.QUERIES["op11_conversation_repair"](spark, folder).collect()
    want = {}
    for r in damaged(rows):
        want.setdefault(r[0], []).append(r)
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    expected = {c: plain_repair(want[c]) if c in want else none for c in {r[0] for r in rows}}
    assert {r[0]: tuple(r)[1:] for r in got} == expected and len(got) == len(expected)


def test_block_tables_agree_with_single_steps():
    t, rng = turns.tables(), random.Random(3)
    for n in range(40):
        symbols = bytes(rng.randrange(turns.SYMBOLS) for _ in range(n))
        costs = turns.END
        for s in symbols[::-1]:
            costs = turns.before(s, costs)
        _, front, taken = t.backward(symbols, t.end)
        assert tuple(c + taken for c in t.vectors[front]) == costs
        audit, state = t.forward(symbols, t.end, turns.START)
        assert turns.cost_of(audit + turns.closing(state), symbols) == costs[turns.START]


# ---- embeddings ----------------------------------------------------------------------------------------------


def plain_links(rows, least):
    """(id, links, component, kept) of each row."""
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    good = [i for i, (_, v) in enumerate(rows) if ok(v)]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = [0] * len(rows)
    for dim in {len(rows[i][1]) for i in good}:
        at = [i for i in good if len(rows[i][1]) == dim]
        x = np.array([rows[i][1] for i in at], np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        size = np.sqrt((x * x).sum(1))
        hit = (x @ x.T) / (size[:, None] * size[None, :]) >= least
        for a, b in zip(*np.nonzero(hit)):
            if a != b:
                links[at[a]] += 1
                parent[find(at[a])] = find(at[b])
    ids = {}
    for i, (v, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(v)
    out = []
    for i, (v, _) in enumerate(rows):
        known = [x for x in ids[find(i)] if x is not None]
        c = min(known) if known else None
        out.append((v, links[i], c, v is not None and v == c))
    return sorted(out, key=str)


def embedded(seed):
    """Groups at all distances around the limit, chains, copies, a dense group, and rows that link with nothing."""
    rng = np.random.default_rng(seed)
    rows = []
    for dim, many in ((8, 300), (24, 400)):
        x = rng.normal(size=(many, dim))
        rows += [list(map(float, v)) for v in x.astype(np.float32)]
        for v in x[:60]:
            for noise in (0.05, 0.2, 0.3, 0.35):
                y = v / np.linalg.norm(v)
                z = rng.normal(size=dim)
                rows.append(list(map(float, ((y + noise * z / np.linalg.norm(z)) * rng.uniform(0.1, 9)).astype(np.float32))))
        rows += [rows[-1]] * 30
        rows += [list(map(float, (x[0] + 0.02 * rng.normal(size=dim)).astype(np.float32))) for _ in range(150)]
    rows += [None, [], [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [1.0], [2.0], [-1.0], [1e30] * 8, [1e-30] * 8, [-0.0, 1.0], [0.0, 1.0]]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    made = [(int(i), v) for i, v in zip(ids, rows)]
    return made + [made[3], (made[5][0], made[9][1]), (None, made[700][1]), (None, None), (None, made[0][1])]


@pytest.mark.parametrize("options", [{}, {"cell_rows": 20, "block_rows": 4096}, {"cell_rows": 30, "block_rows": 25}, {"cell_rows": 10, "block_rows": 16, "sample_bytes": 5_000}])
def test_vectors_lose_no_link(spark, options):
    rows = embedded(4)
    schema = "vec_id long, embedding array<float>, label int, cls long, n long, vec string, cell int"
    df = spark.createDataFrame([(i, v, 1, 2, 3, "x", 4) for i, v in rows], schema).repartition(4)
    got = sorted(map(tuple, vectors.near_vectors(df, **options).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)
    assert got == plain_links(rows, 0.95)


def test_vectors_in_double_precision(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(200, 3)) * 1e200)]
    got = sorted(map(tuple, vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cell_rows=9).collect()), key=str)
    assert got == plain_links(rows, 0.95)


def test_vectors_of_an_empty_table(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_vector_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.QUERIES["op12_vector_groups"](spark, sf).collect()), key=str) == plain_links(rows, 0.95)


# ---- spelling ------------------------------------------------------------------------------------------------


def plain_words(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 199 == 0:
                p = h % len(w)
                w = w[:p] + w[p + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def plain_variants(counts):
    near = {w: set() for w in counts}
    holes = {}
    for w in counts:
        for i in range(len(w)):
            if w[:i] + w[i + 1 :] in counts:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
            holes.setdefault((i, w[:i], w[i + 1 :]), []).append(w)
    for group in holes.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n, len(near[w]), counts.get(form[w], 0)) for w, n in counts.items())


def listed(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


@pytest.mark.parametrize("filter_bytes", [32 << 20, 512, 64])
def test_spelling_variants(spark, filter_bytes):
    """Chains of forms, ties, equal neighbours, characters of all planes, long words; also over many rounds and parts."""
    rng = random.Random(6)
    counts = {"abcdef": 700, "abcdeg": 700, "abcdefg": 130, "abcdeh": 25, "bbcdeh": 5, "aaaaaa": 9, "aaaaaaa": 50, "aaaaaaaa": 300, "élèvesé": 40, "eleves😀": 6, "élèves😀": 30, "y" * 3_000: 5, "y" * 2_999: 30}
    for _ in range(400):
        counts["".join(rng.choice("abé") for _ in range(rng.randrange(6, 9)))] = rng.choice([5, 6, 30, 200])
    rows = [(w, 1) for w, n in counts.items() for _ in range(n)] + [("short", 1)] * 9 + [("scarce-word", 1)] * 4 + [(None, 1)]
    df = spark.createDataFrame(rows, "word string, n int").repartition(4)
    assert listed(spelling.spelling_variants(df, filter_bytes=filter_bytes)) == plain_variants(counts)


@pytest.mark.parametrize("name", ["given", "none", "made"])
def test_spelling_query(spark, sf, tmp_path, name):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    folder = sf
    if name != "given":
        rows = [(None, "Wörterbuch wörterbuch×x " * 9), (3, None), (None, None), (4, ""), *((i, "Straßenbahn strassenbahn STRAßENBAHN ÀÉÎÕÜß " * 3) for i in range(900))] if name == "made" else []
        folder = str(tmp_path)
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    assert listed(queries.QUERIES["op13_spelling_variants"](spark, folder)) == plain_variants(plain_words(rows))


# ---- links of rows without ids and of ids with several texts -------------------------------------------------


def edited_text(seed, places=()):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(100)]
    for p in places:
        words[p] = f"changed{p}x{seed}"
    return " ".join(words)


def test_rows_without_ids_and_ids_with_several_texts_lose_no_link(spark):
    from tracewell.llm import neardup

    rows = [(7, edited_text(1)), (None, edited_text(1, [50])), (30, edited_text(2)), (None, edited_text(2, [20])), (31, edited_text(2, [20, 80]))]
    rows += [(5, edited_text(3)), (5, edited_text(4)), (6, edited_text(3, [40])), (8, edited_text(4, [60])), (None, edited_text(5)), (None, edited_text(5, [10])), (12, ""), (None, None)]
    docs = spark.createDataFrame([(d, t, 1, 2, "x", 3, "y") for d, t in rows], "doc_id long, text string, node long, a long, keys string, component long, sample string").repartition(3)
    for _ in range(2):
        got = neardup.near_duplicates(docs).collect()
        by_text = {(r.doc_id, r.text_key): (r.component_id, r.component) for r in got}
        assert len(got) == len(rows)
        assert sorted(str((r.doc_id, r.component_id)) for r in got) == sorted(map(str, [(7, 7), (None, 7), (30, 30), (None, 30), (31, 30), (5, 5), (5, 5), (6, 5), (8, 5), (None, None), (None, None), (12, 12), (None, None)]))
        without = {c for (d, _), (i, c) in by_text.items() if d is None and i is None and c is not None}
        assert len(without) == 1


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline
    from tracewell.llm import secrets

    secret = "password=abcdefgh1234"
    rows = [(1, edited_text(1) + " " + secret), (2, edited_text(2))]
    docs = spark.createDataFrame([(d, t, "en", "s", 5, "i", "k", "t", "s", 9) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, __id string, __key string, __text_key string, __spans string, __k long")
    masked = {r.doc_id: tuple(r) for r in secrets.redacted(docs).collect()}
    assert masked[1] == (1, rows[0][1].replace(secret, "[SECRET]"), "en", "s", 5, "i", "k", "t", "s", 9) and masked[2][1] == rows[1][1]
    stage = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert stage.columns == docs.columns and sorted(map(tuple, stage.collect())) == sorted(map(tuple, docs.collect()))
    assert corpus_pipeline.secrets_stage(spark, docs, "").columns == docs.columns


# ---- the sample that language identification learns from -----------------------------------------------------


def test_language_sample_is_bounded_by_rows_and_meets_its_conditions(spark):
    from tracewell.llm import langid

    rows = [(1, "the house is here", "en"), (1, None, "en"), (2, "la casa es grande", "es"), (3, "not to be learnt from", "en"), (3, "nor this", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = lambda df, n, train=F.lit(True): langid.training_sample(df, train, n, "doc_id", "text", "lang", 256, 20_000)
    assert sample(df, 200, F.col("doc_id") < 3) == [("en", "the house is here"), ("es", "la casa es grande")]
    assert langid.identify_languages(df, training=F.col("doc_id") < 3, steps=3).count() == len(rows)
    many = spark.createDataFrame([(5, f"text {i} of one id", "en") for i in range(3_000)] + [(6, "same", "en")] * 40, "doc_id long, text string, lang string").repartition(4)
    assert len(sample(many, 5)) == 5


def test_pooled_probabilities_against_plain_loops():
    """A small network's forward pass, state by state, over texts of several segments."""
    from tracewell.llm import langid

    net = langid.BiGRU(3, 2, seed=1)
    texts = [b"ab", b"", "längere".encode() * 5, b"x" * 16]
    got = langid.label_texts(net, texts, span=8)
    for text, row in zip(texts, got):
        parts = [text[i : i + 8] for i in range(0, len(text), 8)]
        total = np.zeros(2)
        for part in parts:
            x = np.full((8, 1), 32, np.uint8)
            x[: len(part), 0] = np.frombuffer(part, np.uint8)
            total += net.forward(x)[: len(part), 0].sum(0)
        assert np.allclose(row, total / max(len(text), 1), atol=1e-5)
        assert not len(text) or np.isclose(row.sum(), 1, atol=1e-4)


def test_stages_of_an_empty_table_give_empty_tables(spark, sf):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, more string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.collect() == [], name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect() == []
