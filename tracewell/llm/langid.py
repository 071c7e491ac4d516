"""Language identification with a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample of labelled
texts. It labels every byte of every text; a document's probabilities are the means over its bytes.
Texts are read in segments of ``span`` bytes, so memory is bounded and long texts are whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


class BiGRU:
    """Two GRUs, one per direction, over byte embeddings folded into the gate inputs, and a softmax."""

    def __init__(self, hidden: int, labels: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.hidden, self.labels = hidden, labels
        self.p = {}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            self.p["u" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
        self.p["o"] = rng.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, labels)).astype(np.float32)
        self.p["c"] = np.zeros(labels, np.float32)

    def _run(self, d: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of one direction after each byte; x: time x batch, in reading order."""
        n, (steps, batch) = self.hidden, x.shape
        table, u = self.p["x" + d], self.p["u" + d]
        states = np.empty((steps, batch, n), np.float32)
        h = np.zeros((batch, n), np.float32)
        for t in range(steps):
            a, g = table[x[t]], h @ u
            zr = _sigmoid(a[:, : 2 * n] + g[:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            c = np.tanh(a[:, 2 * n :] + r * g[:, 2 * n :])
            if keep is not None:
                keep.append((h, z, r, c, g[:, 2 * n :]))
            h = c + z * (h - c)
            states[t] = h
        return states

    def forward(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Probabilities of each label at each position; x: time x batch of byte values."""
        f = self._run("f", x, None if keep is None else keep.setdefault("f", []))
        b = self._run("b", x[::-1], None if keep is None else keep.setdefault("b", []))[::-1]
        n = self.hidden
        logits = f @ self.p["o"][:n] + b @ self.p["o"][n:] + self.p["c"]
        logits -= logits.max(-1, keepdims=True)
        e = np.exp(logits)
        if keep is not None:
            keep["states"] = (f, b)
        return e / e.sum(-1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions and its gradients; y: label of each sequence."""
        keep: dict = {}
        prob = self.forward(x, keep)
        steps, batch = x.shape
        loss = -float(np.log(prob[:, np.arange(batch), y] + 1e-12).mean())
        delta = prob.copy()
        delta[:, np.arange(batch), y] -= 1
        delta /= steps * batch
        f, b = keep["states"]
        n, g = self.hidden, {}
        g["c"] = delta.sum((0, 1))
        g["o"] = np.concatenate([np.tensordot(s, delta, ((0, 1), (0, 1))) for s in (f, b)])
        for d, seq, out in (("f", x, delta @ self.p["o"][:n].T), ("b", x[::-1], (delta @ self.p["o"][n:].T)[::-1])):
            g["x" + d], g["u" + d] = np.zeros_like(self.p["x" + d]), np.zeros_like(self.p["u" + d])
            u, back = self.p["u" + d], np.zeros((batch, n), np.float32)
            for t in range(steps - 1, -1, -1):
                h, z, r, c, uc = keep[d][t]
                dh = out[t] + back
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * uc * r * (1 - r)
                gates = np.concatenate([dz, dr, dc], 1)
                inner = np.concatenate([dz, dr, dc * r], 1)
                np.add.at(g["x" + d], seq[t], gates)
                g["u" + d] += h.T @ inner
                back = dh * z + inner @ u.T
        return loss, g


def train(texts: list[bytes], labels: list[int], n_labels: int, *, hidden: int = 8, span: int = 48, steps: int = 500, batch: int = 96, rate: float = 0.02, seed: int = 0) -> BiGRU:
    """Adam over random spans of whole texts; equally many spans of each label."""
    net, rng = BiGRU(hidden, n_labels, seed), np.random.default_rng(seed + 1)
    by_label = [[i for i, y in enumerate(labels) if y == k and len(texts[i]) > 0] for k in range(n_labels)]
    usable = [k for k in range(n_labels) if by_label[k]]
    if not usable:
        return net
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(w) for k, w in net.p.items()}
    for step in range(1, steps + 1):
        y = np.array([usable[i % len(usable)] for i in range(batch)])
        x = np.full((span, batch), 32, np.uint8)
        for j, k in enumerate(y):
            text = texts[by_label[k][rng.integers(len(by_label[k]))]]
            at = int(rng.integers(max(1, len(text) - span + 1)))
            part = np.frombuffer(text[at : at + span], np.uint8)
            x[: len(part), j] = part
        _, g = net.gradients(x, y)
        norm = float(np.sqrt(sum((w * w).sum() for w in g.values())))
        scale = min(1.0, 1.0 / (norm + 1e-12))
        lr = rate * (0.1 + 0.9 * (1 - step / steps))
        for k in net.p:
            gk = g[k] * scale
            m[k] = 0.9 * m[k] + 0.1 * gk
            v[k] = 0.99 * v[k] + 0.01 * gk * gk
            net.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def label_texts(net: BiGRU, texts: list[bytes], *, span: int = 128, rows: int = 2048) -> np.ndarray:
    """Mean label probabilities of each text over all its bytes; zeros for an empty text."""
    sums, sizes = np.zeros((len(texts), net.labels)), np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), -(-sizes // span))
    padded = np.frombuffer(b"".join(t + b" " * (-len(t) % span) for t in texts), np.uint8).reshape(-1, span)
    last = np.zeros(len(owner), bool)
    last[np.cumsum(-(-sizes // span))[sizes > 0] - 1] = True
    used = np.where(last, (sizes[owner] - 1) % span + 1, span)
    for at in range(0, len(owner), rows):
        prob = net.forward(np.ascontiguousarray(padded[at : at + rows].T))
        real = np.arange(span)[:, None] < used[None, at : at + rows]
        np.add.at(sums, owner[at : at + rows], np.einsum("tbl,tb->bl", prob, real.astype(np.float32)))
    return sums / np.maximum(sizes, 1)[:, None]


#: So many characters of labelled texts reach the driver at most, whatever the other bounds allow.
SAMPLE_CHARS = 64 << 20


def training_sample(docs: DataFrame, training: Column, per_label: int, id_col: str, text_col: str, lang_col: str, languages: int, chars: int) -> list[tuple[str, str]]:
    """At most ``per_label`` (language, text) pairs of each language, chosen by a hash of the id; of longer texts
    ``chars`` characters from a place given by the id. Of more than ``languages`` languages the most frequent.

    The rows are found first, without their texts, in one scan that keeps a bounded top of each language. Of an id
    with several texts, each is a row of its own.
    """
    texts = docs.filter(training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    texts = texts.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("key"))
    labelled = texts.drop("text")
    langs = [r["lang"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()]
    if not langs:
        return []
    chars = min(chars, SAMPLE_CHARS // (len(langs) * per_label))
    # Each task keeps its first rows of a language before they are shuffled.
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("id").cast("string")), "id", "key")
    chosen = labelled.filter(F.col("lang").isin(langs)).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= per_label).drop("nth")
    wanted = docs.sparkSession.createDataFrame(chosen.collect(), chosen.schema).distinct()
    same = texts["id"].eqNullSafe(wanted["id"]) & (texts["lang"] == wanted["lang"]) & (texts["key"] == wanted["key"])
    # Equal rows are one row of the sample.
    rows = texts.join(F.broadcast(wanted), same, "left_semi").dropDuplicates(["id", "lang", "key"])
    at = F.pmod(F.xxhash64(F.col("id").cast("string")), F.greatest(F.length("text") - chars, F.lit(1)))
    return sorted((r["lang"], r["text"]) for r in rows.select("lang", F.substring(F.col("text"), (at + 1).cast("int"), F.lit(chars)).alias("text")).collect())


def identify_languages(
    docs: DataFrame,
    *,
    training: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_label: int = 200,
    hidden: int = 8,
    steps: int = 500,
    max_languages: int = 256,
    sample_chars: int = 20_000,
) -> DataFrame:
    """``doc_id, lang_pred, score, probabilities`` (map of label to pooled probability) per input row.

    The network learns from at most ``per_label`` rows of each language among those that fulfil
    ``training``, at most ``sample_chars`` characters of each, of the ``max_languages`` most frequent languages
    (ties by name): these three bound the labelled sample that the driver trains on. Every text is read
    whole, in segments from which each direction starts afresh; an empty table gives no rows; of labels with
    equal probability the first by name is taken. ``lang_pred`` is ``und`` with score 0 for null texts and texts without a letter, and
    where there is nothing to learn from. Repeated rows give repeated results; other columns are ignored.
    """
    sample = training_sample(docs, training, per_label, id_col, text_col, lang_col, max_languages, sample_chars)
    names = sorted({lang for lang, _ in sample})
    net = train([t.encode("utf-8", "surrogatepass") for _, t in sample], [names.index(x) for x, _ in sample], len(names), hidden=hidden, steps=steps) if names else None
    src = docs.select(F.col(id_col).alias("doc_id"), F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)).alias("text"))
    out = T.StructType([src.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("probabilities", T.MapType(T.StringType(), T.DoubleType()))])
    weights = net.p if net else None

    def run(batches):
        model = BiGRU(hidden, len(names)) if weights else None
        if model:
            model.p = weights
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part.column("text").to_pylist()
                known = [t is not None and model is not None for t in texts]
                prob = label_texts(model, [t.encode("utf-8", "surrogatepass") if k else b"" for t, k in zip(texts, known)]) if any(known) else np.zeros((len(texts), 1))
                best = prob.argmax(1)
                pred = [names[i] if k else UNKNOWN for i, k in zip(best, known)]
                score = [float(min(1.0, prob[i, j])) if k else 0.0 for i, (j, k) in enumerate(zip(best, known))]
                maps = [list(zip(names, map(float, prob[i]))) if k else [] for i, k in enumerate(known)]
                columns = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(maps, pa.map_(pa.string(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], out.fieldNames())

    return src.mapInArrow(run, out)
