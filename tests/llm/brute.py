"""Plain versions of what the operators compute, for small inputs."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return (t or "").translate(LOWER)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def crc(doc_id, n):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def katz_base(docs):
    tokens = {i: SPACE_WORD.findall(low(t)) + [None] for i, (d, t) in enumerate(docs)}
    train = Counter()
    for i, (d, t) in enumerate(docs):
        if d is not None and crc(d, 7) != 2:
            train.update(tokens[i])
    n, v = sum(train.values()), len(train)
    return [(d, len(tokens[i]), sum(train[w] > 0 for w in tokens[i]), n, sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens[i])) for i, (d, t) in enumerate(docs)]


def katz_factors(counts):
    n = Counter(counts)
    common = 8 * n[8] / n[1] if n[1] else 1
    d = {}
    for r in range(1, 8):
        value = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0
        d[r] = value if 0 < value < 1 else (r - 0.5) / r
    return d


def katz_model(docs, trained):
    """A function from (first word, middle word, word) to its probability at order three; None ends a text."""
    grams = [Counter(), Counter(), Counter()]
    for d, t in docs:
        if trained(d):
            w = [None, None, *SPACE_WORD.findall(low(t)), None]
            for i in range(2, len(w)):
                for n in range(3):
                    grams[n][tuple(w[i - n : i + 1])] += 1
    factors = [katz_factors(g.values()) for g in grams]
    successors = [defaultdict(dict) for _ in grams]
    for g, s in zip(grams, successors):
        for k, r in g.items():
            s[k[:-1]][k[-1]] = r

    @cache
    def total(n, context):
        r = successors[n].get(context, {}).values()
        return sum(r) + (all(x > 7 for x in r) and len(r) > 0)

    weights = {}

    def p(context, word):
        n = len(context)
        seen = successors[n].get(context)
        if not seen:
            return p(context[1:], word) if n else 1.0
        if word in seen:
            return factors[n].get(seen[word], 1) * seen[word] / total(n, context)
        if context not in weights:
            left = 1 - sum(factors[n].get(r, 1) * r for r in seen.values()) / total(n, context)
            weights[context] = left / (1 - sum(p(context[1:], w) for w in seen)) if n else left
        return weights[context] * (p(context[1:], word) if n else 1)

    return lambda a, b, w: p((a, b), w)


def katz_scores(docs, trained):
    p, out = katz_model(docs, trained), []
    for _, t in docs:
        w = [None, None, *SPACE_WORD.findall(low(t)), None]
        out.append(sum(math.log10(p(w[i - 2], w[i - 1], w[i])) for i in range(2, len(w))))
    return out


def bpe(docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for d, t in docs:
        ids = enc.encode_ordinary(t or "")
        out.append((d, len(ids), sha(",".join(map(str, ids))), sha((t or "").encode())))
    return out


def token_counts(docs):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return [(d, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 512) for d, x in docs]


def quality_base(docs):
    out = []
    for d, t in docs:
        t = t or ""
        w = SPACE_WORD.findall(t)
        lines = [x for x in t.split("\n") if SPACE_WORD.search(x)]
        at = defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i : i + 3])].append(i)
        hit = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(3)}
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        out.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), failed))
    return out


def quality_histograms(docs, bins):
    """Characters by class (lower, upper, digit, space, beyond ASCII, other) and words by bin, all others last."""
    out = []
    for d, t in docs:
        t = t or ""
        w = Counter(SPACE_WORD.findall(t))
        ranges = [("a", "z"), ("A", "Z"), ("0", "9"), None, ("\x80", "\U0010ffff")]
        n = [sum(c in " \t\n\x0b\x0c\r" if r is None else r[0] <= c <= r[1] for c in t) for r in ranges]
        common = [w[b] for b in bins]
        out.append((d, [*n, len(t) - sum(n)], [*common, w.total() - sum(common)]))
    return out


def shingles(t, size):
    w = SPACE_WORD.findall(low(t))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def components(docs, size, percent=80):
    sets = [shingles(t, size) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    shared = Counter()
    for v in by.values():
        for a in range(len(v)):
            for b in range(a):
                shared[v[b], v[a]] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            parent[find(a)] = find(b)
    first = {}
    for i, (d, _) in enumerate(docs):
        if sets[i]:
            r = find(i)
            first[r] = min(x for x in (first.get(r), d) if x is not None) if first.get(r) is not None or d is not None else None
    out = []
    for i, (d, _) in enumerate(docs):
        c = first[find(i)] if sets[i] else d
        out.append((d, len(sets[i]), c, d is not None and d == c))
    return out


def licenses_base(docs):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    out = []
    for d, t in docs:
        w = ALNUM_WORD.findall(low(t))
        hits = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in hits]
        out.append((d, len(w), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))))
    return out


def license_labels(docs, templates, least):
    """Labels of templates: every place of every text is tried."""
    texts = [ALNUM_WORD.findall(low(t)) for _, t in docs]
    of = {k: [(t.split(), p.split()) for t, p in several] for k, several in templates.items()}
    words = {w for several in of.values() for t, _ in several for w in t}
    df = Counter(w for t in texts for w in words.intersection(t))
    idf = {w: math.log((len(texts) + 1) / (df[w] + 1)) + 1e-6 for w in words}
    out = []
    for w in texts:
        labels = set()
        for k, several in of.items():
            for t, p in several:
                for at in range(1 - len(t), len(w)):
                    inside = [(x, w[at + i]) for i, x in enumerate(t) if 0 <= at + i < len(w)]
                    if sum(idf[a] for a, b in inside if a == b) >= least * sum(map(idf.get, t)):
                        there = w[max(0, at) : at + len(t)]
                        if any(there[i : i + len(p)] == p for i in range(len(there))):
                            labels.add(k)
        out.append(labels)
    return out


def repeats(docs, size):
    words = [SPACE_WORD.findall(t or "") for _, t in docs]
    first = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            for s in range(len(words[i]) - size + 1):
                k = tuple(words[i][s : s + size])
                first[k] = min(first.get(k, (d, s)), (d, s))
    out = []
    for i, (d, _) in enumerate(docs):
        gone = set()
        for s in range(len(words[i]) - size + 1):
            if d is not None and first[tuple(words[i][s : s + size])] < (d, s):
                gone.update(range(s, s + size))
        out.append((d, len(words[i]), len(gone), sha(" ".join(w for j, w in enumerate(words[i]) if j not in gone))))
    return out


def contamination(docs, items, size):
    windows = defaultdict(set)
    for item, t in items:
        w = ALNUM_WORD.findall(low(t))
        for s in range(max(1, len(w) - size + 1)) if w else ():
            windows[tuple(w[s : s + size])].add(str(item))
    sizes = {len(k) for k in windows}
    out = []
    for d, t in docs:
        w, hit, found = ALNUM_WORD.findall(low(t)), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[k]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def near_contamination(docs, items, size, lists, slop, share):
    """(doc_id, n_near, near items) by looking at every window and every place."""
    texts = [(d, ALNUM_WORD.findall(low(t))) for d, t in docs]
    counts = Counter(w for _, t in texts for w in t)
    owners = defaultdict(set)
    for item, t in items:
        w = ALNUM_WORD.findall(low(t))
        for s in range(max(1, len(w) - size + 1)) if w else ():
            owners[tuple(w[s : s + size])].add(str(item))
    rare = {}
    for k in owners:
        if len(k) == size and 100 * len({x for x in k if x in counts}) >= share * len(set(k)):
            rare[k] = sorted((counts[x], i, x) for i, x in enumerate(k) if x in counts)[:lists]
    sizes, out = {len(k) for k in owners}, []
    for d, w in texts:
        hit, near, exact_items, near_items = set(), set(), set(), set()
        at = defaultdict(set)
        for i, x in enumerate(w):
            at[x].add(i)
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in owners:
                    hit.update(range(s, s + n))
                    exact_items |= owners[k]
        for k, lookups in rare.items():
            if not all(x in at for _, _, x in lookups):
                continue
            for s in {p - lookups[0][1] for p in at[lookups[0][2]]}:
                if s < -slop or not all(any(q + i in at[x] for q in range(max(s - slop, -slop), s + slop + 1)) for _, i, x in lookups):
                    continue
                around = set(w[max(s - slop, 0) : s + size + slop])
                if 100 * len(around & set(k)) >= share * len(set(k)):
                    near.update(range(max(s, 0), min(s + size, len(w))))
                    near_items |= owners[k]
        out.append((d, len(near - hit), ",".join(sorted(near_items - exact_items))))
    return out


def secrets_base(docs):
    kinds = {
        "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 8),
        "access": (re.compile("AKIA[A-Z0-9]+"), 0, 16),
        "hex": (re.compile("[0-9a-f]+"), 0, 32),
    }
    out = []
    for d, t in docs:
        found = sorted((m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, (rx, g, n)) in enumerate(kinds.items()) for m in rx.finditer(t or "") if len(m[g]) >= n)
        c = Counter(x[1] for x in found)
        out.append((d, c[0], c[1], c[2], sha(",".join(x[2] for x in found))))
    return out
