"""License scans by a positional rare-token index.

The index maps words of the licence templates to their (template, position) postings: of each template
its own rarest words, by inverse document frequency over all files, so many that a place without any of
them can't hold enough of its weight. All their positions in a file are looked up; postings are intersected
by (template, file position - template position): a place needs as many of them as one with enough weight
can't do without. It becomes a label when enough of the template's weight stands there and the template's
mandatory phrase is found inside it.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM_TABLE

# Phrases that label a file by themselves.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Label -> templates (words of the usual notice, of the text's beginning or of a short form, and
# a phrase that must be there).
TEMPLATES = {
    "apache-2.0": (
        ("licensed under the apache license version 2 0", "apache license version 2 0"),
        ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache license version 2 0"),
        ("apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution", "apache license version 2 0"),
        ("spdx license identifier apache 2 0", "identifier apache 2 0"),
    ),
    "gpl-2.0": (
        ("licensed under the gnu general public license version 2", "gnu general public license version 2"),
        ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "gnu general public license as published by the free software foundation either version 2"),
        ("you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation", "gnu general public license version 2"),
        ("gnu general public license version 2 june 1991", "gnu general public license version 2 june 1991"),
        ("spdx license identifier gpl 2 0", "identifier gpl 2 0"),
    ),
    "gpl-3.0": (
        ("licensed under the gnu general public license version 3", "gnu general public license version 3"),
        ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu general public license as published by the free software foundation either version 3"),
        ("you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation", "gnu general public license version 3"),
        ("gnu general public license version 3 29 june 2007", "gnu general public license version 3 29 june 2007"),
        ("spdx license identifier gpl 3 0", "identifier gpl 3 0"),
    ),
    "lgpl": (
        ("licensed under the gnu lesser general public license version", "gnu lesser general public license"),
        ("you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license as published by the free software foundation"),
        ("you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation", "gnu library general public license as published by the free software foundation"),
        ("gnu lesser general public license version 2 1 february 1999", "gnu lesser general public license version 2 1 february 1999"),
        ("gnu lesser general public license version 3 29 june 2007", "gnu lesser general public license version 3 29 june 2007"),
        ("spdx license identifier lgpl", "identifier lgpl"),
    ),
    "agpl": (
        ("licensed under the gnu affero general public license version", "gnu affero general public license"),
        ("you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license as published by the free software foundation"),
        ("gnu affero general public license version 3 19 november 2007", "gnu affero general public license version 3 19 november 2007"),
        ("spdx license identifier agpl", "identifier agpl"),
    ),
    "mit-text": (
        ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
        ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "to deal in the software without restriction"),
        ("spdx license identifier mit", "identifier mit"),
    ),
    "bsd": (
        ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
        ("use of this source code is governed by a bsd style license that can be found in the license file", "governed by a bsd style license"),
        ("spdx license identifier bsd", "identifier bsd"),
    ),
    "isc": (
        ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
        ("permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "with or without fee is hereby granted"),
        ("spdx license identifier isc", "identifier isc"),
    ),
    "mpl": (
        ("this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
        ("the contents of this file are subject to the mozilla public license version 1 1 the license you may not use this file except in compliance with the license", "mozilla public license"),
        ("mozilla public license version 2 0 1 definitions", "mozilla public license version 2 0"),
        ("spdx license identifier mpl", "identifier mpl"),
    ),
    "unlicense": (
        ("this is free and unencumbered software released into the public domain", "free and unencumbered software"),
        ("spdx license identifier unlicense", "identifier unlicense"),
    ),
    "cc-by-nc": (
        ("licensed under cc by nc 4 0", "cc by nc"),
        ("licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4 0"),
        ("creative commons attribution noncommercial 4 0 international public license", "attribution noncommercial 4 0 international public license"),
        ("spdx license identifier cc by nc", "identifier cc by nc"),
    ),
    "cc-by-sa": (
        ("licensed under cc by sa 4 0", "cc by sa"),
        ("licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0"),
        ("creative commons attribution sharealike 4 0 international public license", "attribution sharealike 4 0 international public license"),
        ("spdx license identifier cc by sa", "identifier cc by sa"),
    ),
    "cc0": (
        ("to the extent possible under law waived all copyright cc0 1 0 universal", "cc0 1 0"),
        ("has waived all copyright and related or neighboring rights to", "waived all copyright and related or neighboring rights"),
        ("creative commons legal code cc0 1 0 universal", "cc0 1 0 universal"),
        ("spdx license identifier cc0 1 0", "identifier cc0 1 0"),
    ),
}


def file_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lowered, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM_TABLE).split() if text else []


def places(words: list[bytes], phrase: list[bytes], start: int = 0, stop: int | None = None) -> list[int]:
    """All starts of ``phrase`` in ``words[start:stop]``, overlapping ones too."""
    anchor = max(range(len(phrase)), key=lambda i: len(phrase[i]))
    found, at, stop = [], start, len(words) if stop is None else stop
    while True:
        try:
            at = words.index(phrase[anchor], at, stop)
        except ValueError:
            return found
        begin = at - anchor
        if begin >= start and begin + len(phrase) <= stop and words[begin : begin + len(phrase)] == phrase:
            found.append(begin)
        at += 1


class LicenseIndex:
    def __init__(self, templates: dict[str, tuple[tuple[str, str], ...]], phrases: dict[str, str], idf: dict[bytes, float], rare: int, least: float):
        self.phrases = [(p.encode().split(), label) for p, label in phrases.items()]
        self.needles = [max(p, key=len) for p, _ in self.phrases]
        self.templates = {(k, i): (t.encode().split(), p.encode().split()) for k, several in templates.items() for i, (t, p) in enumerate(several)}
        self.idf, self.rare, self.least = idf, rare, least
        self.weight = {k: sum(self._idf(w) for w in t) for k, (t, _) in self.templates.items()}
        self.postings: dict[bytes, list[tuple[tuple[str, int], int]]] = defaultdict(list)
        for k, (t, _) in self.templates.items():
            for i, w in enumerate(t):
                self.postings[w].append((k, i))
        self.vocabulary = frozenset(self.postings)
        sure = {k: self._sure(t, self.weight[k]) for k, (t, _) in self.templates.items()}
        kept = {w: [(k, i) for k, i in found if w in sure[k]] for w, found in self.postings.items()}
        self.lookup = {w: found for w, found in kept.items() if found}
        self.need = {k: self._need([self._idf(w) for w in t if w in sure[k]], self.weight[k]) for k, (t, _) in self.templates.items()}

    def _idf(self, word: bytes) -> float:
        return self.idf.get(word, max(self.idf.values(), default=1.0))

    def _sure(self, template: list[bytes], weight: float) -> set[bytes]:
        """The rarest words of a template, ``rare`` of them or as many as no place with enough weight lacks."""
        chosen, left = set(), weight * (1 + 1e-9)
        for w in sorted(set(template), key=lambda w: (-self._idf(w), w)):
            if len(chosen) >= self.rare and left < self.least * weight:
                break
            chosen.add(w)
            left -= self._idf(w) * template.count(w)
        return chosen

    def _need(self, weights: list[float], whole: float) -> int:
        """How many postings with these weights a place has at least where ``least`` of the weight stands."""
        lost, n = (1 - self.least) * whole * (1 + 1e-9), len(weights)
        for w in sorted(weights):
            lost -= w
            if lost < 0:
                break
            n -= 1
        return max(n, 1)

    def template_matches(self, words: list[bytes], present: set[bytes]) -> dict[str, float]:
        """label -> the largest share of a template's weight found in place, where its phrase is verified."""
        votes: dict[tuple[tuple[str, int], int], int] = defaultdict(int)
        for w in present.intersection(self.lookup):
            at = -1
            try:
                while True:
                    at = words.index(w, at + 1)
                    for k, i in self.lookup[w]:
                        votes[k, at - i] += 1
            except ValueError:
                pass
        best: dict[str, float] = {}
        for (k, begin), n in votes.items():
            if n < self.need[k]:
                continue
            template, phrase = self.templates[k]
            got = sum(self._idf(w) for i, w in enumerate(template) if 0 <= begin + i < len(words) and words[begin + i] == w)
            share = got / self.weight[k] if self.weight[k] else 0.0
            if share >= self.least and share > best.get(k[0], 0.0) and places(words, phrase, max(0, begin), min(len(words), begin + len(template))):
                best[k[0]] = share
        return best

    def scan(self, text: str | None) -> tuple:
        data = text.encode("utf-8", "surrogatepass").translate(ALNUM_TABLE) if text else b""
        words = data.split()
        hits: list[tuple[int, int, str]] = []
        for (phrase, label), needle in zip(self.phrases, self.needles):
            if needle in data:
                hits += [(p, p + len(phrase), label) for p in places(words, phrase)]
        present = self.vocabulary.intersection(words)
        matched = self.template_matches(words, present) if present else {}
        base = sorted({x[2] for x in hits})
        starts = [x[0] for x in hits]
        score = min(1.0, max([*matched.values(), 1.0 if base else 0.0], default=0.0))
        return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted({*base, *matched})), score


def document_frequencies(docs: DataFrame, vocabulary: frozenset[bytes], text_col: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many rows each licence word occurs, and the number of rows; one row per word reaches the driver."""

    def count(batches):
        n, seen = 0, defaultdict(int)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                for text in b.column(0).slice(at, 512).to_pylist():
                    n += 1
                    for w in vocabulary.intersection(file_words(text)):
                        seen[w] += 1
        yield pa.RecordBatch.from_pydict({"word": [b"", *seen], "n": [n, *seen.values()]}, pa.schema([("word", pa.binary()), ("n", pa.int64())]))

    rows = docs.select(text_col).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {bytes(r["word"]): r["n"] for r in rows}
    return found, found.pop(b"", 0)


def license_scan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: dict[str, str] = PHRASES,
    templates: dict[str, tuple[tuple[str, str], ...]] = TEMPLATES,
    rare: int = 6,
    least: float = 0.8,
) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` per input row.

    Null and empty texts have no words, no labels and score 0; repeated rows give repeated results; an
    empty table gives no rows; other columns are ignored; words of equal frequency are taken by name, and very
    long texts are scanned whole. ``score`` is the largest share of a template's
    weight found in place, 1 for a whole phrase.
    """
    vocabulary = frozenset(w for several in templates.values() for t, _ in several for w in t.encode().split())
    df, n = document_frequencies(docs, vocabulary, text_col)
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1e-6 for w in vocabulary}
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = [("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType())]
    out = T.StructType([src.schema["doc_id"], *(T.StructField(*k) for k in kinds)])

    def run(batches):
        index = LicenseIndex(templates, phrases, idf, rare, least)
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows = [index.scan(t) for t in part.column("text").to_pylist()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], out.fieldNames())

    return src.mapInArrow(run, out)
