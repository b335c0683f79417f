"""License scans with a positional index of rare words.

Templates are word sequences.  Each is posted under the POSTED rarest words (by IDF over the corpus) of the phrase in it
that must stand whole, with their places.  A file's licence words are looked up in this index, those of the highest IDF
first: a posted word at file place p that stands at place d of a template proposes the start p - d, and only starts that
all posted words of a template propose are kept.  The mandatory phrase is verified there, then the template's other words
are compared at the same relative places.  As the phrase must stand whole, all its posted words agree wherever it does,
so no match is missed, and the work follows the words found, not the number of templates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytehash as bh
from tidemark.llm.durable import small_batches
from tidemark.llm.rows import field, named, row_of, with_row

# Phrases that stand for a licence wherever they occur.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Passages of published licences and notices, and the phrase in them that must stand whole.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("apache-2.0", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("gpl-notice", "this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "the terms of the gnu general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-notice", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "person or organization obtaining a copy of the software"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0", "eclipse public license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", "sil open font license"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", "changing it is allowed as long as the name is changed"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "fitness for a particular purpose and noninfringement"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions in binary form must reproduce the above copyright notice"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "software distributed under the license is distributed on an as is basis"),
    ("gpl-notice", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "distributed in the hope that it will be useful"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "must not be misrepresented as being the original software"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", "creative commons attribution noderivatives"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "gnu free documentation license"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", "common development and distribution license"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "without a written agreement is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)
LEAST_SHARE = 0.6
POSTED = 3


def _license_word_byte() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
    return table


WORD = _license_word_byte()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass(frozen=True)
class Template:
    label: str
    words: np.ndarray  # numbers in the vocabulary
    key: tuple[int, int]  # places of the mandatory phrase
    base: bool


def _vocabulary() -> tuple[list[str], np.ndarray, np.ndarray]:
    """Licence words, their sorted codes, and each sorted code's word number."""
    words = sorted({w for phrase in [*BASE, *(t for _, t, _ in NOTICES)] for w in phrase.split()})
    data = " ".join(words).encode()
    raw = np.frombuffer(data, dtype=np.uint8)
    starts, stops, _ = bh.word_spans(raw, np.array([0, len(raw)]), WORD)
    codes = bh.word_codes(raw, starts, stops)
    order = np.argsort(codes)
    return words, codes[order], order


def templates() -> list[Template]:
    number = {w: i for i, w in enumerate(_vocabulary()[0])}
    out = [Template(label, np.array([number[w] for w in p.split()]), (0, len(p.split())), True) for p, label in BASE.items()]
    for label, notice, key in NOTICES:
        words, phrase = notice.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        out.append(Template(label, np.array([number[w] for w in words]), (at, at + len(phrase)), False))
    return out


def _numbered(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Licence-word number of every word of a slice (-1: none), and each text's first word."""
    _, sorted_codes, order = _vocabulary()
    low = LOWER[data]
    starts, stops, first = bh.word_spans(low, offsets, WORD)
    codes = bh.word_codes(low, starts, stops)
    at = np.minimum(np.searchsorted(sorted_codes, codes), len(sorted_codes) - 1)
    return np.where(sorted_codes[at] == codes, order[at], -1), first


def _frequency_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, texts that hold it) of a task; word -1 counts the texts."""
    total = np.zeros(len(_vocabulary()[0]) + 1, dtype=np.int64)
    for batch in batches:
        for row, end, data, offsets in bh.text_slices(batch.column(0)):
            word, first = _numbered(data, offsets)
            text = np.repeat(np.arange(end - row), np.diff(first))
            pair = np.unique(text[word >= 0] * len(total) + word[word >= 0])
            total[:-1] += np.bincount(pair % len(total), minlength=len(total))[:-1]
            total[-1] += end - row
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((np.arange(len(total) - 1), [-1]))), pa.array(total)], names=["word", "n"])


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """IDF of every licence word over all texts; the driver receives a number a vocabulary word."""
    parts = docs.select(named(text).cast("string").alias("text")).mapInArrow(_frequency_task, "word long, n long")
    counts = {r.word: r.n for r in parts.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    words = range(len(_vocabulary()[0]))
    return np.array([np.log((1 + counts.get(-1, 0)) / (1 + counts.get(w, 0))) for w in words])


class Index:
    """Templates as rows of word numbers and weights, and by rank of rarity the postings (template, place) of their words."""

    def __init__(self, known: list[Template], idf: np.ndarray) -> None:
        self.known = known
        self.length = np.array([len(t.words) for t in known])
        self.key = np.array([t.key for t in known])
        self.base = np.array([t.base for t in known])
        self.words = np.full((len(known), self.length.max()), -2)
        self.weight = np.zeros(self.words.shape)
        ranks: list[list[tuple[int, int, int]]] = [[] for _ in range(POSTED)]
        for i, t in enumerate(known):
            self.words[i, : len(t.words)] = t.words
            w = np.maximum(idf[t.words], 1e-6)
            self.weight[i, : len(w)] = w / w.sum()
            places = np.arange(*t.key)
            rarest = places[np.argsort(-idf[t.words[places]], kind="stable")]
            for rank, place in enumerate(rarest[:POSTED]):
                ranks[rank].append((int(t.words[place]), i, int(place)))
        self.posted = np.minimum(self.key[:, 1] - self.key[:, 0], POSTED)
        # Postings of each rank by word; none under the last number, which is -1 from the end.
        self.ranks = [(np.searchsorted([p[0] for p in sorted(posted)], np.arange(len(idf) + 2)), *np.array(sorted(posted)).T[1:]) for posted in ranks]

    def proposals(self, word: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Template and start of each place where all posted words of a template agree.

        A text's words of the highest IDF are looked up first; lists of lower ranks are read only for the texts left,
        and each is intersected with what is left by template and relative place.
        """
        most = int(self.length.max())
        wide = len(word) + 2 * most
        live, of = None, np.ones(int(text.max(initial=-1)) + 1, dtype=bool)
        for rank, (first, template, place) in enumerate(self.ranks):
            n = np.where(of[text], (first[1:] - first[:-1])[word], 0)
            at = np.flatnonzero(n)
            n = n[at]
            post = np.repeat(first[word[at]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            found = template[post] * wide + np.repeat(at, n) - place[post] + most
            if live is None:
                live = np.sort(found)
            else:
                short = self.posted[live // wide] <= rank
                live = np.sort(np.concatenate((live[short], np.intersect1d(live[~short], found, assume_unique=True))))
            if not len(live):
                break
            of[:] = False
            start = live % wide - most + self.key[live // wide, 0]
            of[text[np.clip(start, 0, len(text) - 1)]] = True
        return live // wide, live % wide - most

    def matches(self, word: np.ndarray, text: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Template, text and start of each match in a slice, and the share of the template's weight that stands there."""
        t, start = self.proposals(word, text)
        a, b = self.key[t].T
        good = (start + a >= 0) & (start + b <= len(word))
        t, start, a, b = t[good], start[good], a[good], b[good]
        good = text[start + a] == text[start + b - 1]
        for d in range(int((self.key[:, 1] - self.key[:, 0]).max())):
            p = np.minimum(a + d, b - 1)
            good &= word[start + p] == self.words[t, p]
        t, start, home = t[good], start[good], text[start[good] + a[good]]
        share = np.zeros(len(t))
        for d in range(self.words.shape[1]):
            inside = (start + d >= first[home]) & (start + d < first[home + 1])
            share += self.weight[t, d] * (inside & (word[np.clip(start + d, 0, max(0, len(word) - 1))] == self.words[t, d]))
        good = self.base[t] | (share >= LEAST_SHARE)
        return t[good], home[good], start[good] - first[home[good]], np.where(self.base[t], 1.0, share)[good]


def _scan_task(idf: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates(), idf)
        for batch in batches:
            for row, end, data, offsets in bh.text_slices(batch.column(0)):
                n = end - row
                word, first = _numbered(data, offsets)
                text = np.repeat(np.arange(n), np.diff(first))
                t, of, start, share = index.matches(word, text, first)
                base = index.base[t]
                count, score = np.bincount(of[base], minlength=n), np.zeros(n)
                low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                np.maximum.at(score, of, share)
                np.minimum.at(low, of[base], start[base])
                np.maximum.at(high, of[base], start[base])
                labels: list[set[str]] = [set() for _ in range(n)]
                base_labels: list[set[str]] = [set() for _ in range(n)]
                for i, k in zip(*np.unique(np.column_stack((of, t)), axis=0).T, strict=True):
                    labels[i].add(index.known[k].label)
                    if index.base[k]:
                        base_labels[i].add(index.known[k].label)
                none = count == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).slice(row, n),
                        pa.array(np.diff(first).astype(np.int64)),
                        pa.array(count.astype(np.int64)),
                        pa.array(low, mask=none),
                        pa.array(high.astype(np.int64), mask=none),
                        pa.array([",".join(sorted(x)) for x in base_labels], pa.string()),
                        pa.array([",".join(sorted(x)) for x in labels], pa.string()),
                        pa.array(np.clip(score, 0, 1)),
                    ],
                    names=["row", *RESULT],
                )

    return run


RESULT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels and score.

    Words are runs of 0-9, a-z and non-ASCII characters after A-Z is lower-cased.  n_base counts all places where a base
    phrase stands, first_word and last_word are the least and greatest of their starts.  labels adds the notices found:
    key phrase whole, and words of at least LEAST_SHARE of the notice's IDF weight at their relative places; score is
    the largest such share (1 for a base phrase, 0 for nothing).  A null text is empty: no words, empty labels, null
    places.  Repeated rows count in the word frequencies like any; an empty table stays empty; columns of docs named
    like a result column are replaced.
    """
    small_batches(docs.sparkSession)
    idf = rarity(docs, text)
    keep = [c for c in docs.columns if c not in RESULT]
    rows = docs.select(named(text).cast("string").alias("text"), row_of(docs, keep))
    kinds = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    out = rows.mapInArrow(_scan_task(idf), with_row(rows.schema["row"].dataType, kinds))
    return out.select(*[field(c) for c in keep], *RESULT)
