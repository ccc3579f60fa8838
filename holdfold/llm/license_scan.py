"""Licence scanning with a positional index of rare words.

Templates are licence notices, each with mandatory key phrases.  Their words are weighed
by inverse document frequency over *all* scanned documents (one counting pass; what comes
to the driver is one number per template word).  Of each template, a file's AT_MOST words of
highest weight are looked up in the index of template positions; postings that agree on the
relative position (file position minus template position) vote for an alignment.  One with
VOTES votes, together with those at most SLIP words off it (words were dropped or added
between), names the template if one of its key phrases stands near; a key phrase without such
an alignment names nothing.  A phrase of LONG words or more may lack one of them or have
another in its place; a shorter one must stand unchanged.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased.  The
score is the best share of a template's words at their places in such an alignment, 1 where
a base phrase stands.

Defined results: null and empty texts have no words, no labels and score 0; rows with a
null doc_id and repeated rows each get their row; an empty table gives an empty result;
further columns, whatever their names, are ignored.  Long texts are scanned in pieces; a worker
holds a text and some 60 bytes for each of its words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches
from .textscan import Scan, scan, slices

#: The phrases whose places are counted, with their labels (fixed values).
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Label, key phrases and notice of each template (fixed values: the licences' own public wording).
TEMPLATES = (
    ("agpl", ("gnu affero general public license",), "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache-2", ("apache license version 2",), "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", ("redistribution and use in source and binary forms",), "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", ("creative commons attribution 4 0", "creative commons attribution 3 0", "cc by 4 0", "cc by 3 0"), "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", ("cc by nc", "creative commons attribution noncommercial"), "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", ("cc by sa", "creative commons attribution sharealike"), "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", ("creative commons zero", "cc0 1 0"), "to the extent possible under law the author has waived all copyright and related rights under creative commons zero cc0 1 0 universal"),
    ("gpl", ("gnu general public license",), "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("isc", ("permission to use copy modify and or distribute this software",), "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", ("gnu lesser general public license",), "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", ("under the mit license", "permission is hereby granted free of charge"), "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mpl-2", ("mozilla public license v 2", "mozilla public license version 2"), "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", ("free and unencumbered software",), "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
)

#: Words looked up per file and template, votes that make an alignment, words that a key phrase may be off its place.
AT_MOST, VOTES, NEAR = 12, 4, 8
#: Words by which alignments that belong together may differ, words of a phrase that may lack one.
SLIP, LONG = 3, 6


def hashes(text: str) -> list[int]:
    return scan(pa.array([text])).hash.tolist()


@dataclass
class Rules:
    """Base phrases and templates as word hashes; ``vocabulary`` is sorted."""

    base: list[tuple[list[int], str]]
    templates: list[tuple[str, list[list[int]], list[int]]]
    vocabulary: np.ndarray


def compile_rules(base: Sequence = BASE, templates: Sequence = TEMPLATES) -> Rules:
    b = [(hashes(phrase), label) for phrase, label in base]
    t = [(label, [hashes(p) for p in phrases], hashes(notice)) for label, phrases, notice in templates]
    words = {w for p, _ in b for w in p} | {w for _, phrases, notice in t for p in [*phrases, notice] for w in p}
    return Rules(b, t, np.array(sorted(words), dtype=np.uint64))


def look_up(vocabulary: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places in the vocabulary, -1 for other words."""
    if not len(vocabulary):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    return np.where(vocabulary[at] == h, at, -1)


def document_frequencies(documents: DataFrame, rules: Rules) -> tuple[int, np.ndarray]:
    """Number of documents, and in how many each vocabulary word stands."""
    n_words = len(rules.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_words + 1, dtype=np.int64)
        for batch in batches:
            texts = batch.column(0)
            for a, b in slices(texts):
                s = scan(texts.slice(a, b - a))
                w = look_up(rules.vocabulary, s.hash)
                at = np.flatnonzero(w >= 0)
                pairs = np.unique(s.row[at] * n_words + w[at])
                total[:-1] += np.bincount(pairs % n_words, minlength=n_words)
                total[-1] += b - a
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_words + 1)), pa.array(total)], ["word", "n"])

    out = np.zeros(n_words + 1, dtype=np.int64)
    for r in small_batches(documents).select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r.word] = r.n
    return int(out[-1]), out[:-1]


class Index:
    """Rare-word postings of the templates, and each phrase under its rarest word."""

    def __init__(self, rules: Rules, n: int, df: np.ndarray):
        self.rules = rules
        self.idf = np.log((n + 1) / (df + 1)) + 1
        place = {int(h): k for k, h in enumerate(rules.vocabulary)}
        coded = lambda words: np.array([place[w] for w in words], dtype=np.int64)
        self.base = [(coded(p), label) for p, label in rules.base]
        self.templates = [(label, [coded(p) for p in phrases], coded(notice)) for label, phrases, notice in rules.templates]
        posted = sorted((w, t, pos) for t, (_, _, notice) in enumerate(self.templates) for pos, w in enumerate(notice.tolist()))
        word, self.template, self.offset = np.array(posted, dtype=np.int64).reshape(-1, 3).T
        #: Word w's postings are those from first[w] to first[w + 1].
        self.first = np.searchsorted(word, np.arange(len(rules.vocabulary) + 1))

    def places(self, w: np.ndarray, row: np.ndarray, phrase: np.ndarray) -> np.ndarray:
        """Where the phrase's words stand consecutively in a row; found from its rarest word."""
        k = int(np.argmax(self.idf[phrase]))
        start = np.flatnonzero(w == phrase[k]) - k
        start = start[(start >= 0) & (start + len(phrase) <= len(w))]
        for j, x in enumerate(phrase.tolist()):
            start = start[w[start + j] == x]
        return start[row[start] == row[start + len(phrase) - 1]] if len(start) else start

    def near_places(self, w: np.ndarray, row: np.ndarray, phrase: np.ndarray) -> np.ndarray:
        """Where the phrase stands; one of LONG words or more also with a word lacking, or another in its place."""
        found = [self.places(w, row, phrase)]
        if len(phrase) >= LONG:
            for k in range(len(phrase)):
                without = np.delete(phrase, k)
                found.append(self.places(w, row, without))
                ahead, behind = (self.places(w, row, x) if len(x) else None for x in (phrase[:k], phrase[k + 1 :]))
                if ahead is not None and behind is not None:
                    both = np.intersect1d(ahead, behind - k - 1)
                    found.append(both[row[both] == row[both + len(phrase) - 1]])
        return np.unique(np.concatenate(found))

    def votes(self, w: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, template, start, votes), sorted: where the row's AT_MOST rarest words of a template say that it starts."""
        width, several = len(self.idf), len(self.templates)
        at = np.flatnonzero(w >= 0)
        at = at[self.first[w[at] + 1] > self.first[w[at]]]
        n = self.first[w[at] + 1] - self.first[w[at]]
        p = np.repeat(self.first[w[at]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        at = np.repeat(at, n)
        triple, which = np.unique((row[at] * several + self.template[p]) * width + w[at], return_inverse=True)
        own, word = triple // max(width, 1), triple % max(width, 1)
        order = np.lexsort((word, -self.idf[word], own))
        rank = np.empty(len(triple), dtype=np.int64)
        rank[order] = np.arange(len(triple)) - np.searchsorted(own, own)
        chosen = rank[which] < AT_MOST
        at, p, own = at[chosen], p[chosen], own[which[chosen]]
        longest = max((len(notice) for _, _, notice in self.templates), default=0)
        span = len(w) + longest
        vote, count = np.unique(own * span + at - self.offset[p] + longest, return_counts=True)
        return vote // span // max(several, 1), vote // span % max(several, 1), vote % span - longest, count

    def alignments(self, w: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """(row, template, starts) of each alignment with enough votes and those that belong to it."""
        r, t, start, count = self.votes(w, row)
        for k in np.flatnonzero(count >= VOTES).tolist():
            low, high = max(0, k - 2 * SLIP), k + 2 * SLIP + 1
            near = (r[low:high] == r[k]) & (t[low:high] == t[k]) & (np.abs(start[low:high] - start[k]) <= SLIP) & (count[low:high] >= 2)
            yield int(r[k]), int(t[k]), start[low:high][near].tolist()

    def scan(self, s: Scan) -> dict[str, list]:
        """A column of results for each row."""
        n, w = s.rows, look_up(self.rules.vocabulary, s.hash)
        n_base, first, last = [0] * n, [None] * n, [None] * n
        base_labels, labels, score = [set() for _ in range(n)], [set() for _ in range(n)], [0.0] * n
        for phrase, label in self.base:
            for p in self.places(w, s.row, phrase).tolist():
                r = int(s.row[p])
                at = p - int(s.bounds[r])
                n_base[r] += 1
                first[r] = at if first[r] is None else min(first[r], at)
                last[r] = at if last[r] is None else max(last[r], at)
                base_labels[r].add(label)
                score[r] = 1.0
        key: list[dict[int, list[int]]] = []
        for _, phrases, _ in self.templates:
            found = defaultdict(list)
            for phrase in phrases:
                for p in self.near_places(w, s.row, phrase).tolist():
                    found[int(s.row[p])].append(p)
            key.append(found)
        for r, t, starts in self.alignments(w, s.row):
            notice = self.templates[t][2]
            equal = np.zeros(len(notice), dtype=bool)
            for start in starts:
                lo, hi = max(start, int(s.bounds[r])), min(start + len(notice), int(s.bounds[r + 1]))
                equal[lo - start : hi - start] |= w[lo:hi] == notice[lo - start : hi - start]
            score[r] = max(score[r], float(equal.sum() / len(notice)))
            if any(min(starts) - NEAR <= p < max(starts) + len(notice) + NEAR for p in key[t].get(r, ())):
                labels[r].add(self.templates[t][0])
        return {
            "n_words": np.diff(s.bounds).tolist(),
            "n_base": n_base,
            "first_word": first,
            "last_word": last,
            "base_labels": [",".join(sorted(x)) for x in base_labels],
            "labels": [",".join(sorted(x | y)) for x, y in zip(base_labels, labels, strict=True)],
            "score": score,
        }


RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def judge(documents: DataFrame, base: Sequence = BASE, templates: Sequence = TEMPLATES) -> DataFrame:
    """Per row: doc_id and the columns of :meth:`Index.scan`."""
    rules = compile_rules(base, templates)
    index = Index(rules, *document_frequencies(documents, rules))
    schema = pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in RESULT.split(", ")])
    shared = documents.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts):
                found = shared.value.scan(scan(texts.slice(a, b - a)))
                columns = [ids.slice(a, b - a), *(pa.array(found[f.name], f.type) for f in list(schema)[1:])]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)
