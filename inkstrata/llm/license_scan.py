"""License scan by an exact set-similarity join between text blocks and license templates.

A block is a line; a longer one is cut into windows of `WINDOW` words that overlap by half. The words of the whole text,
line ends ignored, are cut into such windows, too, so every passage of up to half a window lies whole in one block, also
where a notice is wrapped over several lines. A block matches a template when it holds at least `threshold` of its distinct
words. The words of templates are ordered by their frequency in the whole corpus, rarest first:

* prefix filter: a match holds one of the first |t| - need + 1 words of its template, and only these are indexed;
* length filter: a block with fewer distinct words than needed is no candidate;
* positional filter: the rarest shared word at place i of a template leaves at most |t| - i shared words.

What is left is verified on the full sets, so the join is exact. Templates are fixed; their size does not grow with data.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, in_slices

#: Phrases of the base scan and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Labels and the characteristic sentence of each license or notice.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "Released under the MIT License",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "public-domain": "This is free and unencumbered software released into the public domain",
}
WINDOW = 64
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


class Index:
    """Templates by the words of their prefixes, in the global order."""

    def __init__(self, templates: dict[str, str], frequency: dict[bytes, int], threshold: float):
        self.by_word: dict[bytes, list[tuple[str, int]]] = {}
        self.words: dict[str, frozenset[bytes]] = {}
        self.need: dict[str, int] = {}
        for label, text in templates.items():
            order = sorted(set(ascii_words(text.encode())), key=lambda w: (frequency.get(w, 0), w))
            self.words[label], self.need[label] = frozenset(order), max(1, math.ceil(threshold * len(order) - 1e-9))
            for i, w in enumerate(order[: len(order) - self.need[label] + 1]):
                self.by_word.setdefault(w, []).append((label, i))
        self.indexed = frozenset(self.by_word)

    def matches(self, block: list[bytes]) -> Iterator[tuple[str, float]]:
        words = set(block)
        rarest: dict[str, int] = {}
        for w in words & self.indexed:
            for label, i in self.by_word[w]:
                rarest[label] = min(i, rarest.get(label, i))
        for label, i in rarest.items():
            template, need = self.words[label], self.need[label]
            if len(words) >= need and len(template) - i >= need and (shared := len(words & template)) >= need:
                yield label, shared / len(template)


def windows(words: list[bytes]) -> Iterator[list[bytes]]:
    for at in range(0, max(1, len(words) - WINDOW // 2), WINDOW // 2):
        yield words[at : at + WINDOW]


def blocks(text: bytes) -> Iterator[list[bytes]]:
    lines = text.split(b"\n")
    for line in lines:
        yield from windows(ascii_words(line))
    if len(lines) > 1:
        yield from windows(ascii_words(text))


def phrase_places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    found, at = [], -1
    try:
        while True:
            at = words.index(phrase[0], at + 1)
            if words[at : at + len(phrase)] == phrase:
                found.append(at)
    except ValueError:
        return found


def scan(documents: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8, phrases: dict[str, str] | None = None) -> DataFrame:
    """One row a document: words, places of the base phrases, their labels, and those that the similarity join adds.

    score: 1 where a base phrase stands, else the best containment of a matching template, else 0. Null and empty texts
    have no words, null places, empty labels and score 0. Repeated rows and null ids keep a row each, ties between
    templates keep every label, an empty table gives an empty result, other columns are not read.
    """
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    texts = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    vocabulary = frozenset(w for t in templates.values() for w in ascii_words(t.encode()))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in in_slices(batches):
            for text in b.column(0):
                seen.update(filter(vocabulary.__contains__, ascii_words(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    # At most as many rows as templates have words.
    counted = texts.select("text").mapInArrow(frequencies, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    index = Index(templates, {bytes(r.word): r.n for r in counted}, threshold)
    base = [([w.encode() for w in p.split()], label) for p, label in phrases.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            rows = []
            for text in b.column(1).to_pylist():
                words = ascii_words(text)
                there = set(words)
                places, own, score = [], set(), 0.0
                for phrase, label in base:
                    if there.issuperset(phrase) and (at := phrase_places(words, phrase)):
                        places += at
                        own.add(label)
                labels = set(own)
                if not index.indexed.isdisjoint(there):
                    for block in blocks(text):
                        if not index.indexed.isdisjoint(block):
                            for label, share in index.matches(block):
                                labels.add(label)
                                score = max(score, share)
                rows.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(own)), ",".join(sorted(labels)), 1.0 if own else score))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], [f.split()[0] for f in SCHEMA.split(", ")])

    return texts.mapInArrow(run, SCHEMA)
