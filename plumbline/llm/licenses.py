"""License scans by a positional index of rare licence words.

Templates are known notices; words are runs of letters and digits, A-Z lower-cased. The index
holds, for every licence word, the templates and positions where it stands. Words weigh by inverse
document frequency over all documents. A file's rarest words of each template are looked up: those
that weigh more than the quarter of the template which a match may lack, so one of them stands in
every match. Each place of such a word and its position in the template give an alignment. At the
alignments the postings of all words are intersected by relative position, and a template is found
where the words in place weigh 75 % of it or more and its mandatory key phrases stand there. Base
phrases are templates of which every word must be in place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import _LOWER, SLICE_BYTES, _hash_words, text_slices
from plumbline.session import bounded_batches

#: Words by which a word may be away from its place in an alignment, to either side.
SLACK = 2
#: A match holds so many hundredths of a template's weight.
SHARE = 75
#: The most words of all templates together; the index goes to every task.
MOST_WORDS = 1_000_000
#: Alignments times template words that one step looks at.
STEP = 1 << 18

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass(frozen=True)
class Template:
    """A notice's words, the label that it gives, and the phrases that must stand in a match."""

    label: str
    text: str
    must: tuple[str, ...]


# Base phrases with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Usual notices, lower-cased and without punctuation.
TEMPLATES = (
    Template("agpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ("gnu affero general public license", "version 3")),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    Template("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    Template("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "version 2")),
    Template("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3")),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    Template("mit-notice", "released under the mit license", ("mit license",)),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("free of charge", "associated documentation files")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license", "v 2 0")),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("public domain",)),
)


def vocabulary(templates: tuple[Template, ...], base: dict[str, str]) -> list[str]:
    """The distinct words of all templates and phrases, sorted."""
    texts = [*base, *[t.text for t in templates], *[p for t in templates for p in t.must]]
    found = sorted({w for text in texts for w in text.split()})
    if len(found) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} licence words")
    return found


class Words:
    """Finds the words of a vocabulary in slices of texts; words are compared by 64 bits of their bytes' hash."""

    def __init__(self, words: list[str]):
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(w) for w in raw])
        buffer = np.frombuffer(b"".join(raw), np.uint8)
        hashes = _hash_words(buffer, ends - [len(w) for w in raw], ends, 1)[0] if raw else np.zeros(0, np.uint64)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.longest = max(map(len, raw), default=0)

    def _piece(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the word in the vocabulary or -1, first byte) of every word of lower-cased bytes."""
        word = np.zeros(len(part) + 2, np.int8)
        word[1:-1] = _WORD[part]
        step = np.diff(word)
        start, stop = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        out = np.full(len(start), -1, np.int32)
        short = np.flatnonzero(stop - start <= self.longest)
        if len(short) and len(self.sorted):
            hashes = _hash_words(part, start[short], stop[short], 1)[0]
            at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
            hit = self.sorted[at] == hashes
            out[short[hit]] = self.order[at[hit]]
        return out, start

    def of(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vocabulary numbers (-1: other) of all words of a slice's rows, and each row's first word (with the end)."""
        rows = len(offsets) - 1
        cuts = np.full(len(raw) + rows, 0x20, np.uint8)
        cuts[np.arange(len(raw)) + np.repeat(np.arange(rows), np.diff(offsets))] = _LOWER[raw]
        found, starts, at = [], [], 0
        while at < len(cuts):
            end = min(len(cuts), at + SLICE_BYTES)
            while end < len(cuts) and _WORD[cuts[end]]:  # a long text is cut where no word is
                more = np.flatnonzero(~_WORD[cuts[end : end + 4096]])
                end = end + int(more[0]) if len(more) else min(len(cuts), end + 4096)
            vids, start = self._piece(cuts[at:end])
            found.append(vids)
            starts.append(start + at)
            at = end
        if not found:
            return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
        return np.concatenate(found), np.searchsorted(np.concatenate(starts), offsets + np.arange(rows + 1))


def _counts(words: list[str]):
    """(word, df) of a partition: in how many documents each licence word stands; a null word counts the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, df, docs = Words(words), np.zeros(len(words), np.int64), 0
        for batch in batches:
            for low, high, raw, offsets in text_slices(batch.column("text")):
                vids, bounds = finder.of(raw, offsets)
                row = np.repeat(np.arange(high - low), np.diff(bounds))[vids >= 0]
                seen = np.unique(row * max(1, len(words)) + vids[vids >= 0])
                df += np.bincount(seen % max(1, len(words)), minlength=len(words))
                docs += high - low
        yield pa.RecordBatch.from_arrays([pa.array([*words, None], pa.string()), pa.array([*df.tolist(), docs], pa.int64())], ["word", "df"])

    return run


def word_weights(docs: DataFrame, words: list[str], text_col: str = "text") -> dict[str, int]:
    """Inverse document frequencies over all documents, in thousandths and 1 at least; a number a licence word comes to the driver."""
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    found = {r.word: r.df for r in texts.mapInArrow(_counts(words), "word string, df long").groupBy("word").agg(F.sum("df").alias("df")).collect()}
    docs_n = found.get(None, 0)
    return {w: max(1, round(1000 * math.log(1 + docs_n / (1 + found.get(w, 0))))) for w in words}


class LicenseIndex:
    """Templates by positions of their words, with the words' weights."""

    def __init__(self, weights: dict[str, int], templates: tuple[Template, ...] = TEMPLATES, base: dict[str, str] = BASE):
        self.words = vocabulary(templates, base)
        self.finder = Words(self.words)
        self.number = {w: i for i, w in enumerate(self.words)}
        self.weights = weights
        self.base = [(label, self._phrase(phrase)) for phrase, label in base.items()]
        self.templates = []
        for t in templates:
            ids = np.array([self.number[w] for w in t.text.split()], np.int32)
            weight = np.array([weights[w] for w in t.text.split()], np.int64)
            self.templates.append((t.label, ids, weight, self._rarest(t.text.split()), [self._phrase(p) for p in t.must]))

    def _phrase(self, phrase: str) -> list[tuple[int, int]]:
        """(position, word) of a phrase, the rarest word first."""
        words = phrase.split()
        order = sorted(range(len(words)), key=lambda q: (-self.weights[words[q]], q))
        return [(q, self.number[words[q]]) for q in order]

    def _rarest(self, words: list[str]) -> list[int]:
        """Positions of the rarest words that together weigh more than a match may lack: one is in place in every match."""
        total, out, sum_of = sum(self.weights[w] for w in words), [], 0
        for q in sorted(range(len(words)), key=lambda q: (-self.weights[words[q]], q)):
            if 100 * sum_of > (100 - SHARE) * total:
                break
            out.append(q)
            sum_of += self.weights[words[q]]
        return out

    def scan(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[str, np.ndarray]], list[tuple[str, np.ndarray, np.ndarray]], np.ndarray]:
        """Word bounds of a slice's rows; (label, starts) of base phrases; (label, rows, shares) of templates found."""
        vids, bounds = self.finder.of(raw, offsets)
        hits = np.flatnonzero(vids >= 0)
        hits = hits[np.argsort(vids[hits], kind="stable")]
        edges = np.searchsorted(vids[hits], np.arange(len(self.words) + 1))
        places = lambda word: hits[edges[word] : edges[word + 1]]
        known: dict[tuple, np.ndarray] = {}

        def phrase(rarest: list[tuple[int, int]]) -> np.ndarray:
            """Starts of all places where a phrase's words stand consecutively in a row."""
            key = tuple(rarest)
            if key not in known:
                first, word = rarest[0]
                start = places(word) - first
                row = np.searchsorted(bounds, start + first, "right") - 1
                start = start[(start >= bounds[row]) & (start + len(rarest) <= bounds[row + 1])]
                for q, word in rarest[1:]:
                    start = start[vids[start + q] == word]
                known[key] = start
            return known[key]

        base = [(label, phrase(rarest)) for label, rarest in self.base]
        found = []
        for label, ids, weight, rarest, must in self.templates:
            must_at = [(phrase(p), len(p)) for p in must]
            if not all(len(at) for at, _ in must_at):
                continue
            at = [(places(ids[q]), q) for q in rarest]
            pairs = [(np.searchsorted(bounds, p, "right") - 1, p - q - e) for p, q in at if len(p) for e in range(-SLACK, SLACK + 1)]
            if not pairs:
                continue
            row, start = (np.concatenate(x) for x in zip(*pairs, strict=True))
            row, start = np.unique(np.stack([row, start]), axis=1)
            kept = [self._weigh(vids, bounds, row[i : i + step], start[i : i + step], ids, weight) for step in [max(1, STEP // len(ids))] for i in range(0, len(row), step)]
            weighs = np.concatenate(kept)
            good = 100 * weighs >= SHARE * int(weight.sum())
            for at_phrase, size in must_at:
                low = np.maximum(start - SLACK, bounds[row])
                high = np.minimum(start + len(ids) + SLACK, bounds[row + 1]) - size
                i = np.searchsorted(at_phrase, low)
                good &= (i < len(at_phrase)) & (at_phrase[np.minimum(i, len(at_phrase) - 1)] <= high)
            if good.any():
                found.append((label, row[good], weighs[good] / int(weight.sum())))
        return vids, base, found, bounds

    @staticmethod
    def _weigh(vids: np.ndarray, bounds: np.ndarray, row: np.ndarray, start: np.ndarray, ids: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Weight of the template's words in place at each alignment."""
        low, high = bounds[row][:, None], bounds[row + 1][:, None]
        there = np.zeros((len(row), len(ids)), bool)
        for e in range(-SLACK, SLACK + 1):
            at = start[:, None] + np.arange(len(ids)) + e
            there |= (at >= low) & (at < high) & (vids[np.clip(at, 0, len(vids) - 1)] == ids)
        return there @ weight


def _scan(index: LicenseIndex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, raw, offsets in text_slices(batch.column("text")):
                _, base, found, bounds = index.scan(raw, offsets)
                n = high - low
                n_base = np.zeros(n, np.int64)
                first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                score = np.zeros(n)
                of_base: dict[int, set[str]] = {}
                own: dict[int, set[str]] = {}
                for label, start in base:
                    row = np.searchsorted(bounds, start, "right") - 1
                    np.add.at(n_base, row, 1)
                    np.minimum.at(first, row, start - bounds[row])
                    np.maximum.at(last, row, start - bounds[row])
                    score[row] = 1.0
                    for r in np.unique(row).tolist():
                        of_base.setdefault(r, set()).add(label)
                for label, row, share in found:
                    np.maximum.at(score, row, share)
                    for r in np.unique(row).tolist():
                        own.setdefault(r, set()).add(label)
                none = n_base == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(low, n),
                        pa.array(np.diff(bounds).astype(np.int64)),
                        pa.array(n_base),
                        pa.array(first, pa.int64(), mask=none),
                        pa.array(last, pa.int64(), mask=none),
                        pa.array([",".join(sorted(of_base.get(r, ()))) for r in range(n)], pa.string()),
                        pa.array([",".join(sorted(of_base.get(r, set()) | own.get(r, set()))) for r in range(n)], pa.string()),
                        pa.array(score),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    return run


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, base: dict[str, str] = BASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row per input row.

    ``n_base`` counts all places of the base phrases, ``first_word`` and ``last_word`` are the least and
    greatest of their starts (words from 0; null without any). ``base_labels`` are the labels of the
    phrases, ``labels`` those and the templates' (distinct, sorted, joined by commas). ``score`` is the
    largest share of a found template's weight in place (1 for a base phrase, 0 if nothing is found).

    Whole texts are scanned, also very long ones: four bytes a word and a slice's bytes are held. Null and empty texts have no
    words. Repeated rows and null ids are returned as they come; other columns, whatever their names,
    are ignored. Alignments that tie count once. An empty table gives no rows. The documents are read
    twice, for the frequencies and for the scan, and never shuffled.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    bounded_batches(docs.sparkSession)
    index = LicenseIndex(word_weights(docs, vocabulary(templates, base)), templates, base)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.mapInArrow(_scan(index), schema)
