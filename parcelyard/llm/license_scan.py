"""License notices in documents: set phrases, and blocks that contain a template.

A block is a stretch of words. For templates of up to S words (S a power of two) blocks
are 2 S words long and begin at every S-th word, so whatever run of S words holds a
notice, one block holds the run, across lines or within a long one. A block contains
a template if it has at least ``THRESHOLD`` of the template's distinct words.

All such pairs are found by an exact set-similarity join. Words are ordered by their
number in all documents, the rarest first, and sets are kept in that order. To share
``need`` words with a template of n, a block of m must share one within its first
m - need + 1 and the template's first n - need + 1 (prefix filter), have ``need`` words
(length filter), and have enough left at the place where they meet (positional filter).
Words that no template has cannot be shared and are left out from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelyard.llm.store import stored
from parcelyard.llm.words import ALNUM, Words, among, words_of

THRESHOLD = 0.8
# The shortest blocks, in words, are twice this.
LEAST_STEP = 16
# Words of all templates together: what is sent to every task.
MAX_TEMPLATE_WORDS = 2_000_000

# Phrases of the contract, and openings of well-known notices.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
TEMPLATES = (
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    (
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
        "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
        "MPL was not distributed with this file, You can obtain one at",
    ),
    ("creative-commons", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
)

ROWS = (
    "row long, doc_id {id}, n_words long, n_base long, first_word long, last_word long, "
    "base array<string>, blocks array<struct<step:int,number:int,words:array<int>>>"
)


@dataclass(frozen=True)
class Template:
    """A template's label, its distinct words' codes, and the step of its blocks."""

    label: str
    codes: np.ndarray
    step: int

    @property
    def need(self) -> int:
        # Whole words: 0.8 of 5 is 4, whatever the floating point says.
        return max(1, math.ceil(THRESHOLD * len(self.codes) - 1e-9))


def word_codes(text: str) -> np.ndarray:
    return np.concatenate([part.codes for part in words_of(pa.array([text]), ALNUM)])


def read_templates(templates: Sequence[tuple[str, str]]) -> list[Template]:
    """Templates with words; those without match nothing."""
    found = []
    for label, text in templates:
        codes = word_codes(text)
        if len(codes):
            step = max(LEAST_STEP, 1 << (len(codes) - 1).bit_length())
            found.append(Template(label, np.unique(codes), step))
    total = sum(len(t.codes) for t in found)
    if total > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates of {total} words; scan them in parts of at most {MAX_TEMPLATE_WORDS}")
    return found


def _word_counts(docs: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """How often each of the sorted ``wanted`` codes stands in all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for part in words_of(batch.column(0), ALNUM):
                found = part.codes[among(part.codes, sent.value)]
                n += np.bincount(np.searchsorted(sent.value, found), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["word", "n"])

    counted = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    out = np.zeros(len(wanted), np.int64)
    for r in counted.collect():  # at most one row per template word
        out[r["word"]] = r["n"]
    return out


def _phrase_places(words: Words, codes: np.ndarray) -> np.ndarray:
    """Where a phrase's words stand one after another within one text."""
    last = len(words.codes) - len(codes)
    if last < 0:
        return np.empty(0, np.int64)
    at = np.flatnonzero(words.codes[: last + 1] == codes[0])
    for k in range(1, len(codes)):
        at = at[words.codes[at + k] == codes[k]]
    text = np.searchsorted(words.first, at, side="right")
    return at[text == np.searchsorted(words.first, at + len(codes) - 1, side="right")]


def _blocks(words: Words, places: np.ndarray, ranks: np.ndarray, least: dict[int, int]) -> list[list[dict]]:
    """Per text its blocks with enough template words: step, number, ranks from the rarest."""
    out: list[list[dict]] = [[] for _ in range(words.texts)]
    text = np.searchsorted(words.first, places, side="right") - 1
    place = places - words.first[text]
    for step, need in least.items():
        block = place // step
        both = [(text, block, ranks), (text[block > 0], block[block > 0] - 1, ranks[block > 0])]
        t, b, r = (np.concatenate(x) for x in zip(*both))
        order = np.lexsort((r, b, t))
        t, b, r = t[order], b[order], r[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (b[1:] != b[:-1])
        fresh = new.copy()
        fresh[1:] |= r[1:] != r[:-1]
        t, b, r, new = t[fresh], b[fresh], r[fresh], new[fresh]
        cuts = np.append(np.flatnonzero(new), len(t))
        for i in np.flatnonzero(np.diff(cuts) >= need):
            at = cuts[i]
            out[t[at]].append({"step": step, "number": int(b[at]), "words": r[at : cuts[i + 1]].tolist()})
    return out


def _scanned(docs: DataFrame, phrases: Sequence[tuple[str, str]], templates: list[Template]) -> tuple[DataFrame, dict]:
    """A row per document with the places of phrases and its blocks, and each word's rank."""
    known = np.unique(np.concatenate([t.codes for t in templates])) if templates else np.empty(0, np.uint64)
    counts = _word_counts(docs, known)
    order = np.lexsort((known, counts))
    rank_of = np.empty(len(known), np.int64)
    rank_of[order] = np.arange(len(known))
    least: dict[int, int] = {}
    for t in templates:
        least[t.step] = min(t.need, least.get(t.step, t.need))
    sought = [(word_codes(text), label) for text, label in phrases]
    sent = docs.sparkSession.sparkContext.broadcast((known, rank_of, least, sought))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, rank_of, least, sought = sent.value
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in words_of(batch.column(1), ALNUM):
                places = among(part.codes, known)
                ranks = rank_of[np.searchsorted(known, part.codes[places])]
                hits = [(at, label) for codes, label in sought for at in _phrase_places(part, codes).tolist()]
                per_text: dict[int, list] = {}
                for at, label in hits:
                    t = int(np.searchsorted(part.first, at, side="right")) - 1
                    per_text.setdefault(t, []).append((at - int(part.first[t]), label))
                found = [per_text.get(t, []) for t in range(part.texts)]
                columns = [
                    pa.array(np.arange(number, number + part.texts)),
                    batch.column(0).slice(part.row, part.texts),
                    pa.array(np.diff(part.first).astype(np.int64)),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([min(f)[0] if f else None for f in found], pa.int64()),
                    pa.array([max(f)[0] if f else None for f in found], pa.int64()),
                    pa.array([sorted({x[1] for x in f}) for f in found], pa.list_(pa.string())),
                    pa.array(_blocks(part, places, ranks, least), _BLOCKS),
                ]
                number += part.texts
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ROWS.format(id=docs.schema["doc_id"].dataType.simpleString())
    names = [c.split()[0] for c in schema.split(", ")]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    return stored(rows, "licenses"), {int(c): int(r) for c, r in zip(known, rank_of)}


_BLOCKS = pa.list_(pa.struct([("step", pa.int32()), ("number", pa.int32()), ("words", pa.list_(pa.int32()))]))


def matches(rows: DataFrame, templates: list[Template], ranks: dict[int, int]) -> DataFrame:
    """``row``, ``step``, ``number`` (the block's), ``label`` and ``contained`` of all blocks
    that hold at least ``THRESHOLD`` of a template; a pair may come more than once."""
    sets = [(t.label, t.step, t.need, sorted(ranks[int(c)] for c in t.codes)) for t in templates]
    wanted = rows.sparkSession.createDataFrame(sets, "label string, step int, need int, theirs array<int>")
    least = wanted.groupBy("step").agg(F.min("need").alias("least"))
    begin = F.slice("theirs", 1, F.size("theirs") - F.col("need") + 1)
    wanted = wanted.select("*", F.posexplode(begin).alias("j", "word"))
    blocks = rows.select("row", F.explode("blocks").alias("b")).select("row", "b.step", "b.number", "b.words")
    begin = F.slice("words", 1, F.size("words") - F.col("least") + 1)
    blocks = blocks.join(least, "step").select(
        "row", "step", "number", "words", F.posexplode(begin).alias("i", "word")
    )
    # Words that both may share before the place where they meet, there, and after it.
    room = F.least("i", "j") + 1 + F.least(F.size("words") - F.col("i") - 1, F.size("theirs") - F.col("j") - 1)
    pairs = blocks.join(wanted, ["step", "word"]).where(F.size("words") >= F.col("need")).where(room >= F.col("need"))
    shared = F.size(F.array_intersect("words", "theirs"))
    return pairs.where(shared >= F.col("need")).select(
        "row", "step", "number", "label", (shared / F.size("theirs")).alias("contained")
    )


def scan(
    docs: DataFrame,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``) what licenses its text names.

    ``n_words``; ``n_base``, ``first_word`` and ``last_word``: how often a phrase stands in
    the text and the first and last place of one, in words; ``base``: the phrases' labels;
    ``labels``: these and the labels of templates that a block of the text contains, both
    sorted; ``score``: 1 where a phrase stands, else the largest share of a template in a
    block that passes, else 0.

    Repeated rows and null ids give a row each. A null text is empty. Other columns are
    ignored. An empty table gives an empty result.
    """
    read = read_templates(templates)
    rows, ranks = _scanned(docs.select("doc_id", "text"), phrases, read)
    found = matches(rows, read, ranks).groupBy("row").agg(
        F.collect_set("label").alias("more"), F.max("contained").alias("contained")
    )
    none = F.array().cast("array<string>")
    return rows.join(found, "row", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        "base",
        F.array_sort(F.array_union("base", F.coalesce("more", none))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("contained", F.lit(0.0))).alias("score"),
    )
