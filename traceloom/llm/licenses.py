"""License texts found by diagonal voting.

Every rolling k-word hash of the documents is joined with the places it has in
the templates. Hits of one document and template with equal offset lie on a
diagonal; votes are counted per diagonal, neighbouring diagonals (a few words
put in or left out) are merged, and the span is verified by how much of the
template it covers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.llm import words as W

K = 4
#: Diagonals at most this far apart, one after the other, are one span.
SHIFT = 3
#: Share of a template's k-grams that a span must hold.
LEAST = 0.6
#: Template k-grams up to this number are broadcast (about 50 bytes each), more are joined by a shuffle.
BROADCAST_GRAMS = 100_000
#: What tells texts apart: 128 bits of hashes.
KEY, KEYS = ["h1", "h2"], "h1 BIGINT, h2 BIGINT"

#: Phrase and label of the base places.
PHRASES: tuple[tuple[str, str], ...] = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

#: Label and wording of public license notices.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so",
    ),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    (
        "cc-by-nc",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


def _hashed(text: str) -> tuple[W.Words, np.ndarray]:
    data, offsets = W.texts(pa.array([text]))
    words = W.split(data, offsets, W.PUNCTUATION)
    return words, words.hashes(lower=True)


def _phrase_hash(text: str) -> tuple[int, np.uint64]:
    words, hashes = _hashed(text)
    return len(words), words.windows(hashes, len(words))[1][0]


def base_places(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """`doc_id, h1, h2, n_words, n_base, first_word, last_word, base` of each row: exact places of phrases."""
    wanted = [(*_phrase_hash(text), label) for text, label in phrases]
    schema = f"doc_id BIGINT, {KEYS}, n_words BIGINT, n_base BIGINT, first_word BIGINT, last_word BIGINT, base ARRAY<STRING>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_base = np.zeros((2, batch.num_rows), np.int64)
            first = np.full(batch.num_rows, np.iinfo(np.int64).max)
            last = np.full(batch.num_rows, -1)
            labels: list[list[str]] = [[] for _ in range(batch.num_rows)]
            for low, high, data, offsets in W.blocks(batch.column(3)):
                words = W.split(data, offsets, W.PUNCTUATION)
                n_words[low:high] = words.per_doc()
                hashes = words.hashes(lower=True)
                grams = {k: words.windows(hashes, k) for k in {k for k, _, _ in wanted}}
                for k, value, label in wanted:
                    at, found = grams[k]
                    at = at[found == value]
                    doc = np.searchsorted(words.first, at, "right") - 1
                    place = at - words.first[doc]
                    np.add.at(n_base, low + doc, 1)
                    np.minimum.at(first, low + doc, place)
                    np.maximum.at(last, low + doc, place)
                    for d in np.unique(doc):
                        labels[low + d].append(label)
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array(n_words),
                    pa.array(n_base),
                    pa.array(first, mask=none),
                    pa.array(last, mask=none),
                    pa.array(labels, pa.list_(pa.string())),
                ],
                ["doc_id", *KEY, "n_words", "n_base", "first_word", "last_word", "base"],
            )

    return _keyed(docs).mapInArrow(run, schema)


def _keyed(docs: DataFrame) -> DataFrame:
    """`doc_id, h1, h2, text`: rows with what tells their texts apart, whatever their ids."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text")
    )


def word_grams(docs: DataFrame, k: int = K) -> DataFrame:
    """`h1, h2, at, gram`: the hash of every k consecutive words, of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, _, data, offsets in W.blocks(batch.column(2)):
                words = W.split(data, offsets, W.PUNCTUATION)
                at, grams = words.windows(words.hashes(lower=True), k)
                doc = np.searchsorted(words.first, at, "right") - 1
                for i in range(0, len(at), 100_000):
                    part = slice(i, i + 100_000)
                    of = pa.array(low + doc[part])
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(column.take(of) for column in batch.columns[:2]),
                            pa.array(at[part] - words.first[doc[part]]),
                            pa.array(W.signed(grams[part])),
                        ],
                        [*KEY, "at", "gram"],
                    )

    return _keyed(docs).drop("doc_id").mapInArrow(run, f"{KEYS}, at BIGINT, gram BIGINT")


def _text_spans(docs: DataFrame, templates: Sequence[tuple[str, str]], k: int) -> DataFrame:
    """`h1, h2, template, label, first_word, last_word, share`: verified places of templates in each text.

    A place of a template counts once, however many rows hold the text and
    however often its k-gram stands in the span.
    """
    rows = []
    for t, (label, text) in enumerate(templates):
        words, hashes = _hashed(text)
        at, grams = words.windows(hashes, k)
        rows += [(t, label, int(a), len(at), int(g)) for a, g in zip(at, W.signed(grams), strict=True)]
    places = docs.sparkSession.createDataFrame(rows, "template INT, label STRING, place BIGINT, size BIGINT, gram BIGINT")
    if len(rows) <= BROADCAST_GRAMS:
        places = F.broadcast(places)
    of = [*KEY, "template", "label", "size"]
    hits = word_grams(docs, k).join(places, "gram").select(*of, "at", "place").distinct()
    hits = hits.withColumn("diagonal", F.col("at") - F.col("place"))
    diagonals = hits.groupBy(*of, "diagonal").agg(
        F.min("at").alias("low"), F.max("at").alias("high"), F.collect_set("place").alias("places")
    )
    along = Window.partitionBy(*KEY, "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > SHIFT
    numbered = diagonals.withColumn(
        "span", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    )
    # Covered places of the template, which has few.
    ends = numbered.groupBy(*of, "span").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    covered = numbered.select(*of, "span", F.explode("places").alias("place")).groupBy(*of, "span")
    merged = covered.agg(F.count_distinct("place").alias("votes")).join(ends, [*of, "span"])
    return (
        merged.withColumn("share", F.col("votes") / F.col("size"))
        .where((F.col("share") >= LEAST) & (F.col("high") - F.col("low") < 2 * F.col("size") + k))
        .select(
            *KEY, "template", "label", F.col("low").alias("first_word"), (F.col("high") + k - 1).alias("last_word"), "share"
        )
    )


def spans(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, k: int = K) -> DataFrame:
    """`doc_id, template, label, first_word, last_word, share`: verified places of templates, for every row.

    Templates need at least k words. `share` is the share of the template's
    k-grams that the span holds.
    """
    found = _text_spans(docs, templates, k)
    return _keyed(docs).drop("text").join(found, KEY).drop(*KEY)


def scan(docs: DataFrame) -> DataFrame:
    """`doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score` of each row of `docs`.

    Words are runs of digits, letters and characters outside ASCII, with A-Z
    lower-cased. `first_word` and `last_word` are null without a base place;
    labels are empty strings where there is none. The score is 1 with a base
    place, else the share of the best template span, else 0. Every row is judged
    by its own text: repeated rows and rows without an id are rows like others.
    """
    found = (
        _text_spans(docs, TEMPLATES, K)
        .groupBy(*KEY)
        .agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))
    )
    every = F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))
    return base_places(docs).join(found, KEY, "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.sort_array(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.sort_array(every), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
