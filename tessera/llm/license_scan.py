"""License scans by diagonal voting.

All rolling word k-grams of all texts are hashed and joined to the template positions that have them.
Every hit votes for its diagonal (text position less template position). Neighbouring diagonals are
merged, since an inserted or dropped word moves the rest by one, and a span counts once enough of the
template's k-grams agree, each by two independent hashes of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import materialise, table
from tessera.llm.shingles import SLICE, bodies, finish, in_chunks, long_word_hashes, rolling, word_hashes

PHRASE_K, TEXT_K = 2, 5
MIN_COVERAGE = 0.75
MAX_DRIFT = 4

# Phrases and the labels they stand for.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Public license notices.
NOTICES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        ' documentation files (the "Software"), to deal in the Software without restriction, including without limitation'
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to"
        " permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright"
        " notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met: Redistributions of source code must retain the above copyright notice, this list of"
        " conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,"
        " this list of conditions and the following disclaimer in the documentation and/or other materials provided with the"
        " distribution."
    ),
    "apache": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with'
        " the License. You may obtain a copy of the License at"
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any"
        " later version."
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        " distributed with this file, You can obtain one at"
    ),
    "cc-by": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
}

# Bytes that are in no word, letters lower-cased already.
_OUTSIDE = np.ones(256, bool)
_OUTSIDE[0x30:0x3A] = _OUTSIDE[0x61:0x7B] = _OUTSIDE[0x80:] = False


_OTHER = np.uint64(0xA24BAED4963EE407)
_KINDS = (PHRASE_K, TEXT_K)


def _gram_hashes(words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every k consecutive words two hashes, of 64 and 32 bits."""
    return rolling(words, k).view(np.int64), rolling(finish(words + _OTHER), k).astype(np.uint32).view(np.int32)


def template_grams(phrases: dict[str, str], notices: dict[str, str]) -> list[tuple[int, str, int, int, int, int, int]]:
    """(template, label, k, gram, check, place, number of grams); one row for each k-gram."""
    rows = []
    for n, (text, label, k) in enumerate([(t, x, PHRASE_K) for t, x in phrases.items()] + [(t, x, TEXT_K) for x, t in notices.items()]):
        grams, checks = _gram_hashes(word_hashes([text.encode()], drop=_OUTSIDE)[0], k)
        if not len(grams):
            raise ValueError(f"a template needs {k} words: {text[:40]}")
        rows += [(n, label, k, g, c, i, len(grams)) for i, (g, c) in enumerate(zip(grams.tolist(), checks.tolist()))]
    return rows


_GRAM = pa.schema([("row", pa.int64()), ("k", pa.int32()), ("gram", pa.int64()), ("check", pa.int32()), ("position", pa.int64()), ("doc_id", pa.int64())])
# Stands for a text as a whole; position has its number of words.
_TEXT = (-1, "", 0, 0, 0, 0, 1)


def _rows(row: np.ndarray, k: int, grams: np.ndarray, checks: np.ndarray, position: np.ndarray, doc_id: pa.Array | None = None) -> pa.RecordBatch:
    n = len(row)
    ids = pa.nulls(n, pa.int64()) if doc_id is None else doc_id
    return pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.full(n, k, np.int32)), pa.array(grams), pa.array(checks), pa.array(position), ids], schema=_GRAM)


def _long_grams(row: int, text: bytes) -> Iterator[pa.RecordBatch]:
    """The k-grams of one long text, slice by slice; the return value is its number of words."""
    count, tail = 0, np.empty(0, np.uint64)
    for hashes in long_word_hashes(text, drop=_OUTSIDE):
        words = np.concatenate([tail, hashes])
        for k in _KINDS:
            own = words[max(0, len(tail) - k + 1) :]
            grams, checks = _gram_hashes(own, k)
            yield _rows(np.full(len(grams), row), k, grams, checks, np.arange(len(grams)) + count - min(k - 1, len(tail)))
        count += len(hashes)
        tail = words[max(0, len(words) - max(_KINDS) + 1) :]
    return count


def _all_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every k-gram of every text, and one for the text itself."""
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        for at, chunk in in_chunks(bodies(batch.column("body"))):
            rows = np.arange(row, row + len(chunk))
            row += len(chunk)
            if len(chunk) == 1 and len(chunk[0]) > SLICE:
                sizes = np.array([(yield from _long_grams(int(rows[0]), chunk[0]))])
            else:
                hashes, first = word_hashes(chunk, drop=_OUTSIDE)
                sizes = np.diff(first)
                text = np.repeat(np.arange(len(chunk)), sizes)
                for k in _KINDS:
                    grams, checks = _gram_hashes(hashes, k)
                    n = len(grams)
                    inside = text[:n] == text[k - 1 :][:n]
                    position = np.arange(n) - first[text[:n]]
                    yield _rows(rows[text[:n]][inside], k, grams[inside], checks[inside], position[inside])
            none = np.zeros(len(chunk), np.int64)
            yield _rows(rows, 0, none, none.astype(np.int32), sizes, batch.column("doc_id").slice(at, len(chunk)))


def scan_licenses(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: dict[str, str] | None = None,
    notices: dict[str, str] | None = None,
    min_coverage: float = MIN_COVERAGE,
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base labels come from phrases whose words stand consecutively, every place counted. A notice's
    label is added if one merged band of diagonals has at least ``min_coverage`` of its k-grams.
    ``score`` is the largest coverage of any template, 1 where a phrase stands, 0 without a hit.

    Nulls: a null text has no words; a null identifier is carried through. Rows that repeat
    an identifier are scanned each for itself. An empty table gives an empty result. A text may be of any
    length and have any number of hits: it is hashed slice by slice, and hits are rows. Templates must be
    a bounded list: they are broadcast.
    """
    spark = docs.sparkSession
    grams = template_grams(PHRASES if phrases is None else phrases, NOTICES if notices is None else notices)
    templates = spark.createDataFrame([_TEXT, *grams], "template int, label string, k int, gram long, check int, place int, n_grams int")
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("body"))
    every = named.mapInArrow(_all_grams, "row long, k int, gram long, check int, position long, doc_id long")
    hits = materialise(every.join(F.broadcast(templates), ["k", "gram", "check"]).drop("gram", "check"), "hits")
    scanned = hits.where("k = 0").select("row", "doc_id", F.col("position").alias("n_words"))
    votes = hits.where("k > 0").withColumn("diagonal", F.col("position") - F.col("place"))

    places = (
        votes.where(F.col("k") == PHRASE_K).groupBy("row", "template", "label", "diagonal").agg(F.count("*").alias("n"), F.max("n_grams").alias("n_grams")).where("n = n_grams")
    )
    base = places.groupBy("row").agg(
        F.count("*").alias("n_base"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"), F.collect_set("label").alias("base_set")
    )

    beside = Window.partitionBy("row", "template").orderBy("diagonal", "place")
    banded = (
        votes.where(F.col("k") == TEXT_K)
        .withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(beside) > MAX_DRIFT).cast("int"))
        .withColumn("band", F.sum(F.coalesce("new", F.lit(0))).over(beside))
    )
    spans = banded.groupBy("row", "template", "label", "band").agg((F.count_distinct("place") / F.max("n_grams")).alias("coverage"))
    found = spans.groupBy("row").agg(F.max("coverage").alias("coverage"), F.collect_set(F.when(F.col("coverage") >= min_coverage, F.col("label"))).alias("found_set"))

    none = F.array().cast("array<string>")
    return (
        scanned.join(base, "row", "left")
        .join(found, "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_base", F.lit(0)).alias("n_base"),
            "first_word",
            "last_word",
            F.array_join(F.array_sort(F.coalesce("base_set", none)), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_union(F.coalesce("base_set", none), F.coalesce("found_set", none))), ",").alias("labels"),
            F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("coverage", F.lit(0.0))).alias("score"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
