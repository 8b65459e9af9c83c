"""License scan: exact set-similarity join of text blocks with templates.

A block is a window of ``2 * STRIDE`` words that starts every ``STRIDE`` words,
so any passage of up to ``STRIDE`` words lies whole in some block. A template
is found in a block when the block holds at least the threshold share of the
template's distinct words (containment).

1. For each word of a template the documents that hold it are counted, over
   all documents; rare words come first in the global order. Words of no template cannot add to an overlap,
   so only the template vocabulary, which the parameters bound, is counted.
2. Prefix filter: an overlap of ``need`` words implies a common word among the
   first ``size - need + 1`` words of either side in the global order. The
   template prefixes form an inverted index that is broadcast (its size
   follows the templates, not the data); each block explodes its own prefix.
3. Length filter: a block with fewer vocabulary words than ``need`` is out.
   Positional filter: from the two positions of the first common prefix word
   follows an upper bound of the overlap.
4. The remaining pairs are verified by the exact intersection.

The base phrases are templates with threshold 1; in their blocks the places
are found where the words stand consecutively.

Only the verdicts, a row per document after the map-side combine, are
shuffled; no text is.

Edge cases: a null or empty text has no words and no labels; a null id is
kept; rows that repeat (equal id and text) each give a row of the result; very
long texts are cut in blocks like any other; labels that tie are all named; an
empty table gives an empty result; other columns, also of clashing names, are
ignored.
"""

from __future__ import annotations

import math
import re
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm.common import ascii_lower, text_or_empty

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words: the complement of ``WORD``.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
STRIDE = 64
THRESHOLD = 0.8

# The phrases that base labels stand for.
PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}
# Notices of well-known public licenses.
NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction",
    "apache-2": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
    "compliance with the License. You may obtain a copy of the License at",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3",
    "gpl-2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation; either version 2 of the License",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
    "not distributed with this file, You can obtain one at",
    "cc-by-4": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "unlicense": "This is free and unencumbered software released into the public domain",
}


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    threshold: float
    phrase: bool

    @property
    def need(self) -> int:
        return math.ceil(self.threshold * len(set(self.words)) - 1e-9)


def words_of(text: str) -> tuple[str, ...]:
    """The words of a template, by the rule of ``words``."""
    lower = text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return tuple(re.findall(WORD, lower))


def default_templates(threshold: float = THRESHOLD) -> list[Template]:
    phrases = [Template(label, words_of(t), 1.0, True) for label, t in PHRASES.items()]
    return phrases + [Template(label, words_of(t), threshold, False) for label, t in NOTICES.items()]


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text_or_empty(text)), BETWEEN), "")


def global_order(docs: DataFrame, text_col: str, templates: list[Template]) -> list[str]:
    """The template vocabulary, rarest in the documents first."""
    vocabulary = sorted({w for t in templates for w in t.words})
    known = F.array(*[F.lit(w) for w in vocabulary])
    token = docs.select(F.explode(F.array_intersect(known, words(docs[f"`{text_col}`"]))).alias("token"))
    counts = {r.token: r["count"] for r in token.groupBy("token").count().collect()}  # a row per vocabulary word
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def prefix_index(spark: SparkSession, templates: list[Template], order: list[str]) -> DataFrame:
    """(token, entries): the templates in whose prefix a token stands, at ``at``."""
    rank = {w: i for i, w in enumerate(order)}
    rows: dict[str, list[tuple]] = {}
    for t in templates:
        tokens = sorted(set(t.words), key=rank.__getitem__)
        prefix = tokens[: len(tokens) - t.need + 1]
        for at, token in enumerate(prefix):
            rows.setdefault(token, []).append((t.label, t.phrase, at, t.need, tokens, prefix, list(t.words)))
    entry = "label string, phrase boolean, at int, need int, tokens array<string>, prefix array<string>, words array<string>"
    return spark.createDataFrame(sorted(rows.items()), f"token string, entries array<struct<{entry.replace(' ', ':').replace(',:', ', ')}>>")


def scan_blocks(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[Template] | None = None, stride: int = STRIDE
) -> DataFrame:
    """The join: rows (doc_id, text_hash, n_words, block, head, hits). ``hits``
    lists the templates found by this prefix word of the block as (label,
    phrase, containment, starts); ``head`` marks one row per input row."""
    spark = docs.sparkSession
    templates = default_templates() if templates is None else templates
    if any(len(t.words) > stride for t in templates):
        raise ValueError("a template is longer than the stride, so that no block need hold it whole")
    order = global_order(docs, text_col, templates)
    index = prefix_index(spark, templates, order)
    least = min(t.need for t in templates)
    prefixes = F.array(*[F.lit(r.token) for r in index.select("token").collect()])
    ordered = F.array(*[F.lit(w) for w in order])

    text = docs[f"`{text_col}`"]
    rows = docs.select(
        docs[f"`{id_col}`"].alias("doc_id"), F.xxhash64(text_or_empty(text)).alias("text_hash"), words(text).alias("w")
    )
    rows = rows.withColumn("n_words", F.size("w").cast("bigint"))
    last = F.greatest(F.ceil(F.col("n_words") / stride) - 1, F.lit(0)).cast("int")
    block = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice("w", k * stride + 1, 2 * stride))
    blocks = rows.select("doc_id", "text_hash", "n_words", F.posexplode(block).alias("block", "words"))
    blocks = blocks.withColumn("candidate", F.arrays_overlap("words", prefixes)).where("candidate or block = 0")
    blocks = blocks.withColumn("own", F.when(F.col("candidate"), F.array_intersect(ordered, "words")).otherwise(F.array().cast("array<string>")))
    own_prefix = F.slice("own", 1, F.greatest(F.size("own") - least + 1, F.lit(0)))
    probes = blocks.select("*", F.posexplode_outer(own_prefix).alias("at", "token"))
    joined = probes.join(F.broadcast(index), "token", "left")

    size, at = F.size("own"), F.col("at")

    def found(e: Column) -> Column:
        reach = F.least(e["at"], at) + 1 + F.least(F.size(e["tokens"]) - e["at"], size - at) - 1
        common = F.array_intersect(F.slice("own", 1, F.greatest(size - e["need"] + 1, F.lit(0))), e["prefix"])
        return (
            (size >= e["need"])
            & (at <= size - e["need"])
            & (reach >= e["need"])
            & (F.get(common, F.lit(0)) == F.col("token"))  # a pair with several common prefix words counts once
            & (F.size(F.array_intersect("own", e["tokens"])) >= e["need"])
        )

    def hit(e: Column) -> Column:
        places = F.filter(
            F.sequence(F.lit(0), F.least(F.lit(stride), F.size("words")) - 1),
            lambda i: F.slice("words", i + 1, F.size(e["words"])) == e["words"],
        )
        starts = F.when(e["phrase"], F.transform(places, lambda i: (i + F.col("block") * stride).cast("bigint")))
        share = F.size(F.array_intersect("own", e["tokens"])) / F.size(e["tokens"])
        return F.struct(
            e["label"].alias("label"), e["phrase"].alias("phrase"), share.alias("containment"),
            F.coalesce(starts, F.array().cast("array<bigint>")).alias("starts"),
        )

    hits = F.transform(F.filter(F.coalesce("entries", F.array().cast(index.schema["entries"].dataType)), found), hit)
    # A phrase whose words are all there but nowhere in a row is no find.
    hits = F.filter(hits, lambda h: ~h["phrase"] | (F.size(h["starts"]) > 0))
    head = (F.col("block") == 0) & (F.coalesce(at, F.lit(0)) == 0)
    return joined.select("doc_id", "text_hash", "n_words", "block", head.alias("head"), hits.alias("hits"))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[Template] | None = None, stride: int = STRIDE
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score (the largest containment, 0 without a find)."""
    rows = scan_blocks(docs, id_col, text_col, templates, stride)
    starts = F.flatten(F.transform("hits", lambda h: h["starts"]))
    base = F.transform(F.filter("hits", lambda h: h["phrase"]), lambda h: h["label"])
    rows = rows.select(
        "doc_id", "text_hash", "n_words", "head", starts.alias("starts"), base.alias("base"),
        F.transform("hits", lambda h: h["label"]).alias("labels"), F.array_max(F.transform("hits", lambda h: h["containment"])).alias("score"),
    )
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))), ",")
    repeats = F.sum(F.col("head").cast("bigint"))
    per_text = rows.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        repeats.alias("repeats"),
        (F.sum(F.size("starts")) / repeats).cast("bigint").alias("n_base"),
        F.min(F.array_min("starts")).alias("first_word"),
        F.max(F.array_max("starts")).alias("last_word"),
        joined("base").alias("base_labels"),
        joined("labels").alias("labels"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("score"),
    )
    each = per_text.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))))
    return each.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
