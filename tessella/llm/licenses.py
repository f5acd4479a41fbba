"""License scans by an exact set-similarity join of text blocks with templates (operator 4).

A template of n words is looked for in blocks of 2 s words that start s words apart, where s, its class, is
the least power of two (LEAST_SPAN at least) that is no less than n; so any passage of up to s + 1 words
stands whole in a block. A block matches a template if it holds at least CONTAINMENT of the template's distinct
words; only words of some template count. The join finds every such pair:

* Words are ordered by document frequency over the whole corpus, rarest first.
* Prefix filter: blocks and templates meet by words in a template's first n - need + 1 in that order, and in a block's
  first n - need + 1 for the least need of its class.
* Length filter: a block needs as many distinct words as the template asks for.
* Positional filter: where the first word they share stands at p and q, at most one and the lesser of both
  rests can be shared; this rejects what a block's prefix, made for the least need, lets through.

Candidates are verified on the sets, then by order: a longest common subsequence of the block and the template must have CONTAINMENT
of the template's words, repeats included, or it is no passage of it. Where a text matches under several labels, each of its words
goes to the match that contains most (then to the one with more words; equal ones share it), and a match stays only
if at least half the words that it aligned are its own; so one licence is not also reported as its neighbours. Texts are cut to blocks where they lie, with the templates' words sent to the
tasks, MOST_WORDS at most: a larger table of templates is dealt to several passes. Base phrases are looked up
word by word.

Edge cases: null and empty texts have no words, no label and score 0; null ids are kept as they are; repeated rows
are scanned each; templates without words match nothing; a table without rows gives none; extra columns are ignored."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.ordering import running

from .common import materialise

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Containment that a block must reach; words that a block of the smallest class steps on by; template words
#: that one pass over the texts looks for.
CONTAINMENT, LEAST_SPAN, MOST_WORDS = 0.8, 64, 500_000

# Base phrases and labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Opening passages of well-known licenses, the templates unless a table of others is given.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "apache-2": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    "cc-by": "This work is licensed under a Creative Commons Attribution International License",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution NonCommercial International License",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution ShareAlike International License",
    "cc-by-nd": "This work is licensed under a Creative Commons Attribution NoDerivatives International License",
    "cc-by-nc-sa": "This work is licensed under a Creative Commons Attribution NonCommercial ShareAlike International License",
    "cc-by-nc-nd": "This work is licensed under a Creative Commons Attribution NonCommercial NoDerivatives International License",
}


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").encode().lower().decode())  # bytes: only A-Z change


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "label string, text string")


@dataclass(frozen=True)
class Template:
    number: int
    label: str
    words: frozenset[str]
    span: int
    need: int
    text: tuple[str, ...]


def template_of(number: int, label: str, text: str | None, containment: float) -> Template:
    words = words_of(text)
    own = frozenset(words)
    return Template(number, label, own, max(LEAST_SPAN, 1 << max(0, len(words) - 1).bit_length()), ceil(containment * len(own) - 1e-9), tuple(words))


def frequencies(docs: DataFrame, wanted: frozenset[str]) -> DataFrame:
    """(word, n): documents that hold it, for the words of the templates."""

    def run(batches):
        counts = dict.fromkeys(wanted, 0)
        for b in batches:
            for t in b.column("text"):
                for w in wanted.intersection(words_of(t.as_py())):
                    counts[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Index:
    """Places of the templates' words in the global order, and by class what blocks are cut by."""

    def __init__(self, templates: list[Template], frequency: dict[str, int]):
        order = sorted(frozenset().union(*(t.words for t in templates)), key=lambda w: (frequency.get(w, 0), w))
        self.place = {w: i for i, w in enumerate(order)}
        self.rare: dict[int, set[int]] = defaultdict(set)
        self.least: dict[int, int] = {}
        self.rows = []
        self.texts = {t.number: [self.place[w] for w in t.text] for t in templates}
        for t in templates:
            own = sorted(self.place[w] for w in t.words)
            prefix = own[: len(own) - t.need + 1]
            self.rare[t.span].update(prefix)
            self.least[t.span] = min(t.need, self.least.get(t.span, t.need))
            self.rows.append((t.number, t.label, t.span, t.need, own, list(enumerate(prefix))))
        self.entry = frozenset(order[i] for i in set().union(*self.rare.values())) if templates else frozenset()

    def blocks(self, words: list[str]) -> list[tuple]:
        """(class, start, places of the block's words in order, (word, place in the block) of its prefix words, where its words stand, their
        places as they stand) of the blocks that have such words."""
        if not self.entry.intersection(words):
            return []
        at = [(i, p) for i, w in enumerate(words) if (p := self.place.get(w)) is not None]
        found = []
        for span, rare in self.rare.items():
            held = defaultdict(list)
            starts = {i // span for i, p in at if p in rare}
            starts |= {k - 1 for k in starts if k}
            for i, p in at:
                for k in (i // span, i // span - 1):
                    if k in starts:
                        held[k].append((i, p))
            for k, stand in held.items():
                own = sorted({p for _, p in stand})
                met = [(p, q) for q, p in enumerate(own[: len(own) - self.least[span] + 1]) if p in rare] if len(own) >= self.least[span] else []
                if met:
                    found.append((span, k * span, own, met, *map(list, zip(*stand))))
        return found


def places(words: list[str]) -> list[tuple[int, str]]:
    """(start, label) of the base phrases."""
    held, found = None, []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        held = held if held is not None else set(words)
        if not held.issuperset(p):
            continue
        i = -1
        try:
            while True:
                i = words.index(p[0], i + 1)
                if words[i : i + len(p)] == p:
                    found.append((i, label))
        except ValueError:
            pass
    return sorted(found)


OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
BLOCKS = "array<struct<span:int,start:int,places:array<int>,met:array<struct<place:int,q:int>>,at:array<int>,text:array<int>>>"
SCAN = f"row long, doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, blocks {BLOCKS}"


def scan(docs: DataFrame, index: Index) -> DataFrame:
    """SCAN of every row of docs: base phrases, and the blocks that may match a template."""
    met = pa.list_(pa.struct([("place", pa.int32()), ("q", pa.int32())]))
    blocks = pa.list_(pa.struct([("span", pa.int32()), ("start", pa.int32()), ("places", pa.list_(pa.int32())), ("met", met), ("at", pa.list_(pa.int32())), ("text", pa.list_(pa.int32()))]))
    kinds = [pa.int64()] * 6 + [pa.string(), blocks]

    def run(batches):
        for b in batches:
            rows = []
            for row, doc, t in zip(b.column("row").to_pylist(), b.column("doc_id").to_pylist(), b.column("text")):
                words = words_of(t.as_py())
                base = places(words)
                found = [{"span": s, "start": k, "places": own, "met": [{"place": p, "q": q} for p, q in met_by], "at": at, "text": text} for s, k, own, met_by, at, text in index.blocks(words)]
                rows.append((row, doc, len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({label for _, label in base})), found))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows) if rows else [[]] * 8, kinds)], ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "blocks"])

    return docs.mapInArrow(run, SCAN)


def candidates(scanned: DataFrame, index: Index) -> tuple[DataFrame, DataFrame]:
    """Pairs (row, start, places, number, own) of blocks and templates that meet by a prefix word, before and after
    the length and positional filters."""
    spark = scanned.sparkSession
    table = spark.createDataFrame(index.rows, "number int, label string, span int, need int, own array<int>, prefix array<struct<p:int,place:int>>")
    prefixes = table.select("number", "span", "need", F.size("own").alias("n"), F.explode("prefix").alias("x")).select("number", "span", "need", "n", "x.place", "x.p")
    blocks = scanned.select("row", F.explode("blocks").alias("b")).select("row", "b.span", "b.start", "b.places", F.explode("b.met").alias("m"))
    met = blocks.select("row", "span", "start", "places", "m.place", "m.q").join(prefixes, ["span", "place"])
    met = met.groupBy("row", "span", "start", "number").agg(F.min("p").alias("p"), F.min("q").alias("q"), F.any_value("places").alias("places"), F.any_value("need").alias("need"), F.any_value("n").alias("n"))
    size = F.size("places")
    kept = met.where((size >= F.col("need")) & (1 + F.least(F.col("n") - F.col("p") - 1, size - F.col("q") - 1) >= F.col("need")))
    return met, kept.join(table.select("number", "label", "own"), "number")


def contained(scanned: DataFrame, index: Index) -> DataFrame:
    """(row, span, start, number, label, containment) of every block and template that reach the template's need."""
    found = candidates(scanned, index)[1].withColumn("shared", F.size(F.array_intersect("places", "own"))).where(F.col("shared") >= F.col("need"))
    return found.select("row", "span", "start", "number", "label", (F.col("shared") / F.col("n")).alias("containment"))


def aligned(block: list[int], stands: dict[int, list[int]]) -> list[int]:
    """Places in the block of a longest common subsequence with a template, whose words stand at `stands`, as a longest
    ascending run of their meetings: of each length the run that ends earliest in the template is kept."""
    ends, runs = [], []
    for i, w in enumerate(block):
        for j in reversed(stands.get(w, ())):
            k = bisect_left(ends, j)
            run = (i, runs[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                runs.append(run)
            else:
                ends[k], runs[k] = j, run
    found, run = [], runs[-1] if runs else None
    while run:
        found.append(run[0])
        run = run[1]
    return found[::-1]


MATCH = "row long, label string, n int, containment double, at array<int>"


def in_order(found: DataFrame, texts: dict[int, list[int]], containment: float) -> DataFrame:
    """MATCH of the candidates (row, number, label, containment, at, text) whose words stand in the template's order; n and at: the
    words that it aligns, as places in the text."""

    def run(batches):
        stands = {}
        for number, text in texts.items():
            own = stands[number] = defaultdict(list)
            for j, w in enumerate(text):
                own[w].append(j)
        for b in batches:
            rows = []
            for r in b.to_pylist():
                at = [r["at"][i] for i in aligned(r["text"], stands[r["number"]])]
                if len(at) >= ceil(containment * len(texts[r["number"]]) - 1e-9):
                    rows.append((r["row"], r["label"], len(at), min(r["containment"], len(at) / len(texts[r["number"]])), at))
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["row", "label", "n", "containment", "at"])

    return found.mapInArrow(run, MATCH)


def matches(docs: DataFrame, templates: list[Template], containment: float = CONTAINMENT) -> tuple[DataFrame, DataFrame]:
    """SCAN of docs, and MATCH of what its blocks match."""
    # A row for each word of the templates, MOST_WORDS at most.
    frequency = {r["word"]: r["n"] for r in materialise(frequencies(docs, frozenset().union(*(t.words for t in templates))), "frequencies").collect()}
    index = Index(templates, frequency)
    scanned = materialise(scan(docs, index), "scan")
    found = contained(scanned, index)
    blocks = scanned.select("row", F.explode("blocks").alias("b")).select("row", "b.span", "b.start", "b.at", "b.text")
    found = found.join(blocks, ["row", "span", "start"]).select("row", "number", "label", "containment", "at", "text")
    return scanned, in_order(found, index.texts, containment)


def best_matches(found: DataFrame) -> DataFrame:
    """(row, label, containment) of the matches (MATCH and a number, match) that keep at least half of their words against all others of their text. Texts
    with one label, most of them, aren't looked at word by word."""
    labels = found.groupBy("row").agg((F.count_distinct("label") > 1).alias("several"))
    found = found.join(labels, "row")
    words = found.where("several").select("row", "label", "containment", "n", "match", F.explode("at").alias("word"))
    words = words.withColumn("strength", F.struct(F.round("containment", 9).alias("c"), "n"))
    top = words.groupBy("row", "word").agg(F.max("strength").alias("top"))
    kept = words.join(top, ["row", "word"]).groupBy("match", "row", "label", "containment", "n").agg(F.sum(F.when(F.col("strength") == F.col("top"), 1).otherwise(0)).alias("own"))
    return found.where("not several").select("row", "label", "containment").union(kept.where("2 * own >= n").select("row", "label", "containment"))


def find_licenses(docs: DataFrame, templates: DataFrame | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """OUT for each row of docs; templates: (label, text), TEMPLATES unless given."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = template_table(docs.sparkSession) if templates is None else templates.select("label", "text")
    table = running(table.where("text is not null and label is not null").withColumn("size", F.length("text")), [F.asc("label"), F.asc("text")], {"number": F.lit(1), "before": F.col("size")})
    table = materialise(table.withColumn("part", F.floor(F.col("before") / (2 * MOST_WORDS))), "templates")  # a word takes two characters
    passes = (table.agg(F.max("part")).first()[0] or 0) + 1
    docs = docs.withColumn("row", F.monotonically_increasing_id())
    docs = docs if passes == 1 else materialise(docs, "numbered")  # passes meet by row
    every = []
    for part in range(passes):
        own = [template_of(r["number"], r["label"], r["text"], containment) for r in table.where(F.col("part") == part).collect()]
        every.append(matches(docs, [t for t in own if t.words], containment))
    found = best_matches(materialise(reduce(DataFrame.union, (m for _, m in every)).withColumn("match", F.monotonically_increasing_id()), "matches")).groupBy("row").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    scanned = every[0][0].drop("blocks").join(found, "row", "left")
    scanned = scanned.withColumns({"found": F.coalesce("found", F.array().cast("array<string>")), "best": F.coalesce("best", F.lit(0.0))})
    labels = F.array_union(F.filter(F.split("base_labels", ","), lambda x: x != ""), "found")
    return scanned.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", F.array_join(F.array_sort(labels), ",").alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.col("best")).alias("score"))


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    return find_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
