"""Licence scan with a positional index of rare tokens.

A pass over all texts finds the plain phrases and the places of licence words.
Document frequencies of those words over the whole corpus give their IDF.  The
same pass finds where the mandatory key phrases of the templates stand, word by
word.  Where all those of a template do, the places of its words vote for where
its notice starts, and it is confirmed only if the phrases stand there.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, settle

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

# The plain phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Label -> (notice text, mandatory key phrases). The notices are the public short forms.
TEMPLATES = {
    "mit-notice": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ["permission is hereby granted free of charge", "sublicense and or sell copies"],
    ),
    "apache-2.0": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
        "the license you may obtain a copy of the license at",
        ["licensed under the apache license version"],
    ),
    "gpl-notice": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
        ["under the terms of the gnu general public license"],
    ),
    "lgpl": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
        "general public license as published by the free software foundation",
        ["gnu lesser general public license"],
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met redistributions of source code must retain the above copyright notice this "
        "list of conditions and the following disclaimer",
        ["redistribution and use in source and binary forms", "redistributions of source code must retain"],
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
        ["permission to use copy modify", "with or without fee is hereby granted"],
    ),
    "mpl-2.0": (
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ["subject to the terms of the mozilla public license"],
    ),
    "cc-licence": (
        "this work is licensed under a creative commons attribution international license",
        ["licensed under a creative commons attribution"],
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain",
        ["free and unencumbered software released into the public domain"],
    ),
}


def index_words(templates: dict[str, tuple[str, list[str]]], least: int = 4) -> dict[str, list[tuple[str, int]]]:
    """word -> its (label, position) postings; words of under ``least`` letters are too common to be looked up."""
    index = defaultdict(list)
    for label, (notice, _) in templates.items():
        for at, w in enumerate(notice.split()):
            if len(w) >= least:
                index[w].append((label, at))
    return dict(index)


def key_phrases(templates: dict[str, tuple[str, list[str]]]) -> dict[str, list[tuple[str, list[str], int]]]:
    """The longest word of each key phrase -> (phrase, its words, that word's place in it)."""
    anchors = defaultdict(list)
    for phrase in dict.fromkeys(p for _, keys in templates.values() for p in keys):
        parts = phrase.split()
        k = max(range(len(parts)), key=lambda i: len(parts[i]))
        anchors[parts[k]].append((phrase, parts, k))
    return dict(anchors)


def licence_places(docs: DataFrame, templates: dict = TEMPLATES, phrases: dict = BASE_PHRASES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels array<string>, and
    places, stands array<struct<word string, at bigint>>: licence words and whole key phrases.

    A null text is empty.  Each row is scanned whole and by itself.
    """
    arrow_batches(docs.sparkSession)
    index = set(index_words(templates))
    by_first = defaultdict(list)
    for phrase, label in phrases.items():
        parts = phrase.split()
        by_first[parts[0]].append((parts, label))
    anchors = key_phrases(templates)
    wanted = index | set(by_first) | set(anchors)
    kind = docs.schema[id_col].dataType.simpleString()
    place = pa.struct([("word", pa.string()), ("at", pa.int64())])
    names = [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "places", "stands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in names[1:]]
            for t in batch.column(1).to_pylist():
                words = WORD.findall((t or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))
                starts, labels, places, stands = [], set(), [], []
                for at, w in [(i, w) for i, w in enumerate(words) if w in wanted]:
                    for parts, label in by_first.get(w, ()):
                        if words[at : at + len(parts)] == parts:
                            starts.append(at)
                            labels.add(label)
                    for phrase, parts, k in anchors.get(w, ()):
                        if at >= k and words[at - k : at - k + len(parts)] == parts:
                            stands.append({"word": phrase, "at": at - k})
                    if w in index:
                        places.append({"word": w, "at": at})
                row = (len(words), len(starts), min(starts, default=None), max(starts, default=None), sorted(labels), places, stands)
                for x, y in zip(out, row):
                    x.append(y)
            kinds = [*[pa.int64()] * 4, pa.list_(pa.string()), pa.list_(place), pa.list_(place)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, kinds)], names)

    schema = f"`{id_col}` {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, places array<struct<word:string,at:bigint>>, stands array<struct<word:string,at:bigint>>"
    return docs.select(id_col, text).mapInArrow(run, schema)


class Matcher:
    """Finds templates in a file's licence words."""

    def __init__(self, idf: dict[str, float], templates: dict[str, tuple[str, list[str]]], slack: int = 3):
        self.idf, self.index, self.slack = idf, index_words(templates), slack
        self.words = defaultdict(dict)
        for w, postings in self.index.items():
            for label, at in postings:
                self.words[label][at] = w
        self.phrases = {label: keys for label, (_, keys) in templates.items()}

    def match(self, places: list[dict], stands: list[dict]) -> dict[str, float]:
        """label -> the IDF-weighted share of its notice that stands in place, for templates whose key phrases all do.

        places: the file's licence words; stands: where whole key phrases start.
        Every template whose key phrases all stand somewhere is looked up by
        all its words that the file has; the others cannot be confirmed.
        """
        if not stands:
            return {}
        at, starting = defaultdict(list), defaultdict(list)
        for p in places:
            at[p["word"]].append(p["at"])
        for p in stands:
            starting[p["word"]].append(p["at"])
        there = {(w, i) for w, own in at.items() for i in own}
        found: dict[str, float] = {}
        for label, notice in self.words.items():
            if all(p in starting for p in self.phrases[label]):
                phrases = [sorted(starting[p]) for p in self.phrases[label]]
                votes = Counter(i - k for k, w in notice.items() for i in at.get(w, ()))
                total = sum(self.idf.get(w, 0.0) for w in notice.values())
                length = max(notice) + self.slack
                for start, n in votes.items():
                    if n < 2 or not all(
                        (j := bisect_left(own, start - self.slack)) < len(own) and own[j] <= start + length for own in phrases
                    ):
                        continue
                    has = sum(
                        self.idf.get(w, 0.0)
                        for k, w in notice.items()
                        if any((w, start + k + d) in there for d in range(-self.slack, self.slack + 1))
                    )
                    found[label] = max(found.get(label, 0.0), has / total if total else 0.0)
        return found


def scan_licences(docs: DataFrame, templates: dict = TEMPLATES, phrases: dict = BASE_PHRASES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of :func:`licence_places` without places, and matches map<string, double>, labels array<string>, score.

    matches has the confirmed templates and their coverage; labels are its
    labels and the base ones, sorted.  score is 1 - (1 - b)(1 - c) with b 0.5
    if a base phrase was found and c the best coverage.  An empty table gives
    no rows; texts without licence words have no labels and score 0.
    """
    seen = settle(licence_places(docs, templates, phrases, id_col, text))
    total = seen.count()
    rows = (
        seen.select(F.explode(F.array_distinct(F.col("places.word"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    )  # at most the templates' words
    idf = {r["word"]: math.log((1 + total) / r["n"]) for r in rows}
    matcher = Matcher(idf, templates)
    kinds = [seen.schema[c].dataType.simpleString() for c in seen.columns[:-2]]
    columns = [*seen.columns[:-2], "matches", "labels", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matches, labels, scores = [], [], []
            for places, stands, base in zip(*[batch.column(c).to_pylist() for c in ("places", "stands", "base_labels")]):
                found = matcher.match(places, stands)
                matches.append(sorted(found.items()))
                labels.append(sorted({*found, *base}))
                scores.append(1 - (0.5 if base else 1.0) * (1 - max(found.values(), default=0.0)))
            data = [*batch.columns[:-2], pa.array(matches, pa.map_(pa.string(), pa.float64())), pa.array(labels, pa.list_(pa.string())), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(data, columns)

    schema = ", ".join(f"`{c}` {k}" for c, k in zip(columns, [*kinds, "map<string,double>", "array<string>", "double"]))
    return seen.mapInArrow(run, schema)
