"""License scans: exact set-similarity join of text blocks with license templates.

A block is a run of words, whatever lines they stand on: for a template of m words every run of ``stretch`` * m words of a
text. Tokens are ordered by how many texts hold them, counted over the whole table. A template of n distinct tokens is found
in a block when the block holds at least t = ceil(threshold * n) of them; then one of the template's n - t + 1
rarest tokens is in the block (prefix filter), the block has at least t tokens (length filter), and from the first
shared token on enough remain on both sides (positional filter). Only what passes all three is verified, at the places
where the template's tokens stand.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chargelens.llm.common import doc_columns, runs_of, small_batches
from chargelens.llm.kernels import Words, words

# Fixed values: (phrase, label) of the base scan, then (label, text) of the templates, words of public license texts and notices.
BASE_PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-notice", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-notice", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-notice", "you should have received a copy of the gnu general public license along with this program"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit-grant", "and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit-grant", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-grant", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit-notice", "released under the mit license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("rights-reserved", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
)


def _hashes(text: str) -> np.ndarray:
    return words([text]).hash


def block_words(text: str, stretch: float) -> int:
    """Words of a block for this template."""
    return math.ceil(stretch * len(text.split()) - 1e-9)


class Templates:
    """Templates as token sets in global order, with what the three filters need."""

    def __init__(self, templates: Sequence[tuple[str, str]], threshold: float, stretch: float):
        self.labels = [label for label, _ in templates]
        self.sets = [np.unique(_hashes(text)) for _, text in templates]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *self.sets]))
        self.need = [math.ceil(threshold * len(s) - 1e-9) for s in self.sets]
        self.words = [block_words(text, stretch) for _, text in templates]

    def order(self, texts: np.ndarray) -> None:
        """texts: how many texts hold each token of the vocabulary. Rank 0 is the rarest; ties by hash."""
        by = np.lexsort((self.vocabulary, texts))
        self.rank = np.empty(len(by), dtype=np.int64)
        self.rank[by] = np.arange(len(by))
        self.ranked = [np.sort(self.rank[np.searchsorted(self.vocabulary, s)]) for s in self.sets]
        self.prefix = np.zeros(len(by), dtype=bool)
        self.index: dict[int, list[tuple[int, int]]] = {}
        for k, r in enumerate(self.ranked):
            for i, token in enumerate(r[: len(r) - self.need[k] + 1].tolist()):
                self.index.setdefault(token, []).append((k, i))
                self.prefix[token] = True

    def candidates(self, ranks: list[int]) -> list[int]:
        """The templates that a text may hold, by its distinct vocabulary ranks in order: what no text passes, none of its blocks does."""
        out, tried = [], set()
        for j, token in enumerate(ranks):
            for k, i in self.index.get(token, ()):
                if k not in tried:
                    tried.add(k)
                    r = self.ranked[k]
                    if 1 + min(len(r) - i - 1, len(ranks) - j - 1) >= self.need[k] and len(np.intersect1d(r, ranks, assume_unique=True)) >= self.need[k]:
                        out.append(k)
        return out

    def blocks(self, k: int, place: np.ndarray, rank: np.ndarray) -> list[tuple[int, int, int]]:
        """(first, last, distinct tokens) of the best block that holds template k in each stretch of overlapping ones; place, rank: where the text has which vocabulary token."""
        mine = np.isin(rank, self.ranked[k], assume_unique=False)
        place, rank = place[mine].tolist(), rank[mine].tolist()
        rare = self.index_ranks(k)
        count: dict[int, int] = {}
        out: list[tuple[int, int, int]] = []
        lo = rares = 0
        for hi, (p, r) in enumerate(zip(place, rank, strict=True)):
            count[r] = count.get(r, 0) + 1
            rares += r in rare
            while place[lo] <= p - self.words[k]:
                old = rank[lo]
                count[old] -= 1
                rares -= old in rare
                if not count[old]:
                    del count[old]
                lo += 1
            if rares and len(count) >= self.need[k]:  # the block's prefix filter, then the containment itself
                if out and place[lo] <= out[-1][1]:
                    if len(count) > out[-1][2]:
                        out[-1] = (place[lo], p, len(count))
                else:
                    out.append((place[lo], p, len(count)))
        return out

    def index_ranks(self, k: int) -> set[int]:
        r = self.ranked[k]
        return set(r[: len(r) - self.need[k] + 1].tolist())


def _tokens(w: Words, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, vocabulary index) of the words that some template has."""
    if not len(vocabulary) or not len(w.hash):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(vocabulary, w.hash), len(vocabulary) - 1)
    hit = np.flatnonzero(vocabulary[at] == w.hash)
    return hit, at[hit]


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: Sequence[tuple[str, str]] = BASE_PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = 0.8, stretch: float = 1.25, batch_chars: int = 1_000_000) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    ``matches``: (label, first word and number of words, containment) of the best block in each stretch of blocks that hold a template. The score is 1
    where a phrase stands, else the best containment found, else 0. A null or empty text has no words, empty labels, null
    first_word and last_word and the score 0; ids may be null or repeat. An empty table stays empty. Other columns are ignored.
    A number a template token, the texts that hold it, is all that reaches the driver.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = doc_columns(docs, id_col, text_col)
    known = Templates(templates, threshold, stretch)
    wanted = [(_hashes(p), label) for p, label in phrases]

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(known.vocabulary), dtype=np.int64)
        for frame in frames:
            texts = frame["text"].tolist()
            for lo, hi in runs_of(texts, batch_chars):
                w = words(texts[lo:hi])
                word, token = _tokens(w, known.vocabulary)
                total += np.bincount(np.unique(w.doc[word] * max(len(total), 1) + token) % max(len(total), 1), minlength=len(total))
        yield pd.DataFrame({"token": np.arange(len(total)), "n": total})

    holds = np.zeros(len(known.vocabulary), dtype=np.int64)
    for r in rows.select("text").mapInPandas(counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():
        holds[r["token"]] = r["n"]
    known.order(holds)
    shared = spark.sparkContext.broadcast(known)

    def scanned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: Templates = shared.value
        for frame in frames:
            texts, ids = frame["text"].tolist(), frame["doc_id"]
            for lo, hi in runs_of(texts, batch_chars):
                yield _scan(model, wanted, texts[lo:hi], ids.iloc[lo:hi])

    return rows.mapInPandas(scanned, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,first_word:long,n_words:long,containment:double>>")


def _scan(model: Templates, wanted: list[tuple[np.ndarray, str]], texts: list[str], ids: pd.Series) -> pd.DataFrame:
    w, n = words(texts), len(texts)
    doc, total = w.doc, len(w.hash)
    n_base, low, high = np.zeros(n, dtype=np.int64), np.full(n, 1 << 62), np.full(n, -1)
    base: list[set[str]] = [set() for _ in range(n)]
    for phrase, label in wanted:
        k = len(phrase)
        if not k or total < k:
            continue
        at = np.flatnonzero(w.hash[: total - k + 1] == phrase[0])
        for j in range(1, k):
            at = at[w.hash[at + j] == phrase[j]]
        at = at[doc[at] == doc[at + k - 1]]
        place = at - w.first[doc[at]]
        n_base += np.bincount(doc[at], minlength=n)
        np.minimum.at(low, doc[at], place)
        np.maximum.at(high, doc[at], place)
        for d in np.unique(doc[at]).tolist():
            base[d].add(label)
    word, token = _tokens(w, model.vocabulary)
    labels, best = [set(b) for b in base], (n_base > 0).astype(np.float64)
    matches: list[list[dict]] = [[] for _ in range(n)]
    rank, of = (model.rank[token], doc[word]) if len(token) else (token, word)
    edge = np.searchsorted(of, np.arange(n + 1))
    for d in np.unique(of[model.prefix[rank]]).tolist() if len(token) else ():
        lo, hi = edge[d], edge[d + 1]
        for k in model.candidates(np.unique(rank[lo:hi]).tolist()):
            for first, last, shared in model.blocks(k, word[lo:hi] - w.first[d], rank[lo:hi]):
                share = shared / len(model.ranked[k])
                labels[d].add(model.labels[k])
                best[d] = max(best[d], share)
                matches[d].append({"label": model.labels[k], "first_word": int(first), "n_words": int(last - first + 1), "containment": share})
    none = high < 0
    return pd.DataFrame({"doc_id": ids.to_numpy(), "n_words": np.diff(w.first), "n_base": n_base, "first_word": pd.array(np.where(none, 0, low), dtype="Int64"), "last_word": pd.array(np.where(none, 0, high), dtype="Int64"), "base_labels": [",".join(sorted(x)) for x in base], "labels": [",".join(sorted(x)) for x in labels], "score": best, "matches": matches}).assign(first_word=lambda f: f["first_word"].mask(none), last_word=lambda f: f["last_word"].mask(none))
