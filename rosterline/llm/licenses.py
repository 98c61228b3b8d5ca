"""Licence scans with a positional index of each licence text's rare words."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import column_function, staged

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}

# The phrases whose places count, with their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Per label, a passage of the licence's usual notice and the phrases that must stand in a match.
TEMPLATES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ["permission is hereby granted free of charge", "deal in the software without restriction"],
    ),
    "apache": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
        "the license you may obtain a copy of the license at",
        ["apache license version 2 0"],
    ),
    "gpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation",
        ["gnu general public license"],
    ),
    "lgpl": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
        "public license as published by the free software foundation",
        ["lesser general public license"],
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
        ["redistribution and use in source and binary forms"],
    ),
    "mpl": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
        "distributed with this file you can obtain one at",
        ["mozilla public license"],
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies",
        ["permission to use copy modify and or distribute this software"],
    ),
    "cc": ("this work is licensed under a creative commons attribution international license", ["creative commons attribution"]),
}
VOCABULARY = frozenset(word for text, _ in TEMPLATES.values() for word in text.split()) | frozenset(
    word for phrase in BASE_PHRASES for word in phrase.split()
)
LEAST_SHARE = 0.6  # of a template's words that must stand in a match, in order
SHIFT = 8  # most words that may be inserted or missing between two words of a match


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").translate(_LOWER))


@column_function("struct<n_words:long,words:array<string>,places:array<long>>")
def licence_words(texts: pd.Series) -> pd.DataFrame:
    """The licence words of each whole text, with their places."""
    rows = []
    for text in texts:
        words = words_of(text)
        found = [(word, at) for at, word in enumerate(words) if word in VOCABULARY]
        rows.append((len(words), [word for word, _ in found], [at for _, at in found]))
    return pd.DataFrame(rows, columns=["n_words", "words", "places"])


def phrase_places(at: dict[int, str], places: list[int], phrase: str) -> list[int]:
    first, *rest = phrase.split()
    return [p for p in places if at[p] == first and all(at.get(p + i + 1) == word for i, word in enumerate(rest))]


def anchors(idf: dict[str, float]) -> dict[str, list[tuple[str, int]]]:
    """Per word, the templates and positions that it votes for: in each template the positions of the highest IDF.

    A match may lack ``len - least`` words, so of that many positions and two more at least two are in any match.
    """
    postings = defaultdict(list)
    for label, (template, _) in TEMPLATE_WORDS.items():
        order = sorted(range(len(template)), key=lambda i: (-idf.get(template[i], math.inf), template[i], i))
        for i in order[: len(template) - least_hits(template) + 2]:
            postings[template[i]].append((label, i))
    return postings


def least_hits(template: list[str]) -> int:
    return math.ceil(LEAST_SHARE * len(template))


def regions(votes: list[tuple[int, int]], template: list[str]) -> list[tuple[int, int]]:
    """Stretches of places outside which no match of the template lies; votes are (place, position) by place."""
    reach = (SHIFT + 1) * len(template)  # of a match
    out, first, last, seen = [], None, None, set()
    for place, position in [*votes, (math.inf, -1)]:
        if last is not None and place - last > reach:
            if len(seen) > 1:
                out.append((first - reach, last + reach))
            first, seen = None, set()
        first, last = place if first is None else first, place
        seen.add(position)
    return out


def chains(words: list[tuple[int, str]], template: list[str], spots: dict[str, list[int]]) -> list[tuple[int, int, int]]:
    """(hits, from, to) of every run of the template's words, in order, long enough to be a match.

    Starts (place less position) that are up to ``SHIFT`` words apart join, so a run goes on behind inserted or
    missing words; for each word it ends at, the run of most hits.
    """
    ends: dict[int, list] = defaultdict(list)  # by start: (place, hits, from), places and hits rising
    least, out = least_hits(template), []
    for place, word in words:
        added = []
        for i in spots.get(word, ()):
            start, best = place - i, (0, place - i)
            for near in range(start - SHIFT, start + SHIFT + 1):
                found = ends.get(near)
                if found:
                    # The last run that ends before this place and before this position of the template.
                    at = bisect_left(found, (min(place, i + near),)) - 1
                    if at >= 0 and found[at][1] > best[0]:
                        best = found[at][1:]
            added.append((start, (place, best[0] + 1, best[1])))
            if best[0] + 1 >= least:
                out.append((best[0] + 1, best[1], place + len(template) - i))
        for start, end in added:
            ends[start].append(end)
    return out


def scan(words, places, postings: dict[str, list[tuple[str, int]]]) -> tuple:
    """(n_base, first_word, last_word, base labels, all labels, score) of one file."""
    at = dict(zip(places, words))
    base = [(p, label) for phrase, label in BASE_PHRASES.items() for p in phrase_places(at, places, phrase)]
    labels = {label for _, label in base}
    votes = defaultdict(list)
    for place, word in zip(places, words):
        for label, position in postings.get(word, ()):
            votes[label].append((place, position))
    best, matched = 0.0, set()
    for label, cast in votes.items():
        template, phrases = TEMPLATE_WORDS[label]
        for low, high in regions(cast, template):
            near = [(p, at[p]) for p in places[bisect_left(places, low) : bisect_left(places, high + 1)]]
            inside = [p for p, _ in near]
            stand = [[(p, p + len(phrase.split())) for p in phrase_places(at, inside, phrase)] for phrase in phrases]
            if not all(stand):
                continue
            for hits, start, end in chains(near, template, SPOTS[label]):
                share = hits / len(template)
                if (label not in matched or share > best) and all(any(start <= a and b <= end for a, b in each) for each in stand):
                    matched.add(label)
                    best = max(best, share)
    starts = [p for p, _ in base]
    named = ",".join(sorted(labels))
    every = ",".join(sorted(labels | matched))
    score = max(best, 0.5 if base else 0.0)
    return len(base), min(starts, default=None), max(starts, default=None), named, every, score


TEMPLATE_WORDS = {label: (text.split(), phrases) for label, (text, phrases) in TEMPLATES.items()}
SPOTS: dict[str, dict[str, list[int]]] = {}  # per label, the positions of each word, last first
for _label, (_words, _) in TEMPLATE_WORDS.items():
    SPOTS[_label] = {word: [i for i in reversed(range(len(_words))) if _words[i] == word] for word in _words}

RESULT = "struct<n_base:long,first_word:long,last_word:long,base_labels:string,labels:string,score:double>"


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the base places and labels, and the labels of licence texts found, for every document.

    A word's IDF is over all documents. The words of the highest IDF of each template, as many as leave no match
    out, are its postings; where two or more stand near each other the file is aligned with the template. A match
    has most of the template's words in order, words may be inserted or missing between them, and every mandatory
    phrase stands inside it. The score is
    the best share of a template found, 0.5 if only a base phrase names a licence, else 0. Null and empty texts
    have no words, no labels and score 0. Other columns are not looked at.
    """
    rows = staged(docs.select("doc_id", licence_words(F.col("text")).alias("w")), "licences")
    counted = rows.select(F.explode(F.array_distinct("w.words")).alias("word")).groupBy("word").count().collect()  # the vocabulary
    total = rows.count()
    postings = anchors({row["word"]: math.log((total + 1) / (row["count"] + 1)) + 1 for row in counted})

    @F.pandas_udf(RESULT)
    def scanned(words: pd.Series, places: pd.Series) -> pd.DataFrame:
        out = [scan(list(w), [int(p) for p in at], postings) for w, at in zip(words, places)]
        frame = pd.DataFrame(out, columns=["n_base", "first_word", "last_word", "base_labels", "labels", "score"])
        return frame.astype({"first_word": "Int64", "last_word": "Int64"})

    return rows.select("doc_id", "w.n_words", scanned(F.col("w.words"), F.col("w.places")).alias("s")).select("doc_id", "n_words", "s.*")
