"""Find license notices: winnowed fingerprints of templates pick candidates, banded alignment measures them.

Templates and texts are sequences of words. Of each run of WINDOW hashes of SHINGLE words a template keeps the least
(winnowing), in an inverted index from hash to template and position. Texts look their own winnowed hashes up; hits
with about the same shift are a chain, which is aligned once, and only where the text around it has enough in common with the
template. Templates so short that a match may share no run of a window's words with them are
looked for by each of their words instead. An alignment in a band around that shift counts the template's words that the text
has in order, and gives the place. The index holds templates only, so every task has it whole.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.hashing import STEP, U, hashed_words, mixed
from tidemark.llm.license_texts import TEXTS

SHINGLE, WINDOW, BAND = 3, 2, 6
#: Words are letters and digits of ASCII and all bytes beyond.
_GAP = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])

#: Short notices and beginnings of licences, by SPDX identifier; the whole texts and further notices of TEXTS come after them.
_NOTICES = {
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
}
TEMPLATES = {name: _NOTICES.get(name, []) + TEXTS.get(name, []) for name in sorted({*_NOTICES, *TEXTS})}


def needed(m: int, coverage: float) -> int:
    """The least number of matched words that is coverage of m."""
    return max(1, ceil(coverage * m - 1e-9))


def by_words(m: int, coverage: float) -> bool:
    """Whether coverage of a template of m words can be matched without a run that shares a fingerprint for certain."""
    gone = m - needed(m, coverage)
    return ceil((m - gone) / (gone + 1)) < SHINGLE + WINDOW - 1


def fingerprints(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed shingle hashes of texts and the number of their first word; words of a text follow each other."""
    n = len(words) - SHINGLE + 1
    if n < 1:
        return words[:0], np.zeros(0, np.int64)
    value = np.zeros(n, U)
    for k in range(SHINGLE):
        value = mixed(value * STEP[4] + words[k : k + n], 2)
    whole = text[:n] == text[SHINGLE - 1 :]
    starts = np.flatnonzero(whole)
    value, of = value[starts], text[starts]
    kept = np.zeros(len(value), bool)
    # The least of each window of neighbours, the last of equals; texts with fewer than a window keep their only one.
    for i in range(WINDOW - 1):
        right = np.zeros(len(value), bool)
        right[: -i - 1] = of[: -i - 1] == of[i + 1 :]
        later = np.flatnonzero(right)
        less = value[later] < value[later + i + 1]
        kept[later[less]] = True
        kept[later[~less] + i + 1] = True
    alone = np.ones(len(value), bool)
    alone[1:] &= of[1:] != of[:-1]
    alone[:-1] &= of[:-1] != of[1:]
    kept |= alone
    return value[kept], starts[kept]


def aligned(template: np.ndarray, words: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """Template words that words has in order, and the first and last of these in words, from an alignment whose shift
    stays within band of shift. A matched word counts 2, a word left out on either side -1 once both sides have begun."""
    m, n = len(template), len(words)
    width = 2 * band + 1
    low = -10**9
    score = np.full((m + 1, width + 2), low)
    score[0, 1 : width + 1] = 0  # the match may begin anywhere
    step = np.zeros((m + 1, width + 2), np.int8)
    place, reach = np.arange(shift - band, shift - band + m + width - 1), np.arange(width)
    inside = (place >= 0) & (place < n)
    near = words[np.clip(place, 0, n - 1)]
    for i in range(1, m + 1):  # column k has template word i - 1 at words i - 1 + shift + k - 1 - band
        same = (near[i - 1 : i - 1 + width] == template[i - 1]) & inside[i - 1 : i - 1 + width]
        both = score[i - 1, 1 : width + 1] + np.where(same, 2, -1)
        gone = score[i - 1, 2:] - 1  # left out of the text
        best = np.maximum.accumulate(np.maximum(both, gone) + reach) - reach  # with words more in the text
        score[i, 1 : width + 1] = best
        step[i, 1 : width + 1] = np.where(best == both, 0, np.where(best == gone, 1, 2))
    best = np.flatnonzero(score[m] == score[m, 1 : width + 1].max())
    i, k = m, int(best[np.argmin(np.abs(best - band - 1))])  # of equal ends the one nearest to shift
    count, first, last = 0, -1, -1
    while i > 0 and k > 0:
        if step[i, k] == 0:
            j = i - 1 + shift + k - 1 - band
            if 0 <= j < n and template[i - 1] == words[j]:
                count, first, last = count + 1, j, max(last, j)
            i -= 1
        elif step[i, k] == 1:
            i, k = i - 1, k + 1
        else:
            k -= 1
    return count, first, last


def places(template: np.ndarray) -> dict[int, int]:
    """The places of each word in template, as bits."""
    out: dict[int, int] = {}
    for i, word in enumerate(template.tolist()):
        out[word] = out.get(word, 0) | 1 << i
    return out


def common(at: Mapping[int, int], m: int, words: list[int]) -> int:
    """Words of the longest common subsequence of words and a template of m words (at: its places), a row of the table at a time
    as bits of one number: no alignment matches more."""
    whole = (1 << m) - 1
    apart = whole
    for here in filter(None, map(at.get, words)):
        hit = apart & here
        apart = (apart + hit | apart - hit) & whole
    return m - apart.bit_count()


def chains(shifts: Mapping[int, int], words: list[int], at: Mapping[int, int], m: int, need: int, band: int) -> list[list[int]]:
    """Groups of hits by shift whose alignments may match need words, each no wider than band, with the best supported shift first.

    shifts: hits by shift. A stretch of shifts goes as a whole where all the text it reaches has too little in common with the template,
    and else is halved.
    """
    s = sorted(shifts)
    near = np.concatenate([[0], np.cumsum([shifts[x] for x in s])])
    low, high = np.searchsorted(s, np.array(s) - band), np.searchsorted(s, np.array(s) + band, "right")
    support = dict(zip(s, (near[high] - near[low]).tolist(), strict=True))
    edges = [0, *(i for i in range(1, len(s)) if (s[i] - s[0]) // (m + band) != (s[i - 1] - s[0]) // (m + band)), len(s)]
    stack, out = [(a, b) for a, b in zip(edges, edges[1:], strict=False)], []
    while stack:
        a, b = stack.pop()
        if common(at, m, words[max(0, s[a] - band) : max(0, s[b - 1] + m + band)]) < need:
            continue
        if s[b - 1] - s[a] <= band:
            out.append(sorted(s[a:b], key=lambda x: (-support[x], x)))
        else:
            middle = next(i for i in range(a + 1, b) if 2 * s[i] > s[a] + s[b - 1])
            stack += [(a, middle), (middle, b)]
    return sorted(out, key=lambda group: (-support[group[0]], group[0]))


def room(start: int, stop: int, taken: list[tuple[int, int]]) -> int:
    """Words in the longest stretch from start to stop outside the spans of taken."""
    best = 0
    for i, j in sorted(taken):
        best, start = max(best, min(i, stop) - start), max(start, j + 1)
    return max(best, stop - start)


def found_notices(docs: DataFrame, templates: Mapping[str, list[str]] = TEMPLATES, coverage: float = 0.8) -> DataFrame:
    """doc_id, license, template, matched, coverage, start, stop of each notice found in docs (doc_id, text).

    matched is the number of template words aligned, coverage their share of the template, start and stop the byte range of
    the text from the first to the last of them. Of notices that overlap in a text the one with more matched words stays,
    then the one with more coverage, the earlier, and by name. An alignment's shift may drift by BAND words, or a fiftieth of a
    longer template, for certain, and by twice as much where its chain has no nearer one. Null and empty texts have none. Rows that share a doc_id are texts of their own; a null
    doc_id stays null. Other columns are left out. No rows: no rows. Templates under three words are refused.
    """
    names = [(name, i, text) for name, texts in sorted(templates.items()) for i, text in enumerate(texts)]
    words, of, _, _ = hashed_words([t for _, _, t in names], _GAP)
    bodies = [words[of == i] for i in range(len(names))]
    if any(len(b) < SHINGLE for b in bodies):
        raise ValueError(f"a template has fewer than {SHINGLE} words")
    starts = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
    index = defaultdict(list)
    for value, at in zip(*(x.tolist() for x in fingerprints(words, of)), strict=True):
        index[value].append((int(of[at]), at - int(starts[of[at]])))
    bands = [max(BAND, len(b) // 50) for b in bodies]
    short = [k for k, b in enumerate(bodies) if by_words(len(b), coverage)]
    seeds = np.unique(np.concatenate([words[:0], *(bodies[k] for k in short)]))
    member = np.array([np.isin(seeds, bodies[k]) for k in short]).reshape(len(short), len(seeds))
    bags = [Counter(b.tolist()) for b in bodies]
    known = np.array(sorted(index), U)
    postings = dict(index)

    where: dict[int, dict[int, int]] = {}  # of the templates that a task meets

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lengths = frame["text"].str.len().fillna(0).to_numpy(float)
            out = []
            for _, part in frame.groupby(np.cumsum(lengths) // 2_000_000, sort=False):
                word, text, begin, stop = hashed_words(part["text"].tolist(), _GAP)
                values, at = fingerprints(word, text)
                place = np.searchsorted(known, values)
                hit = np.flatnonzero(known[np.minimum(place, len(known) - 1)] == values) if len(known) else []
                edges = np.searchsorted(text, np.arange(len(part) + 1))
                shifts = defaultdict(Counter)
                for h in hit:
                    one = int(text[at[h]])
                    for number, position in postings[int(values[h])]:
                        shifts[one, number][int(at[h] - edges[one]) - position] += 1
                place = np.searchsorted(seeds, word)
                seed = np.flatnonzero(seeds[np.minimum(place, len(seeds) - 1)] == word) if len(seeds) else np.zeros(0, np.int64)
                for k, number in enumerate(short):
                    body, spots = bodies[number], seed[member[k][place[seed]]]
                    need, reach = needed(len(body), coverage), len(body) + 2 * bands[number]
                    first, last = spots[: max(0, len(spots) - need + 1)], spots[need - 1 :]
                    for i in first[(last - first < reach) & (text[last] == text[first])].tolist():
                        stop_ = min(i + reach, int(edges[text[i] + 1]))
                        if sum((Counter(word[i:stop_].tolist()) & bags[number]).values()) >= need:
                            one = int(text[i])
                            for j in range(i, stop_):
                                shifts[one, number].update((j - int(edges[one]) - np.flatnonzero(body == word[j])).tolist())
                found = defaultdict(list)
                owns: dict[int, list[int]] = {}
                for one, number in sorted(shifts):
                    if one not in owns:
                        owns = {one: word[edges[one] : edges[one + 1]].tolist()}
                        bag = Counter(owns[one])
                    body, own, m, band = bodies[number], owns[one], len(bodies[number]), bands[number]
                    need, spans_ = needed(m, coverage), []
                    if sum(min(n, bag[w]) for w, n in bags[number].items()) < need:  # too few of its words in the whole text
                        continue
                    if number not in where:
                        where[number] = places(body)
                    for group in chains(shifts[one, number], own, where[number], m, need, band):
                        for k, shift in enumerate(group):
                            if room(max(0, shift - band), min(len(own), shift + m + band), spans_) < need:
                                continue
                            count, i, j = aligned(body, word[edges[one] : edges[one + 1]], shift, band)
                            if count < need and k == 0:  # once for all of the group
                                count, i, j = aligned(body, word[edges[one] : edges[one + 1]], shift, 2 * band)
                                if count < need:
                                    break
                            if count >= need:
                                spans_.append((i, j))
                                found[one].append((-count, m, i, number, j))
                for one, matches in found.items():
                    taken = []
                    for count, _, i, number, j in sorted(set(matches)):
                        if all(j < a or i > b for a, b in taken):
                            taken.append((i, j))
                            doc_id, name, e = part["doc_id"].iloc[one], names[number], edges[one]
                            out.append((None if pd.isna(doc_id) else int(doc_id), name[0], name[1], -count, -count / len(bodies[number]), int(begin[e + i]), int(stop[e + j])))
            got = pd.DataFrame(out, columns=["doc_id", "license", "template", "matched", "coverage", "start", "stop"])
            yield got.assign(doc_id=got["doc_id"].astype("Int64"))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(scan, "doc_id long, license string, template int, matched long, coverage double, start long, stop long")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_notices(table(spark, sf_dir, "documents"))
