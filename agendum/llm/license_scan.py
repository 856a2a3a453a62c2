"""License scans: an exact set-similarity join of text blocks and templates.

A block meets a template when at least ``percent`` % of the template's distinct
words are in it. There are two kinds of blocks. For ``scan_windows`` they are
windows over a text's words, whatever lines these stand in, so that wrapped
notices are found: one opens at every word and is twice the template's words long,
``ROOM`` words more at least. The words a window has in common with the template,
from the first to the last, are a placement. Where a template's words are all in a
larger one's, and placements of both share a word, only the one counts that is
more like its template, by words in order; a tie is the smaller's.

For ``scan`` a block is a line of a text; its set holds the line's distinct words.
Tokens are ordered by their frequency over all lines, rare first:

1. one pass counts, over all rows, in how many blocks each template word stands;
2. a template's first n - ceil(percent * n / 100) + 1 tokens in that order are its
   prefix. A block that meets the template has a token of the prefix (prefix
   filter), has at least ceil(percent * n / 100) words (length filter) and enough
   template words from its first common token on (positional filter);
3. one pass keeps of each block that has any prefix token its template words, and
   finds the base phrases; Spark joins blocks and prefixes on the token, applies
   the filters, and counts the common words of what is left once.

``scan_windows`` takes the same order, prefixes and filters to leave out windows, and
counts the common words of the rest where the text is.

Templates are a parameter, so their index is broadcast; its size doesn't depend
on the data. The join yields at most one row per (block, template).

Edge cases: a null or empty text has no words, no labels and score 0; rows are
numbered, so repeated rows are scanned as often as they occur; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agendum.llm.storage import cut, ship_code
from agendum.llm.wordhash import NOT_ALNUM, slices, words

PERCENT = 80
# A window has as many words as its template once more, or this many if they are more.
ROOM = 4
WINDOWS = 20_000    # compared at a time

# The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Opening sentences and short forms of common notices, with a label of our own each.
TEMPLATES = {
    "cc-by-notice": "licensed under cc by 4 0",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-sa-short": "licensed under cc by sa 4 0",
    "cc-by-nd-short": "licensed under cc by nd 4 0",
    "cc-by-nc-sa-short": "licensed under cc by nc sa 4 0",
    "cc-by-nc-nd-short": "licensed under cc by nc nd 4 0",
    "cc-by-sa-notice": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "gpl-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-software": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-short": "under the mit license",
    "apache-short": "under the apache license",
    "apache-notice": "licensed under the apache license version 2 0 you may not use this file except in compliance with the license",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "reserved-notice": "all rights reserved",
    "public-domain": "this work is dedicated to the public domain",
}


def word_hashes(text: str) -> list[int]:
    raw = np.frombuffer(text.encode(), np.uint8)
    return words(raw, np.array([0, len(raw)]), NOT_ALNUM)[0].tolist()


def _vocabulary(templates: dict[str, str]) -> np.ndarray:
    return np.array(sorted({h for t in templates.values() for h in word_hashes(t)}), np.uint64)


def _block_tokens(data, off, vocabulary):
    """(word count per text, word hashes, first word per text, (block, token) of distinct template words, sizes of blocks, text of blocks)."""
    h, start, _, text = words(data, off, NOT_ALNUM)
    n = np.bincount(text, minlength=len(off) - 1)
    line = np.cumsum(np.concatenate(([0], data[:-1] == 0x0A)))[start] if len(data) else start
    new = np.append(True, (line[1:] != line[:-1]) | (text[1:] != text[:-1])) if len(h) else np.zeros(0, bool)
    block = np.cumsum(new) - 1
    at = np.searchsorted(vocabulary, h)
    at[at == len(vocabulary)] = 0
    known = np.flatnonzero(vocabulary[at] == h)
    pair = np.unique(block[known] * len(vocabulary) + at[known])
    return n, h, start, text, new, block, pair // len(vocabulary), pair % len(vocabulary)


def _count(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(vocabulary), np.int64)
    for batch in batches:
        for _, _, data, off in slices(batch.column(0)):
            token = _block_tokens(data, off, vocabulary)[-1]
            total += np.bincount(token, minlength=len(vocabulary))
    yield pa.RecordBatch.from_arrays([pa.array(range(len(vocabulary)), pa.int32()), pa.array(total)], names=["token", "n"])


def frequency_order(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Rank of each template word, rarest first (ties by hash)."""
    counts = np.zeros(len(vocabulary), np.int64)
    for r in docs.select("text").mapInArrow(lambda b: _count(b, vocabulary), "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():
        counts[r.token] = r.n    # one row per template word
    rank = np.empty(len(vocabulary), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(vocabulary))
    return rank


def _phrase_places(h: np.ndarray, text: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Numbers (over all words given) of the words that open the phrase."""
    k = len(phrase)
    if len(h) < k:
        return np.zeros(0, np.int64)
    ok = text[:len(h) - k + 1] == text[k - 1:]
    for i, p in enumerate(phrase):
        ok &= h[i:len(h) - k + 1 + i] == np.uint64(p)
    return np.flatnonzero(ok)


def _base(h: np.ndarray, text: np.ndarray, rows: int, phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[set]]:
    """(number of base phrases, first and last place of one or -1, labels) of each text."""
    n_base, lo, hi, labels = np.zeros(rows, np.int64), np.full(rows, -1), np.full(rows, -1), [set() for _ in range(rows)]
    first_of_text = np.searchsorted(text, np.arange(rows))
    for phrase, label in phrases:
        at = _phrase_places(h, text, phrase)
        t = text[at]
        place = at - first_of_text[t]
        n_base += np.bincount(t, minlength=rows)
        for r, p in zip(t.tolist(), place.tolist(), strict=True):
            lo[r] = p if lo[r] < 0 else min(lo[r], p)
            hi[r] = max(hi[r], p)
            labels[r].add(label)
    return n_base, lo, hi, labels


SCAN = "row_id long, doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, blocks array<struct<words:int,tokens:array<int>>>"


def _scan(batches: Iterator[pa.RecordBatch], vocabulary, rank, in_prefix, phrases) -> Iterator[pa.RecordBatch]:
    block_type = pa.list_(pa.struct([("words", pa.int32()), ("tokens", pa.list_(pa.int32()))]))
    for batch in batches:
        for i, j, data, off in slices(batch.column(2)):
            n, h, _, text, new, block, b, token = _block_tokens(data, off, vocabulary)
            rows = j - i
            n_base, lo, hi, labels = _base(h, text, rows, phrases)
            # Blocks with a prefix token, with all their template words by rank.
            found: list[list] = [[] for _ in range(rows)]
            head = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, np.int64)
            if len(head):
                r = rank[token]
                any_prefix = np.logical_or.reduceat(in_prefix[r], head)
                ends = np.append(head[1:], len(b))
                block_head = np.flatnonzero(new)
                block_end = np.append(block_head[1:], len(h))
                for k in np.flatnonzero(any_prefix):
                    at = b[head[k]]
                    s, e = block_head[at], block_end[at]
                    found[text[s]].append({"words": len(np.unique(h[s:e])), "tokens": np.sort(r[head[k]:ends[k]]).tolist()})
            none = lo < 0
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(i, rows), batch.column(1).slice(i, rows), pa.array(n.astype(np.int64)), pa.array(n_base),
                pa.array(lo, pa.int64(), mask=none), pa.array(hi, pa.int64(), mask=none),
                pa.array([",".join(sorted(x)) for x in labels]), pa.array(found, block_type)], names=[c.split(" ")[0] for c in SCAN.split(", ")])


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score
    and matches (label and share of its words, per met template) of every row."""
    spark = docs.sparkSession
    ship_code(spark)
    vocabulary = _vocabulary(templates)
    rank = frequency_order(docs, vocabulary)
    at = {int(h): int(r) for h, r in zip(vocabulary, rank, strict=True)}
    index, in_prefix = [], np.zeros(len(vocabulary), bool)
    for label, text in templates.items():
        tokens = sorted({at[h] for h in word_hashes(text)})
        need = -(-len(tokens) * percent // 100)
        for place, token in enumerate(tokens[:len(tokens) - need + 1]):
            index.append((token, label, place, len(tokens), need, tokens))
            in_prefix[token] = True
    prefixes = F.broadcast(spark.createDataFrame(index, "token int, label string, place int, size int, need int, template array<int>"))
    open_phrases = [(word_hashes(p), label) for p, label in phrases.items()]

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        lambda b: _scan(b, vocabulary, rank, in_prefix, open_phrases), SCAN)
    rows = cut(rows, "license-scan")
    hits = (rows.select("row_id", F.posexplode("blocks").alias("block", "b"))
            .select("row_id", "block", "b.words", "b.tokens", F.explode("b.tokens").alias("token"))
            .join(prefixes, "token")
            .where("words >= need")
            # From this token on: what the template and the block still have in common at most.
            .where(F.least(F.col("size") - F.col("place"), F.size(F.filter("tokens", lambda x: x >= F.col("token")))) >= F.col("need"))
            .select("row_id", "block", "label", "size", "need", F.size(F.array_intersect("tokens", "template")).alias("common")).distinct()
            .where("common >= need")
            .groupBy("row_id").agg(F.collect_set("label").alias("found"), F.max(F.col("common") / F.col("size")).alias("share")))
    base = F.filter(F.split("base_labels", ","), lambda x: x != "")
    return (rows.join(hits, "row_id", "left")
            .withColumn("labels", F.array_join(F.array_sort(F.array_union(base, F.coalesce("found", F.array().cast("array<string>")))), ","))
            .select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels",
                    F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"),
                    F.coalesce("found", F.array().cast("array<string>")).alias("matches")))


# --- windows ---

def _placements(token: np.ndarray, text: np.ndarray, known: np.ndarray, tokens: np.ndarray, length: int, need: int, n_tokens: int) -> list[tuple[int, int, int, int]]:
    """(text, first word, last word, common words) of the template's placements.
    ``token``: rank of each word or -1; ``known``: the words with a rank;
    ``tokens``: the template's ranks, ascending."""
    own = np.full(n_tokens + 1, -1)     # the last place: words without a rank
    own[tokens] = np.arange(len(tokens))
    pos = known[own[token[known]] >= 0]
    kind = own[token[pos]]
    if len(pos) < need:
        return []
    # Windows that open at a template word: enough of them, and one of the prefix.
    opens = np.arange(len(pos) - need + 1)
    last = opens + need - 1
    rare = np.flatnonzero(kind <= len(tokens) - need)
    following = np.append(pos[rare], len(token) + length)[np.searchsorted(rare, opens)]
    opens = opens[(pos[last] - pos[opens] < length) & (text[pos[last]] == text[pos[opens]]) & (following - pos[opens] < length)]
    found = []
    for i in range(0, len(opens), WINDOWS):
        k = opens[i:i + WINDOWS]
        at = k[:, None] + np.arange(length)
        inside = at < len(pos)
        at = np.minimum(at, len(pos) - 1)
        place = pos[at]
        inside &= (place - pos[k][:, None] < length) & (text[place] == text[pos[k]][:, None])
        seen = np.where(inside, kind[at], -1)
        order = np.argsort(seen, axis=1, kind="stable")
        seen = np.take_along_axis(seen, order, 1)
        first = seen >= 0
        first[:, 1:] &= seen[:, 1:] != seen[:, :-1]
        common = first.sum(1)
        end = np.where(first, np.take_along_axis(place, order, 1), -1).max(1)
        met = common >= need
        found += zip(text[pos[k]][met].tolist(), pos[k][met].tolist(), end[met].tolist(), common[met].tolist(), strict=True)
    # One that holds a shorter one with no fewer common words says nothing more.
    kept: list[tuple[int, int, int, int]] = []
    for x in reversed(found):
        inner = False
        for y in reversed(kept):
            if y[1] > x[2]:
                break
            if y[2] <= x[2] and y[3] >= x[3]:
                inner = True
                break
        if not inner:
            kept.append(x)
    return kept[::-1]


def _touching(large: list, small: list, length: int) -> list[list[int]]:
    """For each large placement the numbers of the small ones, of ``length`` words at
    most, that share a word with it; both by first word."""
    firsts = [x[1] for x in small]
    return [[k for k in range(bisect_right(firsts, s - length), bisect_right(firsts, e)) if small[k][2] >= s] for _, s, e, _ in large]


def _likeness(run: list[int], template: list[int]) -> int:
    """Words in common in their order, less those put in and those left out."""
    row = [0] * (len(template) + 1)
    for x in run:
        before = 0
        for k, y in enumerate(template, 1):
            before, row[k] = row[k], before + 1 if x == y else max(row[k], row[k - 1])
    return 3 * row[-1] - len(run) - len(template)


def _standing(token: np.ndarray, found: dict[str, list], index: dict[str, tuple]) -> dict[str, list]:
    """The placements without those of templates that another one, larger or smaller, explains."""
    drop: dict[str, set[int]] = {label: set() for label in found}
    like = lambda label, x: _likeness(token[x[1]:x[2] + 1].tolist(), index[label][3])
    for large in found:
        for small in found:
            if index[small][0].keys() < index[large][0].keys():
                for k, held in enumerate(_touching(found[large], found[small], index[small][1])):
                    if held:
                        whole = like(large, found[large][k])
                        less = [x for x in held if like(small, found[small][x]) < whole]
                        drop[small].update(less)
                        if len(less) < len(held):
                            drop[large].add(k)
    return {label: [x for k, x in enumerate(xs) if k not in drop[label]] for label, xs in found.items()}


WINDOW_SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<string>"


def _scan_windows(batches: Iterator[pa.RecordBatch], vocabulary, rank, index, phrases) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, off in slices(batch.column(1)):
            h, _, _, text = words(data, off, NOT_ALNUM)
            rows = j - i
            n_base, lo, hi, base = _base(h, text, rows, phrases)
            at = np.searchsorted(vocabulary, h)
            at[at == len(vocabulary)] = 0
            token = np.where(vocabulary[at] == h, rank[at], -1)
            known = np.flatnonzero(token >= 0)
            found = {}
            for label, (own, length, need, _) in index.items():
                if places := _placements(token, text, known, np.array(list(own)), length, need, len(vocabulary)):
                    found[label] = places
            share, labels = (n_base > 0).astype(float), [set() for _ in range(rows)]
            for label, places in _standing(token, found, index).items():
                for t, _, _, common in places:
                    labels[t].add(label)
                    share[t] = max(share[t], common / len(index[label][0]))
            none = lo < 0
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(i, rows), pa.array(np.bincount(text, minlength=rows).astype(np.int64)), pa.array(n_base),
                pa.array(lo, pa.int64(), mask=none), pa.array(hi, pa.int64(), mask=none), pa.array([",".join(sorted(x)) for x in base], pa.string()),
                pa.array([",".join(sorted(x | y)) for x, y in zip(base, labels, strict=True)], pa.string()), pa.array(share),
                pa.array([sorted(x) for x in labels], pa.list_(pa.string()))], names=[c.split(" ")[0] for c in WINDOW_SCAN.split(", ")])


def scan_windows(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, percent: int = PERCENT) -> DataFrame:
    """The columns of ``scan``, with windows as blocks: notices may cross lines,
    and of templates that hold one another the one that stands there counts."""
    ship_code(docs.sparkSession)
    vocabulary = _vocabulary(templates)
    rank = frequency_order(docs, vocabulary)
    at = {int(h): int(r) for h, r in zip(vocabulary, rank, strict=True)}
    index = {}
    for label, text in templates.items():
        hashes = word_hashes(text)
        own = dict.fromkeys(sorted({at[h] for h in hashes}))
        index[label] = (own, len(hashes) + max(len(hashes), ROOM), -(-len(own) * percent // 100), [at[h] for h in hashes])
    open_phrases = [(word_hashes(p), label) for p, label in phrases.items()]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        lambda b: _scan_windows(b, vocabulary, rank, index, open_phrases), WINDOW_SCAN)
