"""Fixtures and plain-Python versions of the contracts, for comparison."""

from __future__ import annotations

import itertools
import re
import string

AZ = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Extra columns whose names operators use inside.
CLASH_SCHEMA = DOC_SCHEMA + ", cls long, token string, n int, hash long, start long, score string, row_id int, w array<int>, `key` string"


def docs_of(spark, texts, clash=False, first_id=0):
    """Documents from texts, or (doc_id, text) pairs."""
    pairs = [t if isinstance(t, tuple) else (first_id + i, t) for i, t in enumerate(texts)]
    rows = [(d, t, "en", None, None if t is None else len(t)) + ((None, "x", 1, 2, 3, "y", 4, [1], None) if clash else ()) for d, t in pairs]
    return spark.createDataFrame(rows, CLASH_SCHEMA if clash else DOC_SCHEMA)


def odd_texts():
    """Null, empty, blank, very long, tied, repeated and non-Latin texts."""
    long = " ".join(f"word{i} tail{i % 97}" for i in range(30_000))
    return [None, "", " \t\n", "a", "One two three four", "one two  three\tfour", long, long + " end", "日本語 テキスト です\nßtraße É é",
            "x" * 50_000, "\n\n\n", "same text here for all of us", "same text here for all of us"]


def shingle_set(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1))


def components(pairs):
    """{doc_id: (n_shingles, component_id)} by comparing all pairs that share a shingle."""
    sets = {d: shingle_set(t) for d, t in pairs}
    holders = {}
    for d, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(d)
    common = {}
    for ds in holders.values():
        for a, b in itertools.combinations(ds, 2):
            common[a, b] = common.get((a, b), 0) + 1
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), c in common.items():
        if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), root(d)) for d in sets}
