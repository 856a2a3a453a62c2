"""Notices as windows over the words: across lines, short forms, nested templates."""

from __future__ import annotations

import random
import re

import pytest

from agendum.llm import license_scan as L
from tests.llm.helpers import docs_of, odd_texts
from tests.llm.test_license_scan import words

LONG = [k for k, t in L.TEMPLATES.items() if len(t.split()) >= 14]


def found(spark, texts):
    return {r.doc_id: r.matches for r in L.scan_windows(docs_of(spark, texts)).collect()}


def wrapped(text, width):
    return re.sub(rf"(.{{1,{width}}})(\s|$)", r" * \1\n", text)


@pytest.mark.parametrize("width", [20, 40, 60])
def test_wrapped_notices(spark, width):
    rng = random.Random(width)
    filler = lambda: "\n".join(" ".join(rng.choices(["kalo", "mir", "tensaru", "the", "of"], k=8)) for _ in range(rng.randrange(4)))
    texts = [f"{filler()}\n{wrapped(L.TEMPLATES[k], width)}\n{filler()}" for k in LONG]
    assert found(spark, texts) == {i: [k] for i, k in enumerate(LONG)}


def test_short_forms_and_nested_templates(spark):
    cases = {
        "Released under the MIT License.": ["mit-short"],
        "Licensed under the Apache License, Version 2.0.": ["apache-short"],
        L.TEMPLATES["apache-notice"]: ["apache-notice"],
        "Licensed under CC BY 4.0.": ["cc-by-notice"],
        "Licensed under CC BY-NC 4.0.": ["cc-by-nc-notice"],
        "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.": ["cc-by-nc-notice"],
        "Licensed under CC BY-SA 4.0.": ["cc-by-sa-short"],
        "Licensed under CC BY-NC-ND 4.0.": ["cc-by-nc-nd-short"],
        "Licensed under CC BY 4.0.\nLicensed under CC BY-NC 4.0.": ["cc-by-nc-notice", "cc-by-notice"],
        "Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0.": ["cc-by-nc-notice", "cc-by-notice"],
        "sa nd Licensed under CC BY-NC 4.0. Sa kalo nd mir.": ["cc-by-nc-notice"],
        "Licensed under the MIT License and the Apache License.": ["apache-short", "mit-short"],
        "Released under the BSD License.": [],
        "under the mit": [],
        "license": [],
        "All rights are hereby\nreserved.": ["reserved-notice"],
        "all " + "kalo " * 30 + "rights reserved": [],
    }
    assert found(spark, list(cases)) == dict(enumerate(cases.values()))


def test_placements_equal_brute_force():
    """A template is met exactly when some window of its length has enough of its words."""
    rng = random.Random(5)
    want = ["a", "b", "c", "d", "e", "f"]
    need, length = 5, 9
    for _ in range(300):
        texts = [rng.choices(["a", "b", "c", "d", "e", "f", "x", "y"], k=rng.randrange(25)) for _ in range(4)]
        flat = [(t, w) for t, ws in enumerate(texts) for w in ws]
        token = L.np.array([want.index(w) if w in want else -1 for _, w in flat], L.np.int64)
        text = L.np.array([t for t, _ in flat], L.np.int64)
        got = L._placements(token, text, L.np.flatnonzero(token >= 0), L.np.arange(6), length, need, 6)
        met = {t for t, ws in enumerate(texts) for i in range(len(ws)) if len(set(ws[i:i + length]) & set(want)) >= need}
        assert {x[0] for x in got} == met
        for t, s, e, common in got:
            assert e - s < length and set(text[s:e + 1]) == {t} and len({int(x) for x in token[s:e + 1]} - {-1}) == common


def test_other_columns_equal_the_line_form(spark):
    texts = ["all rights\nreserved", "cc by cc by", "CC-BY 4.0", *odd_texts()]
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    docs = docs_of(spark, texts, clash=True).repartition(4)
    assert sorted(L.scan_windows(docs).select(columns).collect(), key=str) == sorted(L.scan(docs).select(columns).collect(), key=str)
    assert [len(words(t)) for t in texts] == [r.n_words for r in sorted(L.scan_windows(docs).collect())]
    assert L.scan_windows(docs_of(spark, [])).collect() == []
    assert L.scan_windows(docs_of(spark, [(1, "all rights reserved")] * 2 + [(None, "")])).count() == 3
