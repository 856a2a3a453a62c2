from __future__ import annotations

import random
import re

from agendum.llm import license_scan as L
from tests.llm.helpers import AZ, docs_of, odd_texts


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))


def brute(text, percent=L.PERCENT):
    ws = words(text)
    starts, base = [], set()
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        for i in range(len(ws) - len(p) + 1):
            if ws[i:i + len(p)] == p:
                starts.append(i)
                base.add(label)
    labels, share = set(base), 0.0
    for line in (text or "").split("\n"):
        have = set(words(line))
        for label, template in L.TEMPLATES.items():
            want = set(words(template))
            if len(have & want) * 100 >= percent * len(want):
                labels.add(label)
                share = max(share, len(have & want) / len(want))
    return (len(ws), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)),
            max(share, 1.0 if starts else 0.0))


def scanned(df):
    return sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in L.scan(df).collect()), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(8)
    common = ["the", "this", "is", "of", "and", "under", "work", "license", "general", "public", "cc", "by", "4", "0"]
    texts = []
    for _ in range(150):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            line = rng.choices(common, k=rng.randrange(12))
            if rng.random() < 0.5:
                notice = rng.choice(list(L.TEMPLATES.values())).split()
                for _ in range(rng.randrange(5)):
                    notice[rng.randrange(len(notice))] = rng.choice(["foo", "the", "of"])
                line += notice
            if rng.random() < 0.2:
                line += ["All", "Rights", "Reserved."]
            lines.append(rng.choice([" ", "  ", ", ", "-"]).join(line))
        texts.append("\n".join(lines))
    texts += odd_texts()
    got = scanned(docs_of(spark, texts, clash=True).repartition(4))
    assert got == sorted(((i, *brute(t)) for i, t in enumerate(texts)), key=str)


def test_phrases_cross_lines_but_blocks_do_not(spark):
    texts = ["all rights\nreserved", "cc by cc by", "CC-BY 4.0", None]
    assert scanned(docs_of(spark, texts)) == sorted(((i, *brute(t)) for i, t in enumerate(texts)), key=str)


def test_repeated_rows_and_empty_table(spark):
    assert len(scanned(docs_of(spark, [(1, "all rights reserved"), (1, "all rights reserved"), (None, "")]))) == 3
    assert scanned(docs_of(spark, [])) == []
