from __future__ import annotations

import random
import re
import time

from agendum.llm import pii
from pyspark.sql import functions as F
from tests.llm.helpers import docs_of, odd_texts

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))
                    or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


def brute_context(texts):
    """The spans of kind ``context``: words one by one, the graph in dictionaries."""
    seen = []
    for t, text in enumerate(texts):
        tried = []
        for kind, pattern in BASE.items():
            for m in re.finditer(pattern, text or ""):
                n = len(re.sub("[^0-9]", "", m.group()))
                if kind != "card" or n >= 13:
                    tried.append((m.start(), m.end(), (kind, m.start(), m.end()) in brute(text)))
        words = list(re.finditer(r"[^ \t\n\x0b\f\r]+", text or ""))
        plain = [re.sub("[0-9]", "0", w.group()).lower() for w in words]
        for i, w in enumerate(words):
            if not re.search("[0-9]", w.group()):
                continue
            inner = [j for j, c in enumerate(w.group()) if c.isalnum()]
            start, end = w.start() + inner[0], w.start() + inner[-1] + 1
            hit = {ok for lo, hi, ok in tried if lo < end and hi > start}
            patterns = ({"<1 " + plain[i - 1]} if i else set()) | ({f"<2 {plain[i - 2]} {plain[i - 1]}"} if i > 1 else set())
            patterns |= {">1 " + plain[i + 1]} if i + 1 < len(words) else set()
            seen.append((t, text[start:end], start, end, True in hit, hit == {False}, patterns))
    fixed, edges = {}, {}
    for _, m, _, _, known, failed, patterns in seen:
        secret = any(len(r) >= 20 and len(re.findall("[0-9]+", r)) >= 4 for r in re.findall("[A-Za-z0-9_-]+", m))
        if known or secret:
            fixed[m] = 1.0
        elif failed:
            fixed.setdefault(m, 0.0)
        for p in patterns:
            edges.setdefault(p, set()).add(m)
    score, best = dict(fixed), {}
    for _ in range(pii.ROUNDS):
        best = {}
        for ms in edges.values():
            values = [score.get(m, 0.0) for m in ms]
            if sum(v >= pii.ACCEPT for v in values) >= pii.MIN_SEEDS:
                for m in ms:
                    best[m] = max(best.get(m, 0.0), sum(values) / (len(ms) + 1))
        score = best | fixed
    return {(t, s, e) for t, m, s, e, known, failed, _ in seen
            if not known and not failed and len(m) >= pii.MIN_LENGTH and best.get(m, 0.0) >= pii.ACCEPT}


def found(df):
    return {r.doc_id: ([tuple(s) for s in r.base], [tuple(s) for s in r.spans]) for r in pii.find_personal_data(df).collect()}


def test_base_spans_equal_plain_regular_expressions(spark):
    rng = random.Random(9)
    parts = ["a.b@c.de", "x@y", "@z.com", "_%+q@h-1.org.uk_w@k.io", "10.0.0.1", "256.1.1.1", "1.2.3.4.5.6.7.8", "001.02.3.0004", "4111 1111 1111 1111", "4111-1111-1111-1112",
             "79927398713", "0000 0000 0000 0", "+1 (415) 555-0100", "+44 20 7946 0958.", "+12", "é", "日", "😀", " ", "\n", "word", "3", "-", ".", "(", "+", "1" * 25]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " ", ", "]) for _ in range(rng.randrange(14))) for _ in range(250)] + odd_texts()
    got = found(docs_of(spark, texts, clash=True).repartition(4))
    assert {d: base for d, (base, _) in got.items()} == {i: brute(t) for i, t in enumerate(texts)}


def test_method_adds_spans_and_keeps_base_ones(spark):
    rng = random.Random(10)
    texts = []
    for i in range(60):
        filler = " ".join(rng.choice(["some", "plain", "words", "chapter 7", "page 12"]) for _ in range(8))
        texts.append(f"{filler} contact address: user{i}@mail.example.com thanks")
    texts += [f"nothing else, contact address: KX-{i}99-AB thanks" for i in range(10)] + ["see chapter 123456789 soon"]
    got = found(docs_of(spark, texts))
    for d, (base, spans) in got.items():
        assert [s for s in spans if s[0] != pii.FOUND] == base
    for i in range(60, 70):
        at = texts[i].index("KX-")
        assert got[i][1] == [(pii.FOUND, at, texts[i].index(" thanks"))]
    assert got[70][1] == []


def test_long_runs_take_linear_time(spark):
    texts = ["a" * 400_000, "1" * 200_000, "1." * 100_000, "1 " * 100_000, "+1" + "(" * 200_000, "a@" + "b." * 100_000]
    t = time.time()
    rows = pii.find_personal_data(docs_of(spark, texts)).select("doc_id", F.size("base").alias("n")).collect()
    assert time.time() - t < 60 and len(rows) == 6


def test_repeated_rows_and_empty_table(spark):
    rows = pii.find_personal_data(docs_of(spark, [(1, "a@b.cd"), (1, "a@b.cd"), (None, None)])).collect()
    assert sorted(len(r.base) for r in rows) == [0, 1, 1]
    assert pii.find_personal_data(docs_of(spark, [])).count() == 0


def test_plans_stay_native(spark):
    plan = pii.find_personal_data(docs_of(spark, ["a@b.cd"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_context_spans_equal_a_graph_in_dictionaries(spark):
    rng = random.Random(21)
    def piece():
        kind = rng.randrange(9)
        if kind == 0:
            return f"account no. AC-{rng.randrange(10**6):06d}-{rng.choice('XYZ')}"
        if kind == 1:
            return f"account no. user{rng.randrange(99)}@mail.example.org,"
        if kind == 2:
            return 'key = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"' + rng.choice(["", "##", ";"])
        if kind == 3:
            return "paid by " + "".join(rng.choice("0123456789") for _ in range(16))
        if kind == 4:
            return f"node {rng.randrange(400)}.{rng.randrange(300)}.1.{rng.randrange(300)} up"
        if kind == 5:
            return f"ID {rng.randrange(100)} no. KX-{rng.randrange(10**5):05d}"
        return rng.choice(["in 2019 we", "of the", "chapter 123456 on", "é 日 😀", "\n", "no. of", "a  b"])
    texts = [" ".join(piece() for _ in range(rng.randrange(1, 9))) for _ in range(220)] + ["x" * 30_000 + " account no. " + "9Q" * 40_000]
    got = found(docs_of(spark, texts))
    mine = {(d, s, e) for d, (_, spans) in got.items() for kind, s, e in spans if kind == pii.FOUND}
    want = brute_context(texts)
    assert mine == want and len(want) > 40


def test_secrets_are_found_and_failed_cards_are_not(spark):
    rng = random.Random(22)
    texts, secrets, cards = [], {}, {}
    for i in range(240):
        word = lambda: "".join(rng.choice("abcdeinorst") for _ in range(rng.randrange(2, 9)))
        filler = [word() for _ in range(30)]
        secret = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        card = "4" + "".join(rng.choice("0123456789") for _ in range(15))
        while luhn(card):
            card = "4" + "".join(rng.choice("0123456789") for _ in range(15))
        extra = [["of", f"{word()}.{i}@mail.example.com"], ["secret", ":", f"'{secret}'"], ["of", card]][i % 3]
        at = rng.randrange(30)
        texts.append(" ".join(filler[:at] + extra + filler[at:]))
        if i % 3 == 1:
            secrets[i] = (pii.FOUND, texts[-1].index(secret), texts[-1].index(secret) + 40)
        elif i % 3 == 2:
            cards[i] = card
    got = found(docs_of(spark, texts))
    assert sum(span in got[i][1] for i, span in secrets.items()) >= 0.9 * len(secrets)
    assert all(got[i][1] == [] for i in cards)


def test_many_spans_in_one_text_take_linear_time(spark):
    t = time.time()
    rows = pii.find_personal_data(docs_of(spark, [" ".join(f"to u{i}@mail.example.com" for i in range(40_000))])).select(F.size("spans").alias("n")).collect()
    assert rows[0].n == 40_000 and time.time() - t < 60
