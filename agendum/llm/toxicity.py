"""Toxicity scores by a subsequence string-kernel SVM with Nyström landmarks.

The kernel compares two words by their common subsequences of three letters, in
which letters may be skipped: an occurrence that spans s letters weighs
``DECAY**(s - 3)``, up to ``REACH`` letters apart. So an insult with an inserted
or a dropped character, or with another ending, still resembles the plain one.
Punctuation inside a word is dropped and accents and look-alike digits are
folded before; letters outside a-z, of any script, share ``OTHERS`` codes by
their place in Unicode; letters that stand alone one after another (``i d i o t``)
are read as one word. Scripts without spaces between words are not segmented. A word longer than ``WINDOW`` letters is scored in
overlapping windows.

Training takes a bounded sample of labelled texts (``MAX_TOXIC``, ``MAX_CLEAN``
texts of at most ``MAX_CHARS`` characters, the ones with the smallest hash of
doc_id). Near-copies among them count once. Labels are of whole texts, so the
instances are found as in multi-instance learning: words that stand in toxic
sentences' texts far oftener than chance allows are the positive ones, words of
clean texts the negative ones; the SVM is retrained with the clean words it
wrongly ranks highest. Landmarks are drawn from both classes; the SVM is a
squared-hinge one on their Nyström features. As the kernel has an explicit
feature per letter triple, the machine folds into one weight per triple, and
scoring all texts needs no landmark.

A text's raw score is that of its worst word; a logistic curve set on the
sample's texts maps it to 0..1, with the decision at 0.3.

Edge cases: null, empty and word-less texts get the score of a text without any
insult; repeated rows are scored alike; without labelled texts of both classes
every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from agendum.llm.storage import lean, ship_code
from agendum.llm.wordhash import mix, slices

MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 1500, 2500, 30_000
LANDMARKS = 512
ROUNDS = 4
DECAY, REACH, WINDOW = 0.5, 6, 24
THRESHOLD = 0.3
CLEAN_WEIGHT = 4
SKETCH = 8

_U = np.uint64
# 0 ignored, 1-26 letters, then OTHERS codes of other letters, word start, word end
OTHERS = 48
OTHER = 27
START, END, ABC, SPACE = OTHER + OTHERS, OTHER + OTHERS + 1, OTHER + OTHERS + 2, 255
# Digits and signs read as the letters they resemble.
LOOK_ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
# Beyond the table: ideographs up to the first number, then nothing that is a letter.
TABLE, IDEOGRAPHS = 0x20000, 0x40000


def _fold_table() -> np.ndarray:
    """The code of each character. Neighbours in an alphabet have different codes."""
    out = (OTHER + np.arange(TABLE) % OTHERS).astype(np.uint8)
    plain = [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3)]     # ideographs and Hangul syllables
    for cp in itertools.chain(range(plain[0][0]), range(plain[0][1] + 1, plain[1][0]), range(plain[1][1] + 1, plain[2][0]), range(plain[2][1] + 1, TABLE)):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if ch in " \t\n\r\x0b\x0c\x85" or kind[0] == "Z":
            out[cp] = SPACE
            continue
        if ch not in LOOK_ALIKE and kind[0] not in "LMNS":
            out[cp] = 0
            continue
        parts = unicodedata.normalize("NFKD", LOOK_ALIKE.get(ch, ch)).lower()
        # Accents are dropped; other signs (a voiced kana's) make another letter.
        base = parts[:1] if all(unicodedata.combining(x) >= 200 for x in parts[1:]) else unicodedata.normalize("NFKC", ch).lower()[:1]
        if "a" <= parts[:1] <= "z" and (kind[0] != "S" or len(parts) == 1):
            out[cp] = ord(parts[0]) - 96
        elif kind[0] == "L" or kind[0] == "M" and kind != "Me" and not unicodedata.combining(ch) and not _joins(cp):
            out[cp] = OTHER + ord(base) % OTHERS
        else:
            out[cp] = 0
    return out


def _joins(cp: int) -> bool:
    """Joiners and variation selectors: marks without a sound of their own."""
    return cp == 0x34F or 0x180B <= cp <= 0x180F or 0xFE00 <= cp <= 0xFE0F


FOLD = _fold_table()
PAIRS = [(j, k) for k in range(2, REACH) for j in range(1, k)]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray       # one per letter triple
    bias: float
    slope: float
    shift: float

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -30, 30)))


def units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letters, start, length, text number) of each word window of the texts."""
    lead = (data & 0xC0) != 0x80
    cps = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    codes = FOLD[np.minimum(cps, TABLE - 1)]
    far = np.flatnonzero(cps >= TABLE)
    codes[far] = np.where(cps[far] < IDEOGRAPHS, OTHER + cps[far] % OTHERS, 0)
    at = np.concatenate(([0], np.cumsum(lead)))[off]
    begin = np.zeros(len(codes) + 1, bool)
    begin[at] = True
    begin[:-1][1:] |= codes[:-1] == SPACE
    word = np.cumsum(begin[:-1])
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    keep = (codes > 0) & (codes != SPACE)
    c, w, t = codes[keep], word[keep], text[keep]
    if not len(c):
        e = np.zeros(0, np.int64)
        return c, e, e, e
    head = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
    size = np.diff(np.append(head, len(c)))
    # Letters that stand alone one after another are one word.
    alone = size == 1
    joined = np.append(False, alone[1:] & alone[:-1] & (t[head][1:] == t[head][:-1]))
    head = head[~joined]
    size = np.diff(np.append(head, len(c)))
    wins = np.maximum(1, -(-(size - WINDOW) // (WINDOW // 2)) + 1)
    nth = np.arange(int(wins.sum())) - np.repeat(np.cumsum(wins) - wins, wins)
    start = np.repeat(head, wins) + nth * (WINDOW // 2)
    length = np.minimum(WINDOW, np.repeat(head + size, wins) - start)
    return c, start, length, t[start]


def distinct_units(c, start, length):
    """(start, length, number of the distinct one for each window) of distinct windows, and their keys."""
    cum = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(cum, length)
    power = np.multiply.accumulate(np.full(WINDOW + 1, _U(0x9E3779B97F4A7C15)))
    key = mix(np.add.reduceat(c[np.repeat(start, length) + place].astype(np.uint64) * power[place], cum) + length.astype(np.uint64))
    uniq, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    return start[first], length[first], inverse, uniq


def triples(c, start, length):
    """(window number, letter triple, weight) of every occurrence."""
    n = length + 2
    cum = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(cum, n)
    body = np.clip(np.repeat(start, n) + place - 1, 0, max(0, len(c) - 1))
    x = c[body].astype(np.int32)
    x[cum] = START
    x[cum + n - 1] = END
    who = np.repeat(np.arange(len(n)), n)
    left = np.repeat(n, n) - place
    ids, feats, weights = [], [], []
    for j, k in PAIRS:
        ok = np.flatnonzero(left > k)
        ids.append(who[ok])
        feats.append(x[ok] * (ABC * ABC) + x[ok + j] * ABC + x[ok + k])
        weights.append(np.full(len(ok), DECAY ** (k - 2), np.float32))
    return np.concatenate(ids), np.concatenate(feats), np.concatenate(weights)


def raw_scores(c, start, length, weights: np.ndarray, bias: float) -> np.ndarray:
    who, feat, w = triples(c, start, length)
    norm = np.sqrt(np.bincount(who, w * w, len(start)))
    return np.bincount(who, w * weights[feat], len(start)) / np.maximum(norm, 1e-9) + bias


def worst_words(data, off, model: Model) -> np.ndarray:
    out = np.full(len(off) - 1, model.bias)
    c, start, length, text = units(data, off)
    if len(start):
        s, n, inverse, _ = distinct_units(c, start, length)
        score = raw_scores(c, s, n, model.weights, model.bias)[inverse]
        head = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        out[text[head]] = np.maximum(out[text[head]], np.maximum.reduceat(score, head))
    return out


# --- training ---

def _sample_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: label, min-hashes of its word windows, its distinct words' letters."""
    salt = mix(np.arange(1, SKETCH + 1, dtype=np.uint64))
    for batch in batches:
        for i, j, data, off in slices(batch.column(0)):
            c, start, length, text = units(data, off)
            for k in range(j - i):
                pick = text == k
                row_words, sketch = [], [0] * SKETCH
                if pick.any():
                    s, n, _, key = distinct_units(c, start[pick], length[pick])
                    sketch = [int(mix(key ^ x).min() >> _U(1)) for x in salt]
                    row_words = [c[a:a + m].tobytes() for a, m in zip(s, n, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i + k, 1), pa.array([sketch], pa.list_(pa.int64())), pa.array([row_words], pa.list_(pa.binary()))], names=["toxic", "sketch", "words"])


def _instances(found):
    """(letters, start, length) of words: a list of bytes or an Arrow binary array."""
    if isinstance(found, list):
        found = pa.array(found, pa.binary())
    found = pa.concat_arrays([found])       # no slice, no offset
    off = np.frombuffer(found.buffers()[1], np.int32)[found.offset:found.offset + len(found) + 1].astype(np.int64)
    c = np.frombuffer(found.buffers()[2], np.uint8) if off[-1] else np.zeros(0, np.uint8)
    return c, off[:-1], np.diff(off)


def _kernel(found: list[bytes], row: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Kernel values of words and landmarks; ``row``, ``basis``: as ``_basis`` gives them."""
    out = np.zeros((len(found), basis.shape[1]), np.float32)
    for i in range(0, len(found), 100):
        part = _instances(found[i:i + 100])
        who, feat, w = triples(*part)
        norm = np.sqrt(np.bincount(who, w * w, len(part[1])))
        order = np.argsort(who, kind="stable")
        heads = np.searchsorted(who[order], np.arange(len(part[1])))
        out[i:i + 100] = np.add.reduceat(basis[row[feat[order]]] * w[order][:, None], heads) / norm[:, None]
    return out


def _basis(marks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(triples of the landmarks, row of each triple, a column of weights per
    landmark); the last row is that of all other triples."""
    part = _instances(marks)
    who, feat, w = triples(*part)
    own, at = np.unique(feat, return_inverse=True)
    row = np.full(ABC ** 3, len(own), np.int32)
    row[own] = np.arange(len(own))
    basis = np.zeros((len(own) + 1, len(marks)), np.float32)
    np.add.at(basis, (at, who), w)
    basis /= np.sqrt(np.bincount(who, w * w, len(marks))).astype(np.float32)
    return own, row, basis


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Primal squared-hinge SVM by finite Newton steps."""
    z1 = np.column_stack([z, np.ones(len(z), np.float32)])
    ridge = np.eye(z1.shape[1])
    ridge[-1, -1] = 1e-3
    w = np.zeros(z1.shape[1])
    active = np.ones(len(z), bool)
    for _ in range(30):
        za = z1[active] * weight[active][:, None].astype(np.float32)
        w = np.linalg.solve((za.T @ z1[active]).astype(float) + ridge, (za.T @ y[active].astype(np.float32)).astype(float))
        now = y * (z1 @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def fit(rows: pa.Table) -> Model:
    """``rows``: toxic, sketch, words of the sample's texts."""
    none = Model(np.zeros(ABC ** 3, np.float32), 0.0, 0.0, -30.0)
    seen: dict = {}
    kept = []
    for i, sketch in enumerate(rows.column("sketch").to_pylist()):
        hits: dict = {}
        for k, v in enumerate(sketch):
            for o in seen.get((k, v), ()):
                hits[o] = hits.get(o, 0) + 1
        if max(hits.values(), default=0) >= SKETCH // 2:
            continue
        for k, v in enumerate(sketch):
            seen.setdefault((k, v), []).append(i)
        kept.append(i)
    rows = rows.take(pa.array(kept, pa.int64()))
    label = rows.column("toxic").to_numpy()
    n_bad = int(label.sum())
    lists = rows.column("words").combine_chunks() if len(rows) else pa.array([], pa.list_(pa.binary()))
    size = np.diff(lists.offsets.to_numpy())
    coded = lists.flatten().dictionary_encode()
    words = coded.indices.to_numpy().astype(np.int32)    # the texts' words, by number
    names = coded.dictionary                              # each distinct word once
    if not n_bad or n_bad == len(label) or not len(names):
        return none
    text = np.repeat(np.arange(len(label), dtype=np.int32), size)
    in_bad = label[text] > 0
    calm = np.bincount(words[~in_bad], minlength=len(names))
    sure = _telling_words(words[in_bad], text[in_bad], calm, len(label) - n_bad)
    name = lambda at: names.take(pa.array(at, pa.int64())).to_pylist()
    clean = np.flatnonzero(calm >= 1)
    bad = name(sure)
    others = _with_insertions(bad, names)
    told = np.zeros(len(names), bool)
    told[sure] = True
    order = np.fromiter((crc32(x.as_py()) for x in names), np.int64, len(names))    # a fixed order of words, whatever the batches
    calm_order = clean[np.lexsort((order[clean], -calm[clean]))]
    negative = dict.fromkeys(name([i for i in [*calm_order[:2000], *clean[np.argsort(order[clean], kind="stable")[:2000]]] if not told[i]]))
    hard = list(negative)[:LANDMARKS // 4] + list(negative)[-LANDMARKS // 4:]
    pool = _instances(names)
    for _ in range(ROUNDS):
        marks = list(dict.fromkeys(bad[:LANDMARKS // 3] + hard))[:LANDMARKS]
        own, row, basis = _basis(marks)
        values, vectors = np.linalg.eigh(_kernel(marks, row, basis).astype(float))
        good = values > 1e-5 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        found = bad + others + list(negative)
        y = np.append(np.ones(len(bad) + len(others)), -np.ones(len(negative)))
        even = max(1.0, len(negative) / (len(bad) + len(others)))
        cost = np.concatenate([np.full(len(bad), 20 * even), np.full(len(others), 5 * even), np.full(len(negative), 20.0)])
        w, bias = _svm((_kernel(found, row, basis) @ root.astype(np.float32)), y, cost)
        weights = np.zeros(ABC ** 3, np.float32)
        weights[own] = basis[:-1] @ (root @ w)
        scores = np.concatenate([raw_scores(pool[0], pool[1][i:i + 4000], pool[2][i:i + 4000], weights, bias) for i in range(0, len(names), 4000)])
        worst = name([i for i in clean[np.lexsort((order[clean], -scores[clean]))][:1000] if not told[i]])
        negative |= dict.fromkeys(worst)
        hard = worst[:LANDMARKS // 2] + hard
    raw = np.full(len(label), bias)
    full = np.flatnonzero(size)
    if len(full):
        raw[full] = np.maximum(bias, np.maximum.reduceat(scores[words], (np.cumsum(size) - size)[full]))
    model = Model(weights, bias, *_curve(raw, label.astype(float)))
    del rows, lists, coded, words, names, text, pool, scores, order, basis
    pa.default_memory_pool().release_unused()
    return model


def _telling_words(words: np.ndarray, text: np.ndarray, calm: np.ndarray, n_calm: int) -> np.ndarray:
    """Words that stand in toxic texts far oftener than chance allows, strongest
    first. ``words``, ``text``: the distinct words of each toxic text; ``calm``: clean
    texts per word. Texts that a found word explains are set aside, then the rest
    is looked at alone, so that rarer kinds of insults are found as well."""
    out: dict = {}
    for _ in range(ROUNDS):
        if not len(words):
            break
        n = np.bincount(words, minlength=len(calm))
        n_bad = len(np.unique(text))
        share = n_bad / (n_bad + n_calm)
        both = n + calm
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = n * np.log(np.maximum(n, 1e-9) / (both * share)) + np.where(calm > 0, calm * np.log(np.maximum(calm, 1e-9) / (both * (1 - share))), 0)
        gain = np.where((n > both * share) & (n >= 3) & (calm <= 0.05 * n), gain, 0)
        new = np.flatnonzero(gain >= np.log((both >= 3).sum() + 1) + 1)
        if not len(new) and not out:
            new = np.argsort(-gain, kind="stable")[:20]
            new = new[gain[new] > 0]
        if not len(new):
            break
        out |= {int(i): gain[i] for i in new if int(i) not in out}
        told = np.zeros(len(calm), bool)
        told[list(out)] = True
        left = ~np.isin(text, text[told[words]])
        words, text = words[left], text[left]
    return np.array(sorted(out, key=lambda i: (-out[i], i))[:1500], np.int64)


def _with_insertions(bad: list[bytes], known: pa.Array) -> list[bytes]:
    """Each word with one letter put in, at two places: virtual examples."""
    out = []
    for x in bad[:300]:
        if len(x) >= 4:
            h = crc32(x)
            for k in range(2):
                at = 1 + (h >> (8 * k)) % (len(x) - 1)
                out.append(x[:at] + bytes([1 + (h >> (5 + 8 * k)) % 26]) + x[at:])
    seen = pc.is_in(pa.array(out, pa.binary()), value_set=known).to_pylist() if out else []
    return [x for x, s in zip(out, seen, strict=True) if not s]


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve that is ``THRESHOLD`` at the raw
    score with the best F1 on the sample (a clean text counts ``CLEAN_WEIGHT``
    times, as clean texts are rarer in the sample than in a corpus) and 0.95 at
    the median of the toxic texts above it."""
    order = np.argsort(-x, kind="stable")
    xs, ys = x[order], y[order]
    hit = np.cumsum(ys)
    wrong = np.cumsum(1 - ys) * CLEAN_WEIGHT
    f1 = 2 * hit / (hit + wrong + ys.sum())
    f1[:-1][xs[:-1] == xs[1:]] = -1    # a cut stands between different scores
    best = int(np.argmax(f1))
    below = xs[best + 1] if best + 1 < len(xs) else xs[best] - 1
    cut = (xs[best] + below) / 2
    high = np.median(xs[:best + 1][ys[:best + 1] > 0]) if hit[best] else cut + 1
    slope = (np.log(0.95 / 0.05) - np.log(THRESHOLD / (1 - THRESHOLD))) / max(high - cut, 1e-3)
    return float(slope), float(np.log(THRESHOLD / (1 - THRESHOLD)) - slope * cut)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the rows of ``labels`` (doc_id, toxic) outside the held-out fold."""
    ship_code(docs.sparkSession)
    marked = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).where(~held_out())
              .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    order = F.xxhash64("doc_id", F.lit("toxicity"))
    usable = docs.where(F.col("text").isNotNull() & (F.length("text") <= MAX_CHARS)).select(F.col("doc_id").cast("long"))
    marked = marked.join(usable, "doc_id", "left_semi")
    chosen = marked.where("toxic = 1").orderBy(order, "doc_id").limit(MAX_TOXIC).union(marked.where("toxic = 0").orderBy(order, "doc_id").limit(MAX_CLEAN))
    rows = (docs.select(F.col("doc_id").cast("long"), "text").where(F.length("text") <= MAX_CHARS)
            .join(F.broadcast(chosen), "doc_id")       # at most MAX_TOXIC + MAX_CLEAN rows
            .select("text", "toxic").mapInArrow(lambda b: lean(_sample_units(b)), "toxic int, sketch array<long>, words array<binary>"))
    return fit(rows.toArrow())


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the toxicity score of each row's whole text, 0 to 1."""
    ship_code(docs.sparkSession)
    names = docs.columns
    at = names.index("text")
    schema = StructType([*docs.schema.fields, StructField(column, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.concatenate([worst_words(data, off, model) for _, _, data, off in slices(batch.column(at))] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.probability(found))], names=[*names, column])

    return docs.mapInArrow(lambda b: lean(run(b)), schema)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` below the threshold, columns unchanged."""
    column = "_toxicity_score"
    return score(docs, train(docs, labels), column).where(F.col(column) < threshold).drop(column)
