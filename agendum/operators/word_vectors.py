"""Skip-gram word vectors (hierarchical softmax) whose vocabulary no process holds
whole: what M2 runs in Python workers, and the Huffman tree it shares with the driver.

The driver keeps the tree by count, not by word: words that occur equally often
are one run of leaves, and pairing a run gives a run of inner nodes. A training
task holds the vectors of its own words and of the nodes above them, in a
file-backed array once they take more than ``IN_MEMORY`` bytes. ``topics`` sends
these functions to the workers by value, so only numpy and Arrow are needed there.
"""

from __future__ import annotations

import ctypes
import mmap
import tempfile
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 5                 # Spark ML's defaults
LEARNING_RATE = 0.025
MAX_SENTENCE = 1000
MAX_EXP = 6.0
BLOCK = 16                 # neighbouring words whose paths are updated at once
SLAB = 4096                # words prepared at once
ROWS = 4096                # vectors written at once
IN_MEMORY = 64 << 20       # bytes of vectors of a task


class Tree(NamedTuple):
    """Runs of nodes: leaves 0.. by falling count, then inner nodes in the order they
    were made. Of a run's members the first may end a pair begun in the run before
    (``first``: its parent, else -1), the others pair up under the nodes from
    ``paired`` on, and one that is left begins a pair with the next run (``last``)."""

    starts: np.ndarray
    pairs: np.ndarray
    first: np.ndarray
    paired: np.ndarray
    last: np.ndarray
    words: int

    def parents(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parent of each node (-1: the root) and whether it is the parent's second child."""
        run = np.searchsorted(self.starts, ids, "right") - 1
        at = ids - self.starts[run]
        begun = self.first[run] >= 0
        at -= begun
        inside = at < 2 * self.pairs[run]
        up = np.where(inside, self.paired[run] + (at >> 1), self.last[run])
        second = np.where(inside, at & 1, 0)
        own = begun & (at < 0)
        return np.where(own, self.first[run], up), np.where(own, 1, second).astype(np.int8)


def huffman(classes: list[tuple[int, int]]) -> Tree:
    """The tree over ``classes``: (count, words with that count), falling counts."""
    sizes = [n for _, n in classes]
    starts = [0, *np.cumsum(sizes).tolist()]
    words = starts.pop()
    pairs, first, paired, last = ([x] * len(sizes) for x in (0, -1, -1, -1))
    leaves = deque((w, i) for i, (w, _) in reversed([*enumerate(classes)]))
    inner: deque[tuple[int, int]] = deque()
    made = words

    def lightest() -> deque | None:
        if leaves and (not inner or leaves[0][0] < inner[0][0]):
            return leaves
        return inner or None

    def grow(weight: int, n: int) -> int:
        nonlocal made
        inner.append((weight, len(sizes)))
        for column, x in ((sizes, n), (starts, made), (pairs, 0), (first, -1), (paired, -1), (last, -1)):
            column.append(x)
        made += n
        return made - n

    while queue := lightest():
        weight, run = queue.popleft()
        left = sizes[run] - (first[run] >= 0)
        if left >= 2:
            pairs[run] = left // 2
            paired[run] = grow(2 * weight, left // 2)
        if left % 2 and (queue := lightest()):
            other, mate = queue[0]
            last[run] = first[mate] = grow(weight + other, 1)
            if sizes[mate] == 1:
                queue.popleft()
    return Tree(*(np.array(x, np.int64) for x in (starts, pairs, first, paired, last)), words)


def initial(ids: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A word's first vector, the same in every task: uniform in +-0.5 / size."""
    with np.errstate(over="ignore"):
        x = (ids.astype(np.uint64)[:, None] * np.uint64(size) + np.arange(size, dtype=np.uint64)
             + np.uint64(seed % (1 << 64)) * np.uint64(0x9E3779B97F4A7C15))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):      # splitmix64
            x += np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return (((x >> np.uint64(40)) / (1 << 24) - 0.5) / size).astype(np.float32)


def vectors(n: int, size: int) -> np.ndarray:
    """Zeros; in a file without a name, which goes with the task, if they are large."""
    if n * size * 4 <= IN_MEMORY:
        return np.zeros((n, size), np.float32)
    with tempfile.TemporaryFile() as f:
        f.truncate(n * size * 4)
        return np.frombuffer(mmap.mmap(f.fileno(), n * size * 4), np.float32).reshape(n, size)


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``; then the worker, which Spark keeps, gives freed memory back."""
    yield from batches
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)    # of glibc
    if trim:
        trim(0)


def of_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """Batches sorted by ``part``, cut at its borders: (part, its batches)."""
    def pieces() -> Iterator[tuple[int, pa.RecordBatch]]:
        for b in batches:
            part = b.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo < hi:
                    yield int(part[lo]), b.slice(lo, hi - lo)

    source = pieces()
    ahead = next(source, None)
    while ahead is not None:
        part = ahead[0]

        def own() -> Iterator[pa.RecordBatch]:
            nonlocal ahead
            while ahead is not None and ahead[0] == part:
                yield ahead[1]
                ahead = next(source, None)

        yield part, (batches_of_part := own())
        for _ in batches_of_part:
            pass


def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """(whether these are texts, rows) of a part: its words come before its texts."""
    for b in batches:
        words = len(b) - int(pc.sum(b.column("is_text")).as_py())
        if words:
            yield False, b.slice(0, words)
        if words < len(b):
            yield True, b.slice(words)


def rows_of(vec: pa.Array, size: int) -> np.ndarray:
    """The vectors of ``vec`` that are not null."""
    return vec.flatten().to_numpy().reshape(-1, size)


def listed(m: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    ends = pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(m.reshape(-1)), mask=None if null is None else pa.array(null))


def found(tokens: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row lengths, and each token's place in ``words`` (-1: not there)."""
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy()
    return lengths, pc.fill_null(pc.index_in(tokens.flatten(), value_set=words), -1).to_numpy()


class Part:
    """What one training task holds: its words, the inner nodes above them, their vectors."""

    def __init__(self, tree: Tree, ids: np.ndarray, words: pa.Array, size: int, seed: int):
        self.tree, self.ids, self.words, self.seed = tree, ids, words, seed
        up, bit = tree.parents(ids)
        level, levels = np.unique(up[up >= 0]), []
        while len(level):
            levels.append(level)
            level = tree.parents(level)[0]
            level = np.unique(level[level >= 0])
        self.nodes = np.unique(np.concatenate([*levels, np.empty(0, np.int64)]))
        above, side = tree.parents(self.nodes)
        up = np.concatenate([up, above])
        self.up = np.where(up >= 0, np.searchsorted(self.nodes, up), -1).astype(np.int32)
        self.goal = 1 - np.concatenate([bit, side])      # of the sigmoid at the parent
        self.word_vec, self.node_vec = vectors(len(ids), size), vectors(len(self.nodes), size)
        self.seen = np.zeros(len(ids), bool)
        for lo in range(0, len(ids), ROWS):
            self.word_vec[lo:lo + ROWS] = initial(ids[lo:lo + ROWS], size, seed)

    def paths(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(len(words), depth): the nodes above each word, -1 past the root, and the goals."""
        nodes, goals, at = [], [], words
        while True:
            up = np.where(at >= 0, self.up[at], -1)
            if (up < 0).all():
                break
            nodes.append(up)
            goals.append(self.goal[at])
            at = np.where(up >= 0, len(self.ids) + up, -1)
        if not nodes:
            return np.empty((len(words), 0), np.int32), np.empty((len(words), 0), np.int8)
        return np.stack(nodes, 1), np.stack(goals, 1)

    def train(self, words: np.ndarray, ends: np.ndarray, rng: np.random.Generator, alpha: float) -> None:
        """One pass over sentences (``ends`` of each in ``words``). The pairs of one
        word come one after the other, as in Spark ML: a pair sees what those
        before it made of the word's path. Of the other words of its block, and
        of itself, it sees the vectors before the block."""
        starts = np.concatenate([[0], ends[:-1]])
        n_blocks = -(-(ends - starts) // BLOCK)
        sentence = np.repeat(np.arange(len(ends)), n_blocks)
        nb, width = len(sentence), BLOCK + 2 * WINDOW
        begin = starts[sentence] + BLOCK * (np.arange(nb) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks))
        centre = begin[:, None] + np.arange(BLOCK)
        is_centre = centre < ends[sentence][:, None]
        centre = np.minimum(centre, len(words) - 1)
        place = begin[:, None] - WINDOW + np.arange(width)
        is_place = (place >= starts[sentence][:, None]) & (place < ends[sentence][:, None])
        context = np.where(is_place, words[np.clip(place, 0, len(words) - 1)], -1)
        reach = WINDOW - rng.integers(0, WINDOW, len(words))
        apart = np.abs(np.arange(width)[:, None] - WINDOW - np.arange(BLOCK))
        near = (apart > 0) & (apart <= reach[centre][:, None, :]) & is_place[:, :, None] & is_centre[:, None, :]
        self.seen[context[near.any(2)]] = True
        nodes, goals = self.paths(words[centre].reshape(-1))
        depth = nodes.shape[1]
        if not depth:
            return
        nodes[~is_centre.reshape(-1)] = -1
        # A column for each (word, node of its path), those of a node side by side;
        # a row for each place in reach.
        nodes, by_node, n_nodes, node_runs, node_at = _sorted(nodes.reshape(nb, BLOCK * depth))
        goals = np.take_along_axis(goals.reshape(nb, BLOCK * depth), by_node, 1) - np.float32(0.5)
        word_of = by_node // depth
        rates = near * np.float32(alpha)
        context_of, by_word, n_places, word_runs, _ = _sorted(context)
        low = is_place.argmax(1)
        before = np.tril(np.ones((width, width), np.float32), -1)
        word_vec, node_vec, half, most = self.word_vec, self.node_vec, np.float32(0.5), np.float32(MAX_EXP / 2)

        def slope(f: np.ndarray, goal: np.ndarray, rate: np.ndarray) -> np.ndarray:
            """By pair and node: rate * (goal - sigmoid(2 * f)); none beyond MAX_EXP, as in Spark ML."""
            e = np.tanh(f)
            e *= half
            np.subtract(goal, e, out=e)
            e *= rate
            if f.max() >= most or f.min() <= -most:
                e[np.abs(f) >= most] = 0
            return e

        for k, (lo, n, c) in enumerate(zip(low.tolist(), n_places.tolist(), n_nodes.tolist())):
            first, goal, rate = node_runs(k), goals[k, :c], rates[k, lo:lo + n].take(word_of[k, :c], 1)
            vs, us = nodes[k].take(first), context[k, lo:lo + n]
            x, y = word_vec.take(us, 0), node_vec.take(vs, 0)
            f = (x @ y.T).take(node_at[k, :c], 1)
            f *= half
            e = slope(f, goal, rate)
            earlier = x @ x.T
            earlier *= before[:n, :n]
            earlier *= half
            f += earlier @ e                                   # what the pairs before it did to the path
            e = slope(f, goal, rate)
            g = np.add.reduceat(e, first, 1)
            dx = g @ y
            earlier = e @ e.T
            earlier *= before[:n, :n]
            dx += earlier @ x
            y += g.T @ x
            node_vec[vs] = y
            one = word_runs(k)
            if len(one) < n:                                   # a word at several places
                order = by_word[k, :n] - lo
                dx = np.add.reduceat(dx.take(order, 0), one, 0)
                dx += x.take(order[one], 0)
                us = context_of[k].take(one)
            else:
                dx += x
            word_vec[us] = dx


def _sorted(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Callable[[int], np.ndarray], np.ndarray]:
    """Each row of ``m`` sorted, -1 (no value) last; its order, its length, where the
    runs of equal values begin in row k, and the run of each entry."""
    order = np.argsort(np.where(m < 0, np.iinfo(m.dtype).max, m), 1)
    m = np.take_along_axis(m, order, 1)
    new = m >= 0
    new[:, 1:] &= m[:, 1:] != m[:, :-1]
    column, ends = np.nonzero(new)[1], np.cumsum(new.sum(1)).tolist()
    return m, order, (m >= 0).sum(1), lambda k: column[ends[k - 1] if k else 0:ends[k]], np.cumsum(new, 1) - 1


def train(tree: Tree, size: int, seed: int, step: int, steps: int, parts: int, total: int):
    """One iteration over the rows of a part (its words and, after the first
    iteration, their and the nodes' vectors, then its texts)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in of_parts(batches):
            yield from one(part, own)

    def one(part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, done, ahead = None, [], 0, []
        rng = np.random.default_rng([seed % (1 << 64), part, step])

        def start() -> Part:
            ids = np.concatenate([b.column("id").to_numpy() for b in known])
            words = pa.concat_arrays([b.column("word") for b in known])
            n = int(np.searchsorted(ids, tree.words))         # nodes come after the words
            model, at = Part(tree, ids[:n], words.slice(0, n), size, seed), 0
            for b in known:
                given = np.flatnonzero(b.column("vec").is_valid().to_numpy(zero_copy_only=False))
                if len(given):
                    vec, own = rows_of(b.column("vec"), size), ids[at + given]
                    leaf = own < tree.words
                    model.word_vec[at + given[leaf]] = vec[leaf]
                    model.node_vec[np.searchsorted(model.nodes, own[~leaf])] = vec[~leaf]
                at += len(b)
            known.clear()
            return model

        def slab() -> None:
            nonlocal done
            words = np.concatenate(ahead)
            rate = LEARNING_RATE * max(1 - (parts * done + step * total) / (steps * total + 1), 1e-4)
            model.train(words, np.cumsum([len(x) for x in ahead]), rng, rate)
            done += len(words)
            ahead.clear()

        waiting = 0
        for is_text, b in parted(batches):
            if not is_text:
                known.append(b)
                continue
            if known:
                model = start()
            if model is None:                                 # no word of this part is frequent
                return
            lengths, at = found(b.column("tokens"), model.words)
            for text in np.split(at, np.cumsum(lengths)[:-1]):
                text = text[text >= 0]
                for lo in range(0, len(text), MAX_SENTENCE):
                    ahead.append(text[lo:lo + MAX_SENTENCE])
                    waiting += len(ahead[-1])
                    if waiting >= SLAB:
                        slab()
                        waiting = 0
        if model is None:
            return
        if ahead:
            slab()
        yield from written(model, part)

    def written(model: Part, part: int) -> Iterator[pa.RecordBatch]:
        held = [(model.ids, model.words, model.word_vec, model.seen)]
        if step + 1 < steps:                                  # the last result is the words'
            held.append((model.nodes, pa.nulls(len(model.nodes), pa.string()), model.node_vec, np.ones(len(model.nodes), bool)))
        for ids, words, vec, seen in held:
            for lo in range(0, len(ids), ROWS):
                own = seen[lo:lo + ROWS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), part, np.int32)), pa.array(ids[lo:lo + ROWS]), words.slice(lo, len(own)),
                     listed(vec[lo:lo + ROWS], ~own)], ["part", "id", "word", "vec"])

    return lambda batches: lean(run(batches))


def mean_of_parts(size: int, seed: int):
    """Rows sorted by ``id`` to one vector an id: the mean over the parts that
    changed it, the first vector if none did."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None                                           # the last id so far: id, word, sum, number
        for b in batches:
            ids, valid = b.column("id").to_numpy(), b.column("vec").is_valid().to_numpy(zero_copy_only=False)
            for lo in range(0, len(ids), ROWS):
                own = valid[lo:lo + ROWS]
                m = np.zeros((len(own), size))
                m[own] = rows_of(b.column("vec").slice(lo, len(own)), size)
                at = np.flatnonzero(np.diff(ids[lo:lo + ROWS], prepend=-1))
                new, sums, n = ids[lo:lo + ROWS][at], np.add.reduceat(m, at), np.add.reduceat(own.astype(np.int64), at)
                words = b.column("word").slice(lo, len(own)).take(pa.array(at))
                if held is not None:
                    if held[0][0] == new[0]:
                        sums[0] += held[2][0]
                        n[0] += held[3][0]
                    else:
                        yield out(*held)
                if len(new) > 1:
                    yield out(new[:-1], words.slice(0, len(new) - 1), sums[:-1], n[:-1])
                held = new[-1:], words.slice(len(new) - 1), sums[-1:], n[-1:]
        if held is not None:
            yield out(*held)

    def out(ids: np.ndarray, words: pa.Array, sums: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        m = (sums / np.maximum(n, 1)[:, None]).astype(np.float32)
        if not n.all():
            m[n == 0] = initial(ids[n == 0], size, seed)
        return pa.RecordBatch.from_arrays([pa.array(ids), words, listed(m)], ["id", "word", "vec"])

    return lambda batches: lean(run(batches))


def mean_vectors(lengths: np.ndarray, at: np.ndarray, vec: np.ndarray) -> np.ndarray:
    """For each row the sum of its tokens' vectors over the number of its tokens, known or not."""
    out = np.zeros((len(lengths), vec.shape[1]))
    row = np.repeat(np.arange(len(lengths)), lengths)[at >= 0]
    at = at[at >= 0]
    for lo in range(0, len(at), SLAB):
        own = row[lo:lo + SLAB]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        out[own[first]] += np.add.reduceat(vec.take(at[lo:lo + SLAB], 0).astype(np.float64), first)
    return out / np.maximum(lengths, 1)[:, None]


def score(size: int):
    """Rows of a part (its words with their vectors, then its texts) to the texts' mean vectors."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in of_parts(batches):
            known, words, vec = [], pa.array([], pa.string()), np.zeros((0, size), np.float32)
            for is_text, b in parted(own):
                if not is_text:
                    known.append(b.column("word"))
                    vec = grown(vec, sum(map(len, known)))
                    vec[sum(map(len, known[:-1])):sum(map(len, known))] = rows_of(b.column("vec"), size)
                    continue
                if known:
                    words = pa.concat_arrays(known)
                    known = []
                yield pa.RecordBatch.from_arrays([b.column("row"), listed(mean_vectors(*found(b.column("tokens"), words), vec))], ["row", "vec"])

    def grown(vec: np.ndarray, n: int) -> np.ndarray:
        if n <= len(vec):
            return vec
        more = vectors(max(n, 2 * len(vec)), size)
        for lo in range(0, len(vec), ROWS):
            more[lo:lo + ROWS][:len(vec) - lo] = vec[lo:lo + ROWS]
        return more

    return lambda batches: lean(run(batches))
