"""Space-filling-curve packing: documents ordered by the Hilbert key of their
projected hashed vector, neighbours packed together.

1. One pass turns each text into token ids (the tokenizers library; the ids of
   a chunk between single spaces depend on nothing outside it, so a worker
   encodes each distinct chunk once), and into the sum of one fixed random
   direction per token id: the document's hashed vector projected to ``DIMS``
   dimensions. Its place on the Hilbert curve is the sort key.
2. Rows are range-partitioned and sorted by (key, doc_id). Ties split over
   partitions like any other rows, so a group of copies is no hot group.
3. Each partition is one token stream, cut every ``length`` ids. What is left at
   its end goes into sequences whose lengths are powers of two, which take no
   padding, so no sequence is padded.

Edge cases: a null or empty text is its end id alone; repeated rows are packed
as often as they occur; an empty table gives no rows; other columns of the
input are ignored. A null doc_id stays null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agendum.llm.storage import cut, lean, ship_code
from agendum.llm.wordhash import _BYTE, SLICE_BYTES, byte_set, mix, slices

LENGTH = 1024
END_ID = 0
DIMS, BITS = 4, 12
CACHE = 700_000   # chunks that a worker remembers from slice to slice

_U = np.uint64
_STOP = byte_set((0x00, 0x20))
_LETTER = byte_set((0x41, 0x5A), (0x61, 0x7A))
_PUNCT = byte_set((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
# White space beyond ASCII: texts that hold any are encoded in one piece.
_WIDE_SPACE = "[\u0085   -     　]"

_worker: dict = {}


class Known:
    """Ids of chunks by 64-bit key, in arrays sorted by key: some 35 bytes a chunk."""

    def __init__(self):
        self.key = np.zeros(0, np.uint64)
        self.base = np.zeros(0, np.int64)    # where the chunk's ids begin in ``ids``
        self.size = np.zeros(0, np.int32)
        self.seen = np.zeros(0, np.int32)    # the last turn that asked for the chunk
        self.ids = np.zeros(0, np.uint32)
        self.turn = 0

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.key, keys).clip(0, max(0, len(self.key) - 1))

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key is known. Begins a turn, before which the chunks
        that no recent turn asked for go if there are more than ``CACHE``."""
        if len(self.key) > CACHE:
            self._forget()
        self.turn += 1
        if not len(self.key):
            return np.zeros(len(keys), bool)
        at = self._at(keys)
        found = self.key[at] == keys
        self.seen[at[found]] = self.turn
        return found

    def add(self, keys: np.ndarray, ids: list[list[int]]) -> None:
        """``keys``: sorted, none of them known."""
        at = np.searchsorted(self.key, keys)
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        base = len(self.ids) + np.cumsum(size, dtype=np.int64) - size
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))])
        self.key, self.base, self.size = np.insert(self.key, at, keys), np.insert(self.base, at, base), np.insert(self.size, at, size)
        self.seen = np.insert(self.seen, at, self.turn)

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first id in ``ids``, number of ids) of known keys."""
        at = self._at(keys)
        return self.base[at], self.size[at].astype(np.int64)

    def _forget(self) -> None:
        keep = np.flatnonzero(self.seen > np.partition(self.seen, len(self.seen) // 2)[len(self.seen) // 2])
        size = self.size[keep].astype(np.int64)
        base = np.cumsum(size) - size
        self.ids = self.ids[np.repeat(self.base[keep] - base, size) + np.arange(int(size.sum()))]
        self.key, self.base, self.size, self.seen = self.key[keep], base, self.size[keep], self.seen[keep]


def tokenizer(path: str):
    if _worker.get("path") != path:
        from tokenizers import Tokenizer
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True   # their strings in a text are ordinary text
        _worker.update(path=path, tokenizer=t, known=Known())
    return _worker["tokenizer"], _worker["known"]


def chunk_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Places where a text can be cut without changing its ids: before a space
    or line feed that stands alone between other characters, after such a line
    feed, and before ASCII punctuation that follows an ASCII letter."""
    cutp = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        stop = _STOP[data]
        alone = ~stop[:-2] & ~stop[2:]
        mid = data[1:-1]
        lf = alone & (mid == 0x0A)
        cutp[1:-2] |= alone & (mid == 0x20) | lf
        cutp[2:-1] |= lf
    if len(data) > 1:
        cutp[1:-1] |= _LETTER[data[:-1]] & _PUNCT[data[1:]]
    cutp[off] = True
    cutp[len(data)] = False
    return np.flatnonzero(cutp)


def encode_slice(tok, known: Known, data: np.ndarray, off: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, ids per text). ``whole``: texts to encode in one piece."""
    n = len(off) - 1
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(n, np.int64)
    starts = chunk_starts(data, off)
    if whole.any():
        text = np.searchsorted(off, starts, "right") - 1
        starts = starts[~whole[text] | (starts == off[text])]
    ends = np.append(starts[1:], len(data))
    width = ends - starts
    place = np.arange(len(data)) - np.repeat(starts, width)
    power = np.full(int(width.max()), _U(0x9E3779B97F4A7C15))
    power[0] = 1
    power = np.multiply.accumulate(power)
    key = mix(np.add.reduceat(_BYTE[data] * power[place], starts) + width.astype(np.uint64))
    uniq, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    unknown = np.flatnonzero(~known.holds(uniq))
    if len(unknown):
        raw = data.tobytes()
        strings = [raw[a:b].decode("utf-8") for a, b in zip(starts[first[unknown]].tolist(), ends[first[unknown]].tolist(), strict=True)]
        known.add(uniq[unknown], [e.ids for e in tok.encode_batch_fast(strings, add_special_tokens=False)])
    base, size = known.places(uniq)
    per_chunk = size[inverse]
    at = np.repeat(base[inverse] - (np.cumsum(per_chunk) - per_chunk), per_chunk) + np.arange(int(per_chunk.sum()))
    flat = known.ids
    text = np.searchsorted(off, starts, "right") - 1
    return flat[at], np.bincount(text, weights=per_chunk, minlength=n).astype(np.int64)


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows of ``cells``, each
    coordinate below 2**bits), by Skilling's transposition (AIP Conf. Proc. 707, 2004)."""
    x = cells.astype(np.uint64).copy()
    dims = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = _U(q - 1)
        for i in range(dims):
            hit = (x[:, i] & _U(q)) != 0
            t = np.where(hit, _U(0), (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(hit, p, t)
            x[:, i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.uint64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[:, dims - 1] & _U(q)) != 0, _U(q - 1), _U(0))
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << _U(1)) | ((x[:, i] >> _U(b)) & _U(1))
    return key.astype(np.int64)


def directions(size: int = 1 << 16, dims: int = DIMS) -> np.ndarray:
    """One fixed random direction of +1 and -1 per hashed token id."""
    h = mix(np.arange(size, dtype=np.uint64) + _U(1))
    return np.stack([((h >> _U(7 * d)) & _U(1)).astype(np.float32) * 2 - 1 for d in range(dims)], 1)


def curve_keys(ids: np.ndarray, counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    n = len(counts)
    point = np.zeros((n, DIMS))
    if len(ids):
        full = np.flatnonzero(counts)
        head = (np.cumsum(counts) - counts)[full]
        for d in range(DIMS):
            point[full, d] = np.add.reduceat(table[ids & 0xFFFF, d], head, dtype=np.float64)
        point /= np.sqrt(np.maximum(counts, 1))[:, None]
    # A smooth, fixed map to the cube, so that keys never depend on other documents.
    cells = np.floor((np.tanh(point / 8) + 1) / 2 * (1 << BITS)).clip(0, (1 << BITS) - 1)
    return hilbert_key(cells.astype(np.int64), BITS)


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    tok, known = tokenizer(path)
    table = directions()
    for batch in batches:
        col = batch.column(1).cast(pa.large_string())
        whole = pc.fill_null(pc.match_substring_regex(col, _WIDE_SPACE), False).to_numpy(zero_copy_only=False)
        dtype = "<u2" if tok.get_vocab_size() <= 1 << 16 else "<u4"
        for i, j, data, off in slices(col, 2 * SLICE_BYTES):
            ids, counts = encode_slice(tok, known, data, off, whole[i:j])
            keys = curve_keys(ids, counts, table)
            counts = counts + 1
            stream = np.full(int(counts.sum()), END_ID, dtype)
            stream[np.delete(np.arange(len(stream)), np.cumsum(counts) - 1)] = ids
            ends = np.cumsum(counts) * stream.itemsize
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(stream)])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), raw.cast(pa.binary())], names=["doc_id", "curve_key", "doc_tokens", "ids"])


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, ids binary"


def _pack(batches: Iterator[pa.RecordBatch], length: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Cut the partition's token stream into sequences. The last, open sequence
    is kept back until the end of the partition, then cut at powers of two."""
    base = TaskContext.get().partitionId() << 40
    done, waiting = 0, []   # full sequences so far; pieces of the open one: (doc_id, start, ids, doc_tokens)
    filled = 0

    def rows(open_pieces, sizes, first):
        out, offset, left, seq = [], 0, list(sizes), first
        for doc, start, ids, n in open_pieces:
            at = 0
            while at < len(ids):
                take = min(left[0] - offset, len(ids) - at)
                piece = ids[at:at + take].tobytes()
                out.append((doc, start + at, take, zlib.crc32(piece), n, base + seq, offset, left[0], piece if with_ids else None))
                at, offset = at + take, offset + take
                if offset == left[0]:
                    left.pop(0)
                    offset, seq = 0, seq + 1
        return out

    def batch_of(out):
        cols = list(zip(*out, strict=True))
        types = [pa.int64()] * 8 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[p.split()[0] for p in PIECES.split(", ")])

    for batch in batches:
        out = []
        for doc, raw, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            buf = raw.as_buffer()
            ids = np.frombuffer(buf, "<u2" if buf.size == 2 * n else "<u4").astype("<u4")
            waiting.append((doc, 0, ids, n))
            filled += len(ids)
            if filled < length:
                continue
            full = filled // length
            rest = filled - full * length
            if rest:   # the tail of this document opens the next sequence
                at = len(ids) - rest
                waiting[-1] = (doc, 0, ids[:at], n)
            out += rows(waiting, [length] * full, done)
            done += full
            waiting = [(doc, len(ids) - rest, ids[len(ids) - rest:], n)] if rest else []
            filled = rest
        if out:
            yield batch_of(out)
    if waiting:
        sizes = [1 << b for b in range(filled.bit_length() - 1, -1, -1) if filled >> b & 1]
        yield batch_of(rows(waiting, sizes, done))


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, curve_key, doc_tokens, ids of every row: little-endian unsigned
    integers, of 16 bits if the vocabulary allows it, else of 32; end id last."""
    ship_code(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        lambda b: lean(_encode(b, tokenizer_path)), "doc_id long, curve_key long, doc_tokens long, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """Pieces of packed sequences; ``ids`` are null unless ``with_ids``.

    The encoded rows are written to the shared folder first: the range sort
    samples them, and lost executors don't tokenise again."""
    encoded = cut(encode(docs, tokenizer_path), "packing-ids")
    ordered = encoded.repartitionByRange("curve_key", F.col("doc_id")).sortWithinPartitions("curve_key", "doc_id")
    return ordered.select("doc_id", "ids", "doc_tokens").mapInArrow(lambda b: lean(_pack(b, length, with_ids)), PIECES)
