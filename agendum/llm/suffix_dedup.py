"""Removal of byte strings that an earlier document has already, by prefix doubling.

A byte goes when a string of ``WIDTH`` bytes covers it that also starts in a
document with a smaller doc_id. Strings lie inside one document, overlaps count,
and all is judged on the input. The doubling has two lengths, WIDTH/2 and WIDTH:

1. *Equal texts.* A row whose whole text stands under a smaller doc_id too needs
   no suffixes: all of it goes (or nothing, if shorter than WIDTH).
2. *Rank at WIDTH/2.* Every WIDTH-byte string holds one of a thin set of
   positions, the least hashes of its half-length strings (any two equal strings
   hold the same ones). Only these positions are ranked: Spark sorts their
   half-length keys, and positions whose key stands in one document only are
   unique and drop out.
3. *Rank at WIDTH.* The rest are sorted by that first rank; within one rank the
   offsets 0 .. WIDTH/2 around a position are ranked again by their second half,
   least doc_id first. Byte comparison confirms every rank that is used.
4. *Hot ranks* (more than ``HOT`` documents) are never sorted in one task: their
   whole strings are grouped by Spark under a 128-bit key and joined back with
   salts.

Ranking each byte position would shuffle some 24 bytes a byte of text in every
round; the thin set needs 24 bytes for every 13 or so. It loses nothing: keys
only choose what is compared, step 3 compares bytes.

Edge cases: a null text is empty; rows without doc_id keep their text and are no
source for others; rows with one doc_id never remove each other's bytes, so a
repeated row has the same result each time; texts shorter than WIDTH keep all;
very long texts are whole, one at a time (some 100 bytes of worker memory a byte
of the longest text); an empty table gives no rows; other columns stay as they
are (the added ones start with ``_``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agendum.llm.storage import broadcast_if_small, cut, ship_code
from agendum.llm.wordhash import mix, slices, utf8

WIDTH = 50
HALF = WIDTH // 2
HOT = 100_000         # documents under one half-length key beyond which Spark groups whole strings (some 100 MB in a task)
SALTS = 16
MAX_BROADCAST_ROWS = 2_000_000
MAX_BROADCAST_BYTES = 64 << 20
SLICE = 1 << 18
CHUNK = 50_000        # positions a worker opens at a time
RUN_ROWS = 40_000     # positions ranked at a time

_U = np.uint64
_rng = np.random.default_rng(20250311)
_BYTES = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_MASK = (1 << 64) - 1


def sliding(best, x: np.ndarray, width: int) -> np.ndarray:
    """``best`` (minimum or maximum) of each ``width`` neighbours of ``x``."""
    out, done, block, size = None, 0, x, 1
    while True:
        if width & size:
            out = block if out is None else best(out[:len(x) - done - size + 1], block[done:])
            done += size
        if done == width:
            return out
        block, size = best(block[:-size], block[size:]), 2 * size


def gram_hashes(data: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hash of the ``width`` bytes from each place on."""
    out, done = None, 0
    block, size, power = _BYTES[which][data], 1, _BASES[which]
    while True:
        if width & size:
            out = block if out is None else out[:len(data) - done - size + 1] * _U(power) + block[done:]
            done += size
        if done == width:
            return mix(out)
        block = block[:-size] * _U(power) + block[size:]
        size, power = 2 * size, power * power & _MASK


def _crossing(off: np.ndarray, width: int, n: int) -> np.ndarray:
    """Places from which ``width`` bytes leave their text."""
    step = np.zeros(n + 1, np.int32)
    inner = off[1:-1]
    np.add.at(step, np.maximum(inner - width + 1, 0), 1)
    np.add.at(step, inner, -1)
    return np.cumsum(step[:max(n - width + 1, 0)]) > 0


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, keys, least of each WIDTH-byte string): a place's half-length
    string is the least of some WIDTH-byte string of its text."""
    n = len(data)
    if n < WIDTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    key = gram_hashes(data, HALF)
    least = sliding(np.minimum, key, WIDTH - HALF + 1)
    least[_crossing(off, WIDTH, n)] = 0
    edge = np.zeros(WIDTH - HALF, np.uint64)
    least = np.concatenate((edge, least, edge))
    at = np.flatnonzero(sliding(np.maximum, least, WIDTH - HALF + 1) == key)
    return at, key[at].view(np.int64), least


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct half-length keys of each text."""
    for batch in batches:
        doc, cls = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for i, _, data, off in slices(batch.column(2), SLICE):
            at, key, _ = anchors(data, off)
            text = np.searchsorted(off, at, "right") - 1
            order = np.lexsort((key, text))
            key, text = key[order], text[order]
            new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (text[1:] != text[:-1]))[:len(key)])
            yield pa.record_batch([pa.array(key[new]), pa.array(doc[i + text[new]]), pa.array(cls[i + text[new]])], ["h", "doc", "cls"])


MARKS = pa.schema([("doc", pa.int64()), ("cls", pa.int64()), ("low", pa.int32()), ("hot", pa.int64())])


def _shared(most: int):
    """Of rows sorted by key and doc: those of keys in two documents or more (the
    key's low 32 bits), and once each key with more than ``most`` rows. Only the rows of
    a key seen in one document so far are held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        going, n_going = None, 0          # a shared key that may go on, and its rows so far
        for batch in batches:
            h, doc, cls = (np.concatenate((old, batch.column(i).to_numpy())) for i, old in enumerate(held))
            if not len(h):
                continue
            start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            end = np.append(start[1:], len(h))
            shared, n = doc[end - 1] > doc[start], end - start
            before = n_going if going is not None and h[0] == going else 0
            shared[0] |= before > 0
            n[0] += before
            hot = np.flatnonzero(shared & (n > most))
            hot = hot[(hot > 0) | (before <= most)]
            rows = np.flatnonzero(np.repeat(shared, end - start))
            low = (h[rows].view(np.uint64) & _U(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
            yield pa.record_batch([pa.array(doc[rows]), pa.array(cls[rows]), pa.array(low), pa.nulls(len(rows), pa.int64())], schema=MARKS)
            if len(hot):
                yield pa.record_batch([pa.nulls(len(hot), pa.int64()), pa.nulls(len(hot), pa.int64()), pa.nulls(len(hot), pa.int32()), pa.array(h[start[hot]])], schema=MARKS)
            going, n_going = (h[-1], n[-1]) if shared[-1] else (None, 0)
            keep = slice(len(h), None) if shared[-1] else slice(start[-1], None)
            held = [h[keep], doc[keep], cls[keep]]
    return run


PLACES = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("cls", pa.int64()), ("around", pa.binary()), ("places", pa.binary())])


def _places(chunk: int):
    """The places of a text's shared keys with the bytes of those WIDTH-byte strings
    whose least they are: up to HALF before, WIDTH after (zeros elsewhere), then how
    many of both. Equal ones share a row. The lists name keys by their low 32 bits;
    a place too many does no harm."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, cls = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i, j, data, off in slices(batch.column(2), SLICE):
                at, key, least = anchors(data, off)
                text = np.searchsorted(off, at, "right") - 1
                mine = (text.astype(np.uint64) << _U(32)) | (key.view(np.uint64) & _U(0xFFFFFFFF))
                keep = np.flatnonzero(np.isin(mine, _listed(batch.column(3).slice(i, j - i))))
                for c in range(0, len(keep), chunk):
                    p = keep[c:c + chunk]
                    yield _rows_around(data, off, at[p], text[p], key[p], least, doc[i:j], cls[i:j])
    return run


def _listed(lists: pa.Array) -> np.ndarray:
    """(row << 32 | low bits of the key) of the listed keys."""
    row = np.repeat(np.arange(len(lists), dtype=np.uint64), np.diff(lists.offsets.to_numpy()))
    return (row << _U(32)) | lists.flatten().to_numpy().view(np.uint32).astype(np.uint64)


def _rows_around(data, off, at, text, key, least, doc, cls) -> pa.RecordBatch:
    n = len(at)
    # Of the strings that hold the place, those whose least it is: neighbours.
    own = np.stack([least[at - o + WIDTH - HALF] == key.view(np.uint64) for o in range(HALF + 1)], axis=1)
    before = (HALF - np.argmax(own[:, ::-1], axis=1)).astype(np.uint8)
    after = (WIDTH - np.argmax(own, axis=1)).astype(np.uint8)
    reach = np.arange(-HALF, WIDTH)
    spot = at[:, None] + reach
    inside = (reach >= -before.astype(int)[:, None]) & (reach < after[:, None])
    block = np.zeros((n, HALF + WIDTH + 6), np.uint8)
    block[:, :HALF + WIDTH] = np.where(inside, data[np.clip(spot, 0, len(data) - 1)], 0)
    block[:, -6], block[:, -5] = before, after
    block[:, -4:] = text.astype(">u4").view(np.uint8).reshape(n, 4)
    whole = np.ascontiguousarray(block).view(f"V{block.shape[1]}").ravel()
    _, first, member = np.unique(whole, return_index=True, return_inverse=True)
    order = np.argsort(member, kind="stable")
    ends = np.cumsum(np.bincount(member, minlength=len(first)))
    where = (at - off[text])[order].astype("<i8")
    around = np.ascontiguousarray(block[first, :-4])
    return pa.record_batch([pa.array(key[first]), pa.array(doc[text[first]]), pa.array(cls[text[first]]),
                            _binary(around.ravel(), np.arange(len(first) + 1) * around.shape[1]),
                            _binary(where.view(np.uint8), np.append(0, ends) * 8)], schema=PLACES)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


FOUND = pa.schema([("doc", pa.int64()), ("cls", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])


def _blocks(col) -> np.ndarray:
    """The fixed-width values of a binary column as a byte matrix."""
    width = HALF + WIDTH + 2
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, width)


def _string_keys(block: np.ndarray, which: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(offset, rows that have it, key of the WIDTH bytes from ``offset`` before the place on)."""
    before, after = block[:, -2], block[:, -1]
    power = np.ones(HALF + WIDTH, np.uint64)
    power[1:] = _U(_BASES[which])
    power = np.multiply.accumulate(power)
    sums = np.zeros((len(block), HALF + WIDTH + 1), np.uint64)
    np.cumsum(_BYTES[which][block[:, :HALF + WIDTH]] * power, axis=1, out=sums[:, 1:])
    for o in range(HALF + 1):
        rows = np.flatnonzero((before >= o) & (after >= WIDTH - o))
        lo = HALF - o
        # The same string at another offset has another power; ranks are taken offset by offset.
        yield o, rows, mix(sums[rows, lo + WIDTH] - sums[rows, lo])


def seen_before(h: np.ndarray, doc: np.ndarray, block: np.ndarray) -> np.ndarray:
    """For each place (places sorted by doc_id), the offsets (as bits) whose string
    stands under a smaller doc_id."""
    out = np.zeros(len(h), np.int64)
    for o, rows, key in _string_keys(block, 0):
        if len(rows) < 2:
            continue
        lo = HALF - o
        rank = np.zeros(len(h), np.uint64)
        rank[rows] = mix(key ^ h[rows].view(np.uint64))
        order = rows[np.argsort(rank[rows], kind="stable")]     # rows come by doc_id
        new = np.append(True, rank[order][1:] != rank[order][:-1])
        lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        later = np.flatnonzero(doc[order] > doc[lead])
        if not len(later):
            continue
        mine, first = order[later], lead[later]
        same = (block[mine, lo:lo + WIDTH] == block[first, lo:lo + WIDTH]).all(axis=1)
        out[mine[same]] |= 1 << o
        for r in mine[~same]:     # equal keys of different strings: compare with each smaller doc_id of that key
            rivals = order[(rank[order] == rank[r]) & (doc[order] < doc[r])]
            if (block[rivals, lo:lo + WIDTH] == block[r, lo:lo + WIDTH]).all(axis=1).any():
                out[r] |= 1 << o
    return out


def _rank(run_rows: int):
    """Rows sorted by first rank: whole ranks, about ``run_rows`` rows at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < run_rows:
                continue
            rows = pa.Table.from_batches(held)
            h = rows.column("h").to_numpy()
            done = int(np.searchsorted(h, h[-1], "left"))     # the last rank may go on
            if done:
                yield from _ranked(rows.slice(0, done), 4 * run_rows)
            held = rows.slice(done).combine_chunks().to_batches()
            n = rows.num_rows - done
        if held:
            yield from _ranked(pa.Table.from_batches(held), 4 * run_rows)
    return run


def _ranked(rows: pa.Table, most: int) -> Iterator[pa.RecordBatch]:
    h = rows.column("h").to_numpy()
    cuts = np.array([0, len(h)])
    if len(h) > most:     # many places of few documents: rank by rank
        cuts = np.append(np.flatnonzero(np.append(True, h[1:] != h[:-1])), len(h))
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = rows.slice(a, b - a).sort_by("doc")
        bits = seen_before(part.column("h").to_numpy(), part.column("doc").to_numpy(), _blocks(part.column("around")))
        yield _runs_of(part, bits)


def _runs_of(rows: pa.Table, bits: np.ndarray) -> pa.RecordBatch:
    """(doc, cls, lo, hi): the bytes that neighbouring found offsets cover, at each place."""
    hit = np.flatnonzero(bits)
    flags = np.zeros((len(hit), HALF + 3), np.int8)
    flags[:, 1:-1] = bits[hit][:, None] >> np.arange(HALF + 1) & 1
    step = np.diff(flags, axis=1)
    row, first = np.nonzero(step == 1)
    _, last = np.nonzero(step == -1)
    row = hit[row]
    places = rows.column("places").combine_chunks().take(pa.array(row))
    n = pc.binary_length(places).to_numpy().astype(np.int64) // 8
    at = np.frombuffer(b"".join(places.to_pylist()), "<i8")
    who = pa.array(np.repeat(row, n))
    return pa.record_batch([rows.column("doc").combine_chunks().take(who), rows.column("cls").combine_chunks().take(who),
                            pa.array(at - np.repeat(last - 1, n)), pa.array(at - np.repeat(first, n) + WIDTH)], schema=FOUND)


STRINGS = pa.schema([("f", pa.int64()), ("g", pa.int64()), ("doc", pa.int64()), ("cls", pa.int64()), ("lo", pa.int64())])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All WIDTH-byte strings around the places, under 128-bit keys, with where they start."""
    for whole in batches:
        for s in range(0, whole.num_rows, 2000):
            batch = whole.slice(s, 2000)
            block = _blocks(batch.column("around"))
            h = batch.column("h").to_numpy()
            n = pc.binary_length(batch.column("places")).to_numpy().astype(np.int64) // 8
            at = np.split(np.frombuffer(b"".join(batch.column("places").to_pylist()), "<i8"), np.cumsum(n)[:-1])
            for (o, rows, f), (_, _, g) in zip(_string_keys(block, 0), _string_keys(block, 1), strict=True):
                if len(rows):
                    f = mix(f ^ h[rows].view(np.uint64) + _U(o))
                    who = np.repeat(np.arange(len(rows)), n[rows])
                    take = pa.array(rows[who])
                    yield pa.record_batch([pa.array(f.view(np.int64)[who]), pa.array(g.view(np.int64)[who]), batch.column("doc").take(take),
                                           batch.column("cls").take(take), pa.array(np.concatenate([at[r] for r in rows]) - o)], schema=STRINGS)


MERGED = pa.schema([("doc", pa.int64()), ("cls", pa.int64()), ("lo", pa.list_(pa.int64())), ("hi", pa.list_(pa.int64()))])


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text, the found runs as maximal disjoint ones."""
    for batch in batches:
        runs = batch.column(2)
        row = np.repeat(np.arange(len(runs)), np.diff(runs.offsets.to_numpy()))
        lo, hi = (runs.flatten().field(c).to_numpy() for c in (0, 1))
        span = int(hi.max(initial=0)) + 1
        order = np.lexsort((lo, row))
        row, lo = row[order], lo[order] + row[order] * span
        hi = np.maximum.accumulate(hi[order] + row * span)
        new = np.append(True, (lo[1:] > hi[:-1]) | (row[1:] != row[:-1]))[:len(lo)]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(lo))[:len(first)] - 1
        row = row[first]
        ends = pa.array(np.searchsorted(row, np.arange(len(runs) + 1)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(lo[first] - row * span)),
                                          pa.ListArray.from_arrays(ends, pa.array(hi[last] - row * span))], schema=MERGED)


KEPT = "cls long, doc long, _n_removed long, _n_spans long, _spans array<struct<start:long,end:long>>, _kept binary, _kept_sha256 string"


def _removal(with_kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(2))
            los, his = (batch.column(c) for c in (3, 4))
            removed, kept_bytes, shas = [], [], []
            for r in range(batch.num_rows):
                text = data[off[r]:off[r + 1]].tobytes()
                lo, hi = los[r].values.to_pylist(), his[r].values.to_pylist()
                kept = b"".join(text[a:b] for a, b in zip([0, *hi], [*lo, len(text)], strict=True))
                removed.append(len(text) - len(kept))
                kept_bytes.append(kept if with_kept else None)
                shas.append(hashlib.sha256(kept).hexdigest())
            spans = pa.StructArray.from_arrays([los.flatten(), his.flatten()], ["start", "end"])
            ends = pa.array(np.concatenate(([0], np.cumsum(np.diff(los.offsets.to_numpy())))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(removed, pa.int64()), pa.array(np.diff(ends.to_numpy()).astype(np.int64)),
                                              pa.ListArray.from_arrays(ends, spans), pa.array(kept_bytes, pa.binary()), pa.array(shas)], schema=_KEPT_ARROW)
    return run


_KEPT_ARROW = pa.schema([("cls", pa.int64()), ("doc", pa.int64()), ("_n_removed", pa.int64()), ("_n_spans", pa.int64()),
                         ("_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                         ("_kept", pa.binary()), ("_kept_sha256", pa.string())])


def _sized_join(df: DataFrame, small: DataFrame, n_bytes: int, on: list[str], how: str) -> DataFrame:
    """Join with a table of counted size: broadcast if it is small, else by shuffle."""
    return df.join(F.broadcast(small) if n_bytes <= MAX_BROADCAST_BYTES else small, on, how)


def first_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, copies): doc, cls, text of all rows of a doc_id but those whose text
    a smaller doc_id has; and doc, cls of the latter."""
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc"), class_of(F.col("text")).alias("cls"), sha_of(F.col("text")).alias("sha"), "text")
    first = rows.groupBy("sha").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    first = cut(first, "suffix-texts")
    n = first.count()
    copies = (rows.select("doc", "cls", "sha").join(broadcast_if_small(first, n, MAX_BROADCAST_ROWS), "sha")
              .where("doc > first").select("doc", "cls").distinct())
    copies = cut(copies, "suffix-copies")
    n = copies.count()
    rest = rows.select("doc", "cls", "text").join(broadcast_if_small(copies, n, MAX_BROADCAST_ROWS), ["doc", "cls"], "left_anti")
    return rest, copies


def sha_of(text) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def class_of(text) -> F.Column:
    """60 bits of the text's SHA-256; beside the doc_id they tell its rows apart."""
    return F.conv(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def repeats(rest: DataFrame) -> DataFrame:
    """doc, cls, lo, hi: per text the maximal runs of bytes that strings of a smaller doc_id cover."""
    keyed = rest.where(F.octet_length("text") >= WIDTH)
    keys = keyed.select("doc", "cls", "text").mapInArrow(_keys, "h long, doc long, cls long")
    shared = keys.repartition("h").sortWithinPartitions("h", "doc").mapInArrow(_shared(HOT), "doc long, cls long, low int, hot long")
    # Without doc and cls: the one row that lists the hot keys (fewer than one in HOT rows).
    lists = cut(shared.groupBy("doc", "cls").agg(F.collect_list("low").alias("wanted"), F.collect_list("hot").alias("hot")), "suffix-wanted")
    wanted = lists.where(F.col("doc").isNotNull()).drop("hot")
    hot = lists.where(F.col("doc").isNull()).select(F.explode("hot").alias("h"))
    n_hot, entries = hot.count(), wanted.agg(F.sum(32 + 4 * F.size("wanted"))).first()[0] or 0
    # Texts differ in cls under one doc_id, so a row of the list has the keys of one text.
    places = cut(_sized_join(keyed, wanted, entries, ["doc", "cls"], "inner").select("doc", "cls", "text", "wanted")
                 .mapInArrow(_places(CHUNK), "h long, doc long, cls long, around binary, places binary"), "suffix-places")
    cold, of_hot = places, places.where(F.lit(False))
    if n_hot:
        hot = broadcast_if_small(hot, n_hot, MAX_BROADCAST_ROWS)
        cold, of_hot = places.join(hot, "h", "left_anti"), places.join(hot, "h", "left_semi")
    names = ["h", "doc", "cls", "around", "places"]
    cold = cold.select(names).repartition("h").sortWithinPartitions("h")
    found = cold.mapInArrow(_rank(RUN_ROWS), "doc long, cls long, lo long, hi long")
    strings = of_hot.select(names).mapInArrow(_strings, "f long, g long, doc long, cls long, lo long")
    firsts = (strings.groupBy("f", "g").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
              .select("f", "g", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    late = (strings.withColumn("salt", F.pmod(F.xxhash64("doc", "cls"), F.lit(SALTS)).cast("int"))
            .join(firsts, ["f", "g", "salt"]).where("doc > first").select("doc", "cls", "lo", (F.col("lo") + WIDTH).alias("hi")))
    runs = found.unionByName(late).groupBy("doc", "cls").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    return runs.mapInArrow(_merge_runs, "doc long, cls long, lo array<long>, hi array<long>")


def remove_repeats(docs: DataFrame, with_kept: bool = True) -> DataFrame:
    """``docs`` with ``_n_bytes``, ``_n_removed``, ``_n_spans``, ``_spans`` (start,
    end of each removed run, in bytes), ``_kept`` (the remaining bytes, if
    ``with_kept``) and ``_kept_sha256``."""
    spark = docs.sparkSession
    ship_code(spark)
    rest, copies = first_texts(docs)
    found = cut(repeats(rest), "suffix-found")
    size = found.agg(F.sum(48 + 16 * F.size("lo"))).first()[0] or 0
    held = (_sized_join(rest.select("doc", "cls", "text"), found, size, ["doc", "cls"], "inner").select("doc", "cls", "text", "lo", "hi")
            .mapInArrow(_removal(with_kept), KEPT).dropDuplicates(["doc", "cls"]))
    held = cut(held, "suffix-kept")
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    # All that is read off the text comes before the joins: they need not move it.
    out = docs.withColumns({"_n_bytes": F.octet_length(text).cast("long"), "_cls": class_of(F.col("text")), "_doc": F.col("doc_id").cast("long"),
                            "_sha": F.sha2(text.cast("binary"), 256)})
    n_copies, kept_bytes = copies.count(), held.agg(F.sum(F.coalesce(F.octet_length("_kept"), F.lit(0)) + 120 + 16 * F.size("_spans"))).first()[0] or 0
    gone = copies.select(F.col("doc").alias("_doc"), F.col("cls").alias("_cls"), F.lit(True).alias("_copy"))
    out = out.join(broadcast_if_small(gone, n_copies, MAX_BROADCAST_ROWS), ["_doc", "_cls"], "left")
    out = _sized_join(out, held.withColumnsRenamed({"doc": "_doc", "cls": "_cls"}), kept_bytes, ["_doc", "_cls"], "left")
    whole = F.col("_copy").isNotNull() & (F.col("_n_bytes") >= WIDTH)
    all_of = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("_n_bytes").alias("end")))
    added = {
        "_n_removed": F.when(whole, F.col("_n_bytes")).otherwise(F.coalesce("_n_removed", F.lit(0).cast("long"))),
        "_n_spans": F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("_n_spans", F.lit(0).cast("long"))),
        "_spans": F.when(whole, all_of).otherwise(F.coalesce("_spans", none)),
        "_kept_sha256": F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("_kept_sha256", "_sha")),
    }
    if with_kept:
        added["_kept"] = F.when(whole, F.lit("").cast("binary")).when(F.col("_kept").isNotNull(), F.col("_kept")).otherwise(text.cast("binary"))
    return out.select(*[F.col(c) for c in docs.columns], "_n_bytes", *[v.alias(k) for k, v in added.items()])
