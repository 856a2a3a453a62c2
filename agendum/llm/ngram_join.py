"""N-gram Jaccard join: near-duplicate groups of whole texts by exact set
similarity of word shingles (at least ``PERCENT`` % of the union in common).

Rows with equal shingle sets are one class; the join runs over classes.

1. *Global order.* Every distinct shingle of every row is counted in a table of
   hashed counters, as many as the counted bytes of the texts ask for (``counter_bits``),
   summed by Spark. Shingles are ordered by (counter, hash): rare first, and the
   same for all rows. Any order gives the same result.
2. *Prefix index.* Of a set of n shingles the first n - ceil(0.8 n) + 1 are its
   prefix. One pass counts the prefix shingles; those that occur once can't join.
   A bitmap over the others, sized by their number (false positives only), lets a
   second pass index what may join, as (shingle, class, n, position).
3. *Star rounds.* In each (shingle, size band) a class chosen by a hash of the round
   is the pivot. Each class is compared with the pivot of another component with
   which it shares most prefix shingles: a linear number of pairs, however
   large the group.
4. *Closing round.* All pairs with a common prefix shingle that pass the filters
   and whose classes are still in different components. Pairs inside one
   component are never made: they can't change a component.
5. Pairs pass the length filter, the positional filter and the suffix filter: a
   set's sketch has one bit per hash bucket, the parity of the set's shingles in
   it, so the bits in which two sketches differ are a lower bound of the
   symmetric difference. Then each pair goes once through the exact intersection.

Components come from alternating large-star and small-star steps on the edges.

Classes, shingles and words are known by 64-bit hashes.

Edge cases: a null or empty text, or one without words, has the empty set and is
linked with nothing (its component is its own doc_id). Fewer words than ``WIDTH``
make one shingle. A very long text is hashed alone, whole. Repeated rows fall into one class. A null doc_id is ignored as
a component's name unless it is all the component has. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from agendum.llm.storage import Cuts, broadcast_if_small, cut, lean, ship_code
from agendum.llm.wordhash import WHITE, mix, shingles, slices, words

WIDTH = 5
PERCENT = 80
SET_BYTES = 1 << 18       # of texts that are hashed at once: some 60 bytes of arrays each
COUNTER_BYTES = 128       # of text for each counter of shingles
MAX_COUNT_BITS = 24       # 32 MB of levels
BLOCK_BITS = 14
BLOCK = 1 << BLOCK_BITS   # counters, or bytes of the bitmap, in a row
SKETCH_BITS = 512         # of a set for the suffix filter
MAP_ROOM = 16             # bits for each prefix shingle that occurs more than once
MAX_MAP_BITS = 29         # 64 MB
ROUNDS = 2
BROADCAST_ROWS = 2_000_000  # of (doc_id) pairs of longs: 32 MB
MAX_STEPS = 40

_U = np.uint64


def sets_of(col: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, shingle hashes, row numbers from the first row)."""
    for i, j, data, off in slices(col, SET_BYTES):
        h, _, _, text = words(data, off, WHITE)
        yield i, j, *shingles(h, text, j - i, width)


def class_ids(h: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(class, set size) per row: equal sets, equal class."""
    size = np.bincount(row, minlength=n_rows)
    out = np.zeros(n_rows, np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        head = (np.cumsum(size) - size)[full]
        out[full] = mix(np.add.reduceat(mix(h + _U(0x51ED270B)), head) + size[full].astype(np.uint64))
    return out.view(np.int64), size


def counter_bits(docs: DataFrame) -> int:
    """One counter for every ``COUNTER_BYTES`` bytes of text: the share of shingles that
    have their counter to themselves is the same at every size up to 2**MAX_COUNT_BITS."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return min(MAX_COUNT_BITS, max(BLOCK_BITS, math.ceil(size / COUNTER_BYTES).bit_length()))


def _count(batches: Iterator[pa.RecordBatch], width: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Counters in blocks; a block is one row for each byte of its largest number."""
    total = np.zeros(1 << bits, np.uint32)
    for batch in batches:
        for _, _, h, _ in sets_of(batch.column(0), width):
            np.add.at(total, (h >> _U(64 - bits)).astype(np.int64), np.uint32(1))
    for b in range(0, 1 << bits, BLOCK):
        part, place = total[b:b + BLOCK], 0
        while part.any():
            packed = zlib.compress((part & 255).astype(np.uint8).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([b // BLOCK]), pa.array([place]), pa.array([packed])], names=["block", "place", "counts"])
            part, place = part >> 8, place + 8


def _levels(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The summed counters of a block, as levels."""
    total = np.zeros(BLOCK, np.int64)
    for place, packed in zip(table.column("place").to_pylist(), table.column("counts"), strict=True):
        total += np.frombuffer(zlib.decompress(packed.as_py()), np.uint8).astype(np.int64) << place
    return pa.table({"block": [key[0].as_py()], "levels": [rank_levels(total).astype("<u2").tobytes()]})


def count_levels(docs: DataFrame, width: int, bits: int) -> np.ndarray:
    """Level of the document frequency of shingles by hashed counter, over all
    rows: 2**bits numbers, at most 2 * 2**MAX_COUNT_BITS bytes."""
    parts = (docs.select("text").mapInArrow(lambda b: lean(_count(b, width, bits)), "block long, place long, counts binary")
             .groupBy("block").applyInArrow(_levels, "block long, levels binary"))
    out = np.zeros(1 << bits, np.uint16)
    for r in parts.collect():   # at most 2**(bits - BLOCK_BITS) rows
        out[r.block * BLOCK:(r.block + 1) * BLOCK] = np.frombuffer(r.levels, "<u2")
    return out


def rank_levels(counts: np.ndarray) -> np.ndarray:
    """Counters as 16-bit levels of the same order: exact when small, then in
    steps of about 0.1 %."""
    big = np.log(np.maximum(counts, 1)) * 1000
    return np.minimum(np.where(counts < 1000, counts, big - math.log(1000) * 1000 + 1000), 65535).astype(np.uint16)


def prefix_length(n, percent: int):
    return n - -(-n * percent // 100) + 1


def least_overlap(n, m, percent: int):
    """Smallest intersection with which sets of n and m reach ``percent`` % of their union."""
    return -(-(percent * (n + m)) // (100 + percent))


def _prefixes(batches: Iterator[pa.RecordBatch], levels, width: int, percent: int, bits: int):
    """(token, class, set size, position) arrays of the prefixes of the batches' sets."""
    seen: set[int] = set()
    level = levels.value
    for batch in batches:
        for i, j, h, row in sets_of(batch.column(0), width):
            cls, size = class_ids(h, row, j - i)
            fresh = np.zeros(j - i, bool)   # copies of a set that this task has indexed add nothing
            for k, c in enumerate(cls.tolist()):
                if size[k] and c not in seen:
                    seen.add(c)
                    fresh[k] = True
            if len(seen) > 1 << 17:
                seen.clear()
            pick = fresh[row]
            h2, row2 = h[pick], row[pick]
            if not len(h2):
                continue
            order = np.lexsort((h2, level[(h2 >> _U(64 - bits)).astype(np.int64)], row2))
            h2, row2 = h2[order], row2[order]
            n = size[row2]
            head = np.flatnonzero(np.append(True, row2[1:] != row2[:-1]))
            place = np.arange(len(h2)) - np.repeat(head, np.diff(np.append(head, len(h2))))
            keep = place < prefix_length(n, percent)
            yield h2[keep], cls[row2[keep]], n[keep], place[keep]


def _prefix_tokens(batches, levels, width, percent, bits) -> Iterator[pa.RecordBatch]:
    for token, _, _, _ in _prefixes(batches, levels, width, percent, bits):
        yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64))], names=["token"])


def _bit(token: np.ndarray, bits: int) -> np.ndarray:
    return (mix(token) >> _U(64 - bits)).astype(np.int64)


def _bitmap(batches: Iterator[pa.RecordBatch], map_bits: int) -> Iterator[pa.RecordBatch]:
    packed = np.zeros(1 << (map_bits - 3), np.uint8)
    for batch in batches:
        at = _bit(batch.column(0).to_numpy().view(np.uint64), map_bits)
        np.bitwise_or.at(packed, at >> 3, (128 >> (at & 7)).astype(np.uint8))
    for b in range(0, len(packed), BLOCK):
        part = packed[b:b + BLOCK]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([b // BLOCK]), pa.array([part.tobytes()])], names=["block", "bits"])


def _either(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = np.zeros(BLOCK, np.uint8)
    for c in table.column("bits"):
        total |= np.frombuffer(c.as_buffer(), np.uint8)
    return pa.table({"block": [key[0].as_py()], "bits": [total.tobytes()]})


def shared_map(cuts: Cuts, tokens: DataFrame) -> tuple[np.ndarray, int]:
    """Bitmap of the tokens that occur more than once, ``MAP_ROOM`` bits for each
    up to 2**MAX_MAP_BITS, and the power of two of its size."""
    often = cuts.cut(tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token"), "ngram-often")
    map_bits = min(MAX_MAP_BITS, max(BLOCK_BITS + 3, (often.count() * MAP_ROOM).bit_length()))
    parts = (often.coalesce(16).mapInArrow(lambda b: lean(_bitmap(b, map_bits)), "block long, bits binary")
             .groupBy("block").applyInArrow(_either, "block long, bits binary"))
    out = np.zeros(1 << (map_bits - 3), np.uint8)
    for r in parts.collect():    # 2**map_bits bits at most
        out[r.block * BLOCK:(r.block + 1) * BLOCK] = np.frombuffer(r.bits, np.uint8)
    cuts.drop(often)
    return out, map_bits


def _index(batches, levels, shared, map_bits, width, percent, bits) -> Iterator[pa.RecordBatch]:
    for token, cls, n, place in _prefixes(batches, levels, width, percent, bits):
        at = _bit(token, map_bits)
        keep = (shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
        yield pa.RecordBatch.from_arrays([
            pa.array(token[keep].view(np.int64)), pa.array(cls[keep]), pa.array(n[keep].astype(np.int32)), pa.array(place[keep].astype(np.int32))],
            names=["token", "cls", "n", "pos"])


def _describe(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, h, row in sets_of(batch.column(1), width):
            cls, size = class_ids(h, row, j - i)
            bucket = row * SKETCH_BITS + (h >> _U(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64)
            odd = np.bincount(bucket, minlength=(j - i) * SKETCH_BITS) & 1
            longs = np.packbits(odd.astype(bool)).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(i, j - i), pa.array(cls), pa.array(size.astype(np.int64)),
                pa.FixedSizeListArray.from_arrays(pa.array(longs), SKETCH_BITS // 64).cast(pa.list_(pa.int64()))],
                names=["doc_id", "cls", "n", "sketch"])


def _full_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, h, row in sets_of(batch.column(0), width):
            cls, size = class_ids(h, row, j - i)
            ends = np.append(0, np.cumsum(size)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], names=["cls", "shingles"])


def overlap_enough(x: F.Column, y: F.Column, percent: int) -> F.Column:
    """Whether two sets (arrays of distinct hashes) share ``percent`` % of their
    union. Row by row in Spark, so memory is that of one pair."""
    both, all_ = F.size(F.array_intersect(x, y)).cast("long"), (F.size(x) + F.size(y)).cast("long")
    return both * 100 >= (all_ - both) * percent


def may_link(x: str, y: str, percent: int) -> F.Column:
    """Length and positional filter of index rows (columns n, pos) under the two prefixes."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return ((F.least(n, m) * 100 >= F.greatest(n, m) * percent)
            & (F.least(n - F.col(f"{x}.pos"), m - F.col(f"{y}.pos")) >= least(n, m, percent)))


def least(n: F.Column, m: F.Column, percent: int) -> F.Column:
    return F.ceil((n + m) * percent / (100 + percent))


def bits_apart(a: F.Column, b: F.Column) -> F.Column:
    """Bits in which two sketches differ: at most the symmetric difference of the sets."""
    apart = F.lit(0)
    for k in range(SKETCH_BITS // 64):
        apart = apart + F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k))))
    return apart


def sketches_allow(n: F.Column, a: F.Column, m: F.Column, b: F.Column, percent: int) -> F.Column:
    """Suffix filter: the sketches don't differ more than sets that link may."""
    return bits_apart(a, b) <= n + m - 2 * least(n, m, percent)


def sketched(pairs: DataFrame, classes: DataFrame, a: str, b: str, percent: int) -> DataFrame:
    """The pairs (columns ``a`` and ``b`` of classes) that pass the suffix filter."""
    side = lambda c, k: classes.select(F.col("cls").alias(c), F.col("n").alias(f"_n{k}"), F.col("sketch").alias(f"_s{k}"))
    return (pairs.join(side(a, 1), a).join(side(b, 2), b)
            .where(sketches_allow(F.col("_n1"), F.col("_s1"), F.col("_n2"), F.col("_s2"), percent)).select(*pairs.columns))


def linked(cuts: Cuts, docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link. ``classes``: cls, doc_id of one member."""
    pairs = cuts.cut(pairs, "ngram-pairs")
    wanted = cuts.cut(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes.select("cls", "doc_id"), "cls"), "ngram-wanted")
    rows = wanted.count()
    texts = docs.join(broadcast_if_small(wanted.select(F.col("doc_id").alias("wanted_id")).distinct(), rows, BROADCAST_ROWS),
                      F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
    sets = (texts.select("text").mapInArrow(lambda b: lean(_full_sets(b, width)), "cls long, shingles array<long>")
            .join(broadcast_if_small(wanted.select("cls"), rows, BROADCAST_ROWS), "cls", "left_semi").dropDuplicates(["cls"]))
    both = (pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("set_a")), "a")
            .join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("set_b")), "b"))
    edges = cuts.cut(both.where(overlap_enough(F.col("set_a"), F.col("set_b"), percent)).select("a", "b"), "ngram-edges")
    cuts.drop(pairs, wanted)
    return edges


def settled(edges: DataFrame) -> bool:
    """Whether the edges (u, v), v < u, are stars: every u has one v, and no u is a v."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("leaf")).union(edges.select("v", F.lit(0)))
    open_ends = ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.count("*").alias("n")).where("leaf > 0 and n > 1")
    return open_ends.agg(F.count("*")).first()[0] == 0


def star_components(cuts: Cuts, edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of the component. Alternating
    large-star and small-star steps (Kiveris et al., SoCC 2014) until the edges are
    stars; each step is written to the shared folder, in place of the one before."""
    cur = cuts.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    for _ in range(MAX_STEPS):
        if settled(cur):
            break
        both = cur.union(cur.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        last, cur = cur, cuts.cut(small.where("u <> v").distinct(), "components")
        cuts.drop(last)
    else:
        raise RuntimeError("components did not settle")
    return cur


def merge_components(cuts: Cuts, comp: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(node, root) after the edges join components, in place of ``comp`` and
    ``edges``; nodes that are roots aren't listed."""
    if comp is None:
        new = star_components(cuts, edges)
        out = cuts.cut(new.select(F.col("u").alias("node"), F.col("v").alias("root")), "components")
        cuts.drop(new, edges)
        cuts.release()
        return out
    of = comp.select(F.col("node").alias("n"), "root")
    mapped = (edges.join(of.withColumnsRenamed({"n": "a", "root": "ra"}), "a", "left").join(of.withColumnsRenamed({"n": "b", "root": "rb"}), "b", "left")
              .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    new = star_components(cuts, mapped)
    moved = comp.join(new.select(F.col("u").alias("root"), F.col("v").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    out = cuts.cut(moved.union(new.select("u", "v")), "components")
    cuts.drop(comp, edges, new)
    cuts.release()
    return out


def with_roots(index: DataFrame, comp: DataFrame | None) -> DataFrame:
    """``index`` with the component (root) of each row's class."""
    if comp is None:
        return index.withColumn("root", F.col("cls"))
    return index.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return components(docs, width, percent, rounds).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n, cls, root, component_id of every row; ``root``: one class of the component."""
    spark = docs.sparkSession
    ship_code(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    cuts = Cuts(spark)
    bits = counter_bits(docs)
    levels = spark.sparkContext.broadcast(count_levels(docs, width, bits))

    described = cuts.cut(docs.mapInArrow(lambda b: lean(_describe(b, width)), "doc_id long, cls long, n long, sketch array<long>"), "ngram-rows")
    classes = cuts.cut(described.where("n > 0").groupBy("cls").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("doc_id")), "ngram-classes")

    shared, map_bits = shared_map(cuts, docs.select("text").mapInArrow(lambda b: lean(_prefix_tokens(b, levels, width, percent, bits)), "token long"))
    shared = spark.sparkContext.broadcast(shared)
    first = cuts.cut(docs.select("text").mapInArrow(lambda b: lean(_index(b, levels, shared, map_bits, width, percent, bits)), "token long, cls long, n int, pos int"), "ngram-index")
    for table in (levels, shared):      # later steps start from the written index
        table.destroy()
    several = first.groupBy("token").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("token")
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int")
    index = cuts.cut(first.join(several, "token").withColumn("band", band), "ngram-index")
    cuts.drop(first)

    comp = None
    for r in range(rounds):
        rows = with_roots(index, comp)
        pivots = (rows.groupBy("token", "band").agg(
            F.min_by(F.struct("cls", "root", "n", "pos"), F.xxhash64("cls", F.lit(r))).alias("p"), F.min("root").alias("lo"), F.max("root").alias("hi"))
            .where("lo <> hi").select("token", "band", "p"))
        star = (rows.alias("x").join(pivots, ["token", "band"]).where("x.root <> p.root").where(may_link("x", "p", percent))
                .groupBy("cls", F.col("p.cls").alias("pivot")).agg(F.count("*").alias("shared")))
        best = (sketched(star, classes, "cls", "pivot", percent)
                .groupBy("cls").agg(F.max_by("pivot", F.struct("shared", "pivot")).alias("pivot")))
        pairs = best.select(F.least("cls", "pivot").alias("a"), F.greatest("cls", "pivot").alias("b")).distinct()
        comp = merge_components(cuts, comp, linked(cuts, docs, classes, pairs, width, percent))

    # Closing round: what is left between components.
    rows = with_roots(index, comp)
    mixed = rows.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    # ``prev``: the open prefix shingle before this one. Where both rows of a pair
    # have the same, the pair is found there already, so each run of common
    # shingles gives a pair once.
    left = cuts.cut(rows.join(mixed, "token").join(classes.select("cls", "sketch"), "cls").drop("band")
               .withColumn("prev", F.lag("token").over(Window.partitionBy("cls").orderBy("pos", "token"))), "ngram-open")
    cuts.drop(index)
    open_pairs = cuts.cut(
        left.alias("x").join(left.alias("y"), "token")
        .where("x.root <> y.root and (x.n < y.n or (x.n = y.n and x.cls < y.cls))").where(may_link("x", "y", percent))
        .where(~F.coalesce(F.col("x.prev") == F.col("y.prev"), F.lit(False)))
        .where(sketches_allow(F.col("x.n"), F.col("x.sketch"), F.col("y.n"), F.col("y.sketch"), percent))
        .select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"), F.col("x.root").alias("ra"), F.col("y.root").alias("rb"),
                bits_apart(F.col("x.sketch"), F.col("y.sketch")).alias("apart")).distinct(), "ngram-open-pairs")
    cuts.drop(left)
    # First the nearest of each other component, which joins most components that
    # belong together; then every pair that is still between components.
    nearest = (open_pairs.groupBy("a", "rb").agg(F.min_by("b", F.struct("apart", "b")).alias("b")).select("a", "b")
               .union(open_pairs.groupBy("b", "ra").agg(F.min_by("a", F.struct("apart", "a")).alias("a")).select("a", "b")).distinct())
    nearest = cuts.cut(nearest, "ngram-nearest")
    comp = merge_components(cuts, comp, linked(cuts, docs, classes, nearest, width, percent))
    of = comp.select("node", "root")
    still = (open_pairs.select("a", "b").join(nearest, ["a", "b"], "left_anti")
             .join(of.withColumnsRenamed({"node": "a", "root": "ra"}), "a", "left").join(of.withColumnsRenamed({"node": "b", "root": "rb"}), "b", "left")
             .where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"))
    open_links = linked(cuts, docs, classes, still, width, percent)
    cuts.drop(open_pairs, nearest)
    comp = merge_components(cuts, comp, open_links)

    first = classes.select("cls", F.col("doc_id").alias("first_id"))
    groups = comp.union(comp.select("root", "root").distinct())
    named = groups.join(first.withColumnRenamed("cls", "node"), "node")
    names = named.groupBy("root").agg(F.min("first_id").alias("name"))
    names = named.join(names, "root").select(F.col("node").alias("cls"), "name", "root")
    of_class = first.join(names, "cls", "left").select("cls", F.coalesce("name", "first_id").alias("component_id"), F.coalesce("root", "cls").alias("root"))
    return (described.select("doc_id", "n", "cls").join(of_class.withColumn("some", F.lit(1)), (described.cls == of_class.cls) & (described.n > 0), "left")
            .select("doc_id", "n", described.cls, "root", F.when(F.col("some").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the
    smallest doc_id stays, once. Rows without a doc_id and unlinked rows stay,
    also where several rows have one doc_id."""
    groups = cut(components(docs, width, percent).where("doc_id is not null"), "ngram-groups")
    stay = groups.where("n > 0").groupBy("root").agg(F.min(F.struct("doc_id", "cls")).alias("s")).select("s.doc_id", "s.cls")
    shared = cut(groups.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "ngram-shared-ids")
    once = stay.select("doc_id").union(groups.where("n = 0").select("doc_id")).join(shared, "doc_id", "left_anti")
    names = docs.columns
    at = names.index("text")
    schema = StructType([*docs.schema.fields, StructField("_cls", LongType()), StructField("_n", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, row in sets_of(batch.column(at), width):
                cls, size = class_ids(h, row, j - i)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cls), pa.array(size.astype(np.int64))], names=[*names, "_cls", "_n"])

    # Rows that share their doc_id are known by their class as well.
    columns = ["`" + c.replace("`", "``") + "`" for c in names]
    several = docs.join(shared, "doc_id", "left_semi").select(*columns).mapInArrow(lambda b: lean(run(b)), schema)
    of_class = several.where("_n > 0").join(stay.withColumnRenamed("cls", "_cls"), ["doc_id", "_cls"], "left_semi").dropDuplicates(["doc_id", "_cls"])
    return (docs.join(once, "doc_id", "left_semi").select(*columns).union(of_class.select(*columns))
            .union(several.where("_n = 0").select(*columns)).union(docs.where("doc_id is null")))
