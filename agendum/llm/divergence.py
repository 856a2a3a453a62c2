"""Source divergence audit: how far each source of a language departs from the
others and from the language, and by which terms.

Terms are runs of characters other than ASCII non-letters, A-Z lower-cased; a
language keeps the terms of at least ``MIN_DOCUMENTS`` of its documents (rows).
With counts c, N their sum over the V kept terms, a term's share in a group or
language is ``1 + floor(SCALE * (c + 5) / (N + 5 * V))``, in exact integers.

* ``pair``: the sum of absolute differences of two sources' shares over all kept
  terms. Sources are dealt into blocks of ``TILE``; a task sums the terms of one
  hash part for one pair of blocks, term rows that neither block has are added
  from the two base shares (count 0).
* ``term``: a term with a higher group count, a lower language count and an
  earlier UTF-8 name ranks no later, whatever the totals are. So each partition
  keeps, per group, the terms that fewer than k others dominate in these three
  (the dominance skyband, built batch by batch); the partitions' skybands are
  merged by the same step and only what is left is ranked exactly.

Counting: workers turn slices of whole texts into counts by (language, source,
term), which are shuffled once, by (language, term); both the groups' counts and
the language's follow from that one partitioning.

Edge cases: null text, lang and source count as empty; a repeated row counts as
often as it stands there; a group without terms has all its shares at the base
value; without kept terms (V = 0) pairs have value 0 and there are no terms; ties
go to the earlier UTF-8 name; very long texts are counted whole, one at a time;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agendum.llm.storage import cut, ship_code
from agendum.llm.wordhash import LOWER, byte_set, slices

MIN_DOCUMENTS = 30
SCALE = 1_000_000_000
PRIOR = 5
TERMS = 50            # ranks of the part `term`
TILE = 256            # sources of a block
PART_ROWS = 500_000   # term rows of one hash part
HELD_ROWS = 400_000   # counts a worker gathers before it hands them on
STEP_TERMS = 2048     # terms of a dense block

NOT_LETTER = byte_set((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))

COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _terms(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(terms, text numbers), in order, repeated terms included."""
    folded = LOWER[data]
    inside = ~NOT_LETTER[folded]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    place = np.concatenate(([0], np.cumsum(ends - starts)))
    terms = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(place), pa.py_buffer(folded[inside])])
    return terms, np.searchsorted(off, starts, "right") - 1


def _group(table: pa.Table) -> pa.Table:
    out = table.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return out.rename_columns(["lang", "source", "term", "n", "docs"]).select(COUNTS.names)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and documents of each (lang, source, term) of the slices read."""
    held, n = [], 0
    for batch in batches:
        names = pa.StructArray.from_arrays([pc.fill_null(batch.column(k), "") for k in (0, 1)], ["l", "s"])
        for i, j, data, off in slices(batch.column(2), 1 << 22):
            terms, text = _terms(data, off)
            if not len(text):
                continue
            coded = terms.dictionary_encode()
            code = coded.indices.to_numpy().astype(np.int64)
            size = len(coded.dictionary)
            both, n_both = np.unique(text * size + code, return_counts=True)
            text, code = both // size, both % size
            mine = names.slice(i, j - i)
            seen = pa.table({"lang": mine.field(0).take(pa.array(text)), "source": mine.field(1).take(pa.array(text)),
                             "term": coded.dictionary.cast(pa.binary()).cast(pa.string()).take(pa.array(code)),
                             "n": pa.array(n_both.astype(np.int64)), "docs": pa.array(np.ones(len(code), np.int64))}, schema=COUNTS)
            held.append(_group(seen))
            n += held[-1].num_rows
            if n >= HELD_ROWS:
                held = [_group(pa.concat_tables(held))]
                n = held[0].num_rows
                if n >= HELD_ROWS // 2:
                    yield from held[0].to_batches()
                    held, n = [], 0
    if held:
        yield from _group(pa.concat_tables(held)).to_batches()


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept)), exact; null without kept terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    top, bottom = wide(count + PRIOR) * F.lit(SCALE).cast("decimal(11,0)"), wide(total + PRIOR * kept)
    top, bottom = top.alias("top"), bottom.alias("bottom")
    return F.when(kept > 0, 1 + F.call_function("div", top, bottom))


def kept_terms(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """lang, source, term, n (there), lang_n: counts above 0 of the kept terms."""
    ship_code(docs.sparkSession)
    counts = docs.select(F.col("lang").cast("string"), F.col("source").cast("string"), "text").mapInArrow(
        _count, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    by_group = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # One row per source that has the term: the language's sums need no other partitioning.
    whole = W.partitionBy("lang", "term")
    out = by_group.withColumn("lang_n", F.sum("n").over(whole)).withColumn("lang_docs", F.sum("docs").over(whole))
    return out.where(F.col("lang_docs") >= min_documents).select("lang", "source", "term", "n", "lang_n")


def totals(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """One row per occurring (lang, source): total, lang_total, kept, base (share
    of a term it lacks), place (number of the source in its language, from 0)."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    groups = docs.select(name("lang"), name("source")).distinct()
    own = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # A term's language count stands beside each of its sources: one of them is taken.
    first = terms.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n"))
    langs = first.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("kept"))
    zero = F.lit(0).cast("long")
    out = (groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left")
           .select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "lang_total", "kept")]))
    return out.withColumns({"base": F.coalesce(_share(zero, F.col("total"), F.col("kept")), zero),
                            "place": F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1})


# --- part `pair` --------------------------------------------------------------

SUMS = "lang string, a int, b int, total long, terms long"


def _tile_sums(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """For one hash part of a language's terms and two blocks of its sources:
    summed differences of each two sources, and the number of terms seen."""
    lang, ta, tb = (k.as_py() for k in key[:3])
    place, share = (rows.column(c).to_numpy() for c in ("place", "share"))
    term = rows.column("term").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
    bases = {t: np.zeros(TILE, np.int64) for t in (ta, tb)}
    used, order = {}, {}
    for t in bases:
        base = np.flatnonzero((place // TILE == t) & (term < 0))
        bases[t][place[base] % TILE] = share[base]
        used[t] = np.unique(place[base] % TILE)
        at = np.flatnonzero((place // TILE == t) & (term >= 0))
        order[t] = at[np.argsort(term[at], kind="stable")]
    n_terms = int(term.max(initial=-1)) + 1
    out = np.zeros((TILE, TILE), np.int64)
    for lo in range(0, n_terms, STEP_TERMS):
        hi = min(lo + STEP_TERMS, n_terms)
        dense = {}
        for t, at in order.items():
            at = at[slice(*np.searchsorted(term[at], (lo, hi)))]
            dense[t] = np.repeat(bases[t][None, :], hi - lo, axis=0)
            dense[t][term[at] - lo, place[at] % TILE] = share[at]
        for s in used[ta]:
            out[s, used[tb]] += np.abs(dense[tb][:, used[tb]] - dense[ta][:, s:s + 1]).sum(axis=0)
    a, b = np.meshgrid(used[ta], used[tb], indexing="ij")
    a, b = a.ravel(), b.ravel()
    keep = (ta * TILE + a) < (tb * TILE + b)
    a, b = a[keep], b[keep]
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(ta * TILE + a, pa.int32()), "b": pa.array(tb * TILE + b, pa.int32()),
                     "total": pa.array(out[a, b]), "terms": pa.array(np.full(len(a), n_terms, np.int64))})


def pairs(terms: DataFrame, groups: DataFrame, n_rows: int) -> DataFrame:
    """lang, source, item, value: summed differences for each two sources of a
    language, in both directions. ``n_rows``: counted rows of ``terms``.

    Terms are dealt by a hash of the term; every part also has one row (term
    null) with the base share of each source of either block."""
    parts = max(1, -(-n_rows // PART_ROWS))
    last_tile = F.floor((F.max("place").over(W.partitionBy("lang"))) / TILE).cast("int")
    g = groups.withColumn("tile", F.floor(F.col("place") / TILE).cast("int")).withColumn("last", last_tile)
    # To which pairs of blocks (ta <= tb) a source's rows go.
    to = F.transform(F.sequence(F.lit(0), F.col("last")), lambda t: F.named_struct(F.lit("ta"), F.least(t, F.col("tile")), F.lit("tb"), F.greatest(t, F.col("tile"))))
    rows = (terms.join(g, ["lang", "source"])
            .select("lang", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("part"), "term", "place",
                    _share(F.col("n"), F.col("total"), F.col("kept")).alias("share"), to.alias("to")))
    bases = g.where("kept > 0").select("lang", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(None).cast("string").alias("term"),
                                       "place", F.col("base").alias("share"), to.alias("to"))
    sums = (rows.unionByName(bases).withColumn("to", F.explode("to")).select("lang", "to.ta", "to.tb", "part", "term", "place", "share")
            .groupBy("lang", "ta", "tb", "part").applyInArrow(_tile_sums, SUMS)
            .groupBy("lang", "a", "b").agg(F.sum("total").alias("total"), F.sum("terms").alias("terms")))
    left = groups.select("lang", F.col("source").alias("source_a"), F.col("place").alias("a"), F.col("base").alias("base_a"), "kept")
    right = groups.select("lang", F.col("source").alias("source_b"), F.col("place").alias("b"), F.col("base").alias("base_b"))
    zero = F.lit(0).cast("long")
    both = (left.join(right, "lang").where("a < b").join(sums, ["lang", "a", "b"], "left")
            .withColumn("value", F.coalesce("total", zero) + (F.col("kept") - F.coalesce("terms", zero)) * F.abs(F.col("base_a") - F.col("base_b"))))
    turn = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")),
                             F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))).alias("p")
    return both.select("lang", turn, "value").select("lang", "p.source", "p.item", "value")


# --- part `term` --------------------------------------------------------------

BAND = "lang string, source string, term string, n long, lang_n long"


def skyband(n: np.ndarray, lang_n: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """Rows that fewer than ``k`` others dominate: n not lower, lang_n not higher,
    name not later. Rows are settled in an order in which dominators come first,
    and only rows kept so far need counting: k dominators imply k kept ones."""
    order = np.lexsort((name, lang_n, -n))
    n, lang_n, name = n[order], lang_n[order], name[order]
    # Of rows equal in both counts only the first k by name can stay.
    new = np.append(True, (n[1:] != n[:-1]) | (lang_n[1:] != lang_n[:-1]))[:len(n)]
    start = np.flatnonzero(new)
    nth = np.arange(len(n)) - np.repeat(start, np.diff(np.append(start, len(n))))
    todo = np.flatnonzero(nth < k)
    kept = np.zeros(0, np.int64)
    for lo in range(0, len(todo), 512):
        some = todo[lo:lo + 512]
        # n never rises along the order, so all earlier rows pass its test.
        above = np.zeros(len(some), np.int64)
        for c in range(0, len(kept), 4096):
            old = kept[c:c + 4096]
            above += ((lang_n[old][None, :] <= lang_n[some][:, None]) & (name[old][None, :] <= name[some][:, None])).sum(axis=1)
        some, above = some[above < k], above[above < k]
        inner = (lang_n[some][None, :] <= lang_n[some][:, None]) & (name[some][None, :] <= name[some][:, None])
        inner &= np.tri(len(some), k=-1, dtype=bool)
        kept = np.append(kept, some[above + inner.sum(axis=1) < k])
    return order[kept]


def _merge(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (lang, source): the skyband of each group, batch by batch."""
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            group = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["l", "s"])
            code = group.field(0).dictionary_encode().indices.to_numpy() * batch.num_rows + group.field(1).dictionary_encode().indices.to_numpy()
            cuts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            for a, b in zip(cuts, np.append(cuts[1:], len(code)), strict=True):
                rows = pa.Table.from_batches([batch.slice(a, b - a)])
                if held is not None and all(held.column(c)[0] == rows.column(c)[0] for c in (0, 1)):
                    rows = pa.concat_tables([held, rows])
                elif held is not None:
                    yield from held.combine_chunks().to_batches()
                # Arrow sorts strings by their bytes, so ranks stand for names.
                name = pc.rank(rows.column("term"), tiebreaker="dense").to_numpy().astype(np.int64)
                held = rows.take(pa.array(skyband(rows.column("n").to_numpy(), rows.column("lang_n").to_numpy(), name, k)))
        if held is not None:
            yield from held.combine_chunks().to_batches()
    return run


def telling_terms(terms: DataFrame, groups: DataFrame, k: int = TERMS) -> DataFrame:
    """lang, source, item, value of the first ``k`` terms whose share in the group
    is above the language's."""
    names = ["lang", "source", "term", "n", "lang_n"]
    local = terms.select(names).sortWithinPartitions("lang", "source").mapInArrow(_merge(k), BAND)
    merged = local.repartition("lang", "source").sortWithinPartitions("lang", "source").mapInArrow(_merge(k), BAND)
    shares = (merged.join(groups, ["lang", "source"])
              .withColumn("p", _share(F.col("n"), F.col("total"), F.col("kept"))).withColumn("q", _share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))))
    return shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, k: int = TERMS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: all other sources of
    the language by difference, and the first ``k`` terms by excess share."""
    terms = cut(kept_terms(docs, min_documents), "divergence-terms")
    groups = cut(totals(docs, terms), "divergence-groups")
    place = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(place).alias("rank"))
    first = ranked(telling_terms(terms, groups, k), "term").where(F.col("rank") <= k)
    return ranked(pairs(terms, groups, terms.count()), "pair").unionByName(first)
