"""Exact top-k inner-product search over an impact-ordered, score-at-a-time index.

Vectors become integers, floor(scale * x). The index holds blocks of vectors; a
block keeps its postings (dimension, vector, impact) in ``LEVELS`` segments of
descending quantised impact, each with about as many postings. Queries are levelled
alike and searched in blocks.

For a pair of blocks, step l adds the exact products that have an impact of level l
on one side and of level l or lower on the other. What is then missing of a score is
the product of the parts below level l, bounded by Cauchy-Schwarz from the norms of
these parts. A query stops only on proof: once at most ``POSSIBLE`` vectors (or one
in ``POSSIBLE_SHARE`` of the block) can still be among its best k, or nothing is left.
A vector can be if its upper bound is not below the k-th best lower bound of the block,
nor below the query's floor. Those possible members are rescored exactly. Each pair of
blocks gives up to k rows a query; the best k of these are the result.

The floor of a query is its k-th best score in the one block of the index that its
block of queries meets first. All other pairs of blocks start from these floors; pairs
in which no query's norm times the largest norm of the index block reaches the query's
floor are left out before any postings move.

Edge cases: vectors that are null or hold a null or non-finite component, and
rows without vec_id, take no part; components that a shorter vector lacks count
as 0; rows equal in vec_id and vector count once; ties go to the smaller vec_id;
very long vectors cost memory in proportion to their components alone (matrices
hold ``COLUMNS`` dimensions of the vectors that have them); an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agendum.llm.storage import cut, ship_code

K = 5
LEVELS = 8
BLOCK_ROWS, QUERY_ROWS = 8192, 1024
POSSIBLE, POSSIBLE_SHARE = 48, 16
CHUNK = 128          # queries a task holds scores of at a time
COLUMNS = 256        # dimensions of a matrix

BLOB = "block int, top_norm double, ids binary, sizes binary, dims binary, rows binary, impacts binary"
PARTS = ["ids", "sizes", "dims", "rows", "impacts"]


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v (array of longs) of the vectors that take part, each once."""
    x = F.col("embedding")
    fine = F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf"))), F.lit(False))
    return (vectors.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(fine)
            .select(F.col("vec_id").cast("long"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v")).distinct())


def _norm(v: F.Column) -> F.Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def levels_of(impacts: np.ndarray) -> np.ndarray:
    """Level of each impact: 0 the largest, equal impacts in one level."""
    size = np.abs(impacts)
    edges = np.sort(size)[::-1][[len(size) * i // LEVELS for i in range(1, LEVELS)]] if len(size) else []
    return (size[:, None] < np.asarray(edges)[None, :]).sum(1) if len(size) else np.zeros(0, np.int64)


def _block(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """One row for a block: ids and postings by level, dimension and vector."""
    ids = rows.column("vec_id").to_numpy()
    lists = rows.column("v").combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    who = np.repeat(np.arange(len(ids)), size)
    dim = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    some = flat != 0
    who, dim, flat = who[some], dim[some], flat[some]
    level = levels_of(flat)
    order = np.lexsort((who, dim, level))
    norms = np.sqrt(np.bincount(who, flat.astype(float) ** 2, len(ids)))
    parts = [ids.astype("<i8"), np.bincount(level, minlength=LEVELS).astype("<i8"), dim[order].astype("<i4"), who[order].astype("<i4"), flat[order].astype("<i8")]
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "top_norm": [float(norms.max(initial=0))]} | {n: [p.tobytes()] for n, p in zip(PARTS, parts, strict=True)})


class Block:
    """An opened block: ids, and for every ``COLUMNS`` dimensions the vectors that
    have some with their impacts and levels; ``tail[l]``: norms of the parts below level l."""

    def __init__(self, ids: bytes, sizes: bytes, dims: bytes, rows: bytes, impacts: bytes):
        self.ids = np.frombuffer(ids, "<i8")
        level = np.repeat(np.arange(LEVELS), np.frombuffer(sizes, "<i8"))
        dim, who, impact = np.frombuffer(dims, "<i4"), np.frombuffer(rows, "<i4"), np.frombuffer(impacts, "<i8")
        squares = np.zeros((LEVELS + 1, len(self.ids)))
        for lv in range(LEVELS):
            at = level == lv
            squares[lv] = np.bincount(who[at], impact[at].astype(float) ** 2, len(self.ids))
        self.tail = np.sqrt(np.cumsum(squares[::-1], axis=0)[::-1][1:])
        self.norm = np.sqrt(squares.sum(0))
        self.largest = int(np.abs(impact).max(initial=0))
        self.width = int(np.bincount(who, minlength=1).max(initial=0))
        self.parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        order = np.argsort(dim // COLUMNS, kind="stable")
        number, starts = np.unique((dim // COLUMNS)[order], return_index=True)
        for c, at in zip(number, np.split(order, starts[1:]), strict=True) if len(number) else ():
            mine, place = np.unique(who[at], return_inverse=True)
            wide = int((dim[at] % COLUMNS).max()) + 1
            values = np.zeros((len(mine), wide), np.int64)
            levels = np.full((len(mine), wide), LEVELS, np.int8)
            values[place, dim[at] % COLUMNS] = impact[at]
            levels[place, dim[at] % COLUMNS] = level[at]
            self.parts[int(c)] = mine, values, levels


def _products(q: Block, chunk: np.ndarray, x: Block, keep, kind) -> np.ndarray:
    """Scores of the queries ``chunk`` and all vectors, over pairs of impacts:
    ``keep(q levels, x levels)`` gives the pairs of masks whose products are added."""
    out = np.zeros((len(chunk), len(x.ids)))
    for c, (mine, values, levels) in x.parts.items():
        if c not in q.parts:
            continue
        theirs, q_values, q_levels = q.parts[c]
        place = np.minimum(np.searchsorted(theirs, chunk), len(theirs) - 1)
        has = np.flatnonzero(theirs[place] == chunk)
        wide = min(values.shape[1], q_values.shape[1])
        a, b = q_values[place[has], :wide].astype(kind), values[:, :wide].astype(kind)
        for q_mask, x_mask in keep(q_levels[place[has], :wide], levels[:, :wide]):
            got = np.where(q_mask, a, 0) @ np.where(x_mask, b, 0).T
            if len(has) == len(chunk) and len(mine) == len(x.ids):
                out += got
            else:
                out[np.ix_(has, mine)] += got
    return out


def search_block(x: Block, q: Block, floors: np.ndarray, k: int):
    """(query, vec_id, score, steps) arrays: each query's best k in the block that
    reach its floor, and the steps after which it was proven."""
    found = []
    exact = x.largest * q.largest * min(x.width, q.width) < 2 ** 53
    kind = float if exact else np.int64
    need, few = min(k, len(x.ids)), max(POSSIBLE, len(x.ids) // POSSIBLE_SHARE)
    for c in range(0, len(q.ids), CHUNK):
        open_rows = np.arange(c, min(c + CHUNK, len(q.ids)))
        acc = np.zeros((len(open_rows), len(x.ids)))
        for step in range(LEVELS):
            acc += _products(q, open_rows, x, lambda a, b: [(a == step, b >= step), (a > step, b == step)], kind)   # noqa: B023
            rest = q.tail[step][open_rows, None] * x.tail[step][None, :] * (1 + 1e-9)
            if not exact:
                rest += 1e-9 * q.norm[open_rows, None] * x.norm[None, :]
            own = q.ids[open_rows, None] == x.ids[None, :]
            low = np.where(own, -np.inf, acc - rest)
            kth = np.maximum(np.partition(low, len(x.ids) - need, axis=1)[:, len(x.ids) - need], floors[open_rows])
            can = (acc + rest >= kth[:, None]) & ~own
            done = (can.sum(1) <= few) | (step == LEVELS - 1)
            for r in np.flatnonzero(done):
                rows = np.flatnonzero(can[r])
                score = _exact(q, open_rows[r], x, rows)
                best = np.lexsort((x.ids[rows], -score))[:k]
                found.append((np.full(len(best), q.ids[open_rows[r]]), x.ids[rows][best], score[best], np.full(len(best), step + 1)))
            open_rows, acc = open_rows[~done], acc[~done]
            if not len(open_rows):
                break
    if not found:
        e = np.zeros(0, np.int64)
        return e, e, e, e
    return tuple(np.concatenate(f) for f in zip(*found, strict=True))


def _exact(q: Block, r: int, x: Block, rows: np.ndarray) -> np.ndarray:
    """Integer scores of query row ``r`` and some rows of a block."""
    score = np.zeros(len(rows), np.int64)
    for c, (theirs, q_values, _) in q.parts.items():
        at = np.searchsorted(theirs, r)
        if at == len(theirs) or theirs[at] != r or c not in x.parts:
            continue
        mine, values, _ = x.parts[c]
        place = np.minimum(np.searchsorted(mine, rows), len(mine) - 1)
        has = mine[place] == rows
        wide = min(values.shape[1], q_values.shape[1])
        score[has] += values[place[has], :wide] @ q_values[at, :wide]
    return score


def top_k(vectors: DataFrame, is_query: F.Column, k: int = K, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the best ``k`` other rows of each row of which ``is_query`` holds."""
    found = _found(vectors, is_query, k, scale)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _found(vectors: DataFrame, is_query: F.Column, k: int, scale: int) -> DataFrame:
    """query_id, vec_id, score, steps: the best ``k`` of each pair of blocks that was searched."""
    spark = vectors.sparkSession
    ship_code(spark)
    rows = cut(integers(vectors, scale), "topk-vectors")
    queries = rows.where(is_query)
    n, n_queries = rows.count(), queries.count()
    n_blocks, q_blocks = max(1, -(-n // BLOCK_ROWS)), max(1, -(-n_queries // QUERY_ROWS))

    def number(count: int) -> F.Column:
        return F.pmod(F.xxhash64("vec_id", "v"), F.lit(count)).cast("int")   # a repeated vec_id fills no block

    def blocks(df: DataFrame, count: int) -> DataFrame:
        return df.withColumn("block", number(count)).groupBy("block").applyInArrow(_block, BLOB)

    index = cut(blocks(rows, n_blocks), "topk-index")
    asked = (cut(blocks(queries, q_blocks), "topk-queries").drop("top_norm")
             .withColumnsRenamed({"block": "q_block"} | {p: f"q_{p}" for p in PARTS}))

    def search(key: tuple[pa.Scalar, ...], cell: pa.Table) -> pa.Table:
        r = cell.to_pylist()[0]
        x, q = Block(*[r[p] for p in PARTS]), Block(*[r[f"q_{p}"] for p in PARTS])
        floors = np.full(len(q.ids), -np.inf)
        known = {f["query_id"]: f["floor"] for f in r["floors"] or [] if f["floor"] is not None}
        for at, me in enumerate(q.ids):
            floors[at] = known.get(int(me), -np.inf)
        q_id, v, s, steps = search_block(x, q, floors, k)
        return pa.table({"query_id": q_id.astype(np.int64), "vec_id": v.astype(np.int64), "score": s.astype(np.int64), "steps": steps.astype(np.int32)})

    def searched(cells: DataFrame) -> DataFrame:
        """``cells``: block, q_block, floors."""
        pairs = index.drop("top_norm").join(cells, "block").join(asked, "q_block")
        return pairs.groupBy("block", "q_block").applyInArrow(search, "query_id long, vec_id long, score long, steps int")

    each = asked.select("q_block")
    no_floors = F.lit(None).cast("array<struct<query_id:bigint,norm:double,floor:bigint>>").alias("floors")
    if n_blocks == 1:
        return searched(each.select(F.lit(0).alias("block"), "q_block", no_floors))
    home = F.pmod("q_block", F.lit(n_blocks))
    first = cut(searched(each.select(home.cast("int").alias("block"), "q_block", no_floors)), "topk-first")
    proven = first.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k)
    # At most a block's queries in each list; a query without a floor must meet every block.
    floors = (queries.select(number(q_blocks).alias("q_block"), F.col("vec_id").alias("query_id"), _norm(F.col("v")).alias("norm"))
              .join(proven.select("query_id", "floor"), "query_id", "left")
              .groupBy("q_block").agg(F.collect_list(F.struct("query_id", "norm", "floor")).alias("floors")))
    serves = F.exists("floors", lambda f: f["floor"].isNull() | (f["norm"] * F.col("top_norm") * (1 + 1e-9) >= f["floor"]))
    cells = (cut(floors, "topk-floors").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).where(F.col("block") != home)
             .join(index.select("block", "top_norm"), "block").where(serves)
             .select("block", "q_block", "floors"))
    return first.union(searched(cells))
