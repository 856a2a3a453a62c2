"""Sharding by fixed virtual slots.

A record's slot is a hash of its key, one of ``SLOTS`` for ever. The map from
slots to shards is a small versioned table (SLOTS rows, whatever the data):
version 0 deals contiguous runs of slots out evenly; rebalancing starts from the
newest stored version and adds one that moves as few slots as it takes to make the
shards' bytes near equal, or none if no move helps. Bytes per slot are aggregated
before anything is shuffled by slot.

A record's place in its shard is the shard's smaller cells' rows before it, plus
its number in its own cell. Cells are slots split by more bits of the same hash,
as many as keep a cell near ``CELL_ROWS`` rows, so no task numbers a whole shard.

Edge cases: a null text has no bytes; a null key is hashed like a value; repeated
rows share a slot and get a place each; an empty table gives no rows and an even
map; other columns are kept out of the plan.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agendum.llm.storage import cut, new_path

SLOTS = 4096
CELL_ROWS = 20_000
ROW_BYTES = 8
MAP_SCHEMA = "version int, slot int, shard int, bytes long"


def slot_hash(key: str = "doc_id") -> F.Column:
    return F.xxhash64(F.col(key))


def with_slots(docs: DataFrame, key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """key, size (UTF-8 bytes of the text plus 8), text_crc32, hash and virtual slot of every row."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(key), (F.length(raw) + ROW_BYTES).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
                       slot_hash(key).alias("hash")).withColumn("virtual_slot", F.pmod("hash", F.lit(slots)).cast("int"))


def even_map(shards: int, slots: int = SLOTS) -> list[int]:
    return [s * shards // slots for s in range(slots)]


def rebalance(owner: list[int], load: list[int], shards: int) -> list[int]:
    """``owner`` with some slots moved so that the shards' loads are near equal:
    shards above the mean give slots up, largest first, while they stay above
    it; then the freed slots go, largest first, to the lightest shard; then single
    moves and swaps between heaviest and lightest shard while they help."""
    owner = list(owner)
    total = [0] * shards
    for s, o in enumerate(owner):
        total[o] += load[s]
    mean = sum(load) / shards
    freed = []
    for s in sorted(range(len(owner)), key=lambda s: (-load[s], s)):
        if load[s] and total[owner[s]] - load[s] >= mean:
            total[owner[s]] -= load[s]
            freed.append(s)
    for s in freed:
        o = min(range(shards), key=lambda k: (total[k], k))
        owner[s] = o
        total[o] += load[s]
    for _ in range(40 * shards):
        hi, lo = max(range(shards), key=lambda k: (total[k], -k)), min(range(shards), key=lambda k: (total[k], k))
        gap = total[hi] - total[lo]
        mine = [s for s in range(len(owner)) if owner[s] == hi and load[s]]
        theirs = sorted((load[s], s) for s in range(len(owner)) if owner[s] == lo)
        best = min(((abs(gap - 2 * load[s]), s, None) for s in mine), default=(gap, -1, None), key=lambda x: x[:2])
        from bisect import bisect_left
        for s in mine:   # a swap moves the difference of two slots
            at = bisect_left(theirs, (load[s] - gap // 2, -1))
            for size, t in theirs[max(0, at - 1):at + 1]:
                best = min(best, (abs(gap - 2 * (load[s] - size)), s, t), key=lambda x: x[0])
        if best[0] >= gap:
            break
        _, s, t = best
        owner[s] = lo
        total[hi] -= load[s]
        total[lo] += load[s]
        if t is not None:
            owner[t] = hi
            total[lo] -= load[t]
            total[hi] += load[t]
    return owner


def write_map(spark: SparkSession, path: str, version: int, owner: list[int], load: list[int]) -> None:
    """Add a version to the stored map; versions are never changed."""
    rows = [(version, s, o, b) for s, (o, b) in enumerate(zip(owner, load, strict=True))]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """slot and shard of a version, the newest by default."""
    stored = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == version).select(F.col("slot").alias("virtual_slot"), "shard")


def spread(owner: list[int], load: list[int], shards: int) -> int:
    """Bytes between the heaviest and the lightest shard."""
    total = [0] * shards
    for s, o in enumerate(owner):
        total[o] += load[s]
    return max(total) - min(total)


def newest_version(spark: SparkSession, path: str) -> tuple[int, list[int]] | None:
    """(version, owner of each slot) of the newest stored map, if there is one."""
    try:
        version = spark.read.schema(MAP_SCHEMA).parquet(path).agg(F.max("version")).first()[0]
    except AnalysisException:
        return None
    if version is None:
        return None
    return version, [r["shard"] for r in read_map(spark, path, version).orderBy("virtual_slot").collect()]    # SLOTS rows


def edit_map(spark: SparkSession, path: str, load: list[int], shards: int) -> int:
    """Rebalance the stored map for the bytes per slot; the version to use. A map
    without versions gets version 0 first. Slots of shards that are no more go to
    others; a version is added only if it differs."""
    stored = newest_version(spark, path)
    if stored is None:
        stored = 0, even_map(shards, len(load))
        write_map(spark, path, *stored, load)
    version, before = stored
    owner = [o if o < shards else e for o, e in zip(before, even_map(shards, len(load)), strict=True)]
    while spread(moved := rebalance(owner, load, shards), load, shards) < spread(owner, load, shards):
        owner = moved
    if owner != before:
        version += 1
        write_map(spark, path, version, owner, load)
    return version


def shard_documents(docs: DataFrame, shards: int, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, place (gapless from 0 in the shard) and
    virtual_slot of every row. ``map_path``: where the map's versions are kept; one
    that is there is edited, not begun anew."""
    spark = docs.sparkSession
    rows = cut(with_slots(docs), "shard-rows")
    load, n_rows = [0] * SLOTS, 0
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect():   # at most SLOTS rows
        load[r.virtual_slot] = r.bytes
        n_rows += r.n
    path = map_path or new_path(spark, "slot-map")
    version = edit_map(spark, path, load, shards)

    split = 1
    while n_rows / (SLOTS * split) > CELL_ROWS:
        split *= 2
    cell = F.pmod(F.shiftrightunsigned("hash", 32), F.lit(split))
    placed = rows.join(F.broadcast(read_map(spark, path, version)), "virtual_slot").withColumn("cell", cell)   # SLOTS rows
    cells = placed.groupBy("shard", "virtual_slot", "cell").agg(F.count("*").alias("n"))
    # SLOTS * split rows, at most CELL_ROWS times fewer than the table; windows by shard hold only these.
    before = F.sum("n").over(W.partitionBy("shard").orderBy("virtual_slot", "cell").rowsBetween(W.unboundedPreceding, -1))
    cells = cells.select("virtual_slot", "cell", F.coalesce(before, F.lit(0)).alias("before"))
    in_cell = F.row_number().over(W.partitionBy("virtual_slot", "cell").orderBy("doc_id", "text_crc32", "size")) - 1
    return (placed.withColumn("in_cell", in_cell).join(cells, ["virtual_slot", "cell"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("in_cell")).cast("long").alias("place"), "virtual_slot"))
