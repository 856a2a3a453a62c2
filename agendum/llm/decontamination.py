"""Benchmark decontamination: which test items stand inside which texts.

Items are short and texts may be very long, so the measure is containment: the
share of an item's distinct word shingles that a text has. Size-partitioned
MinHash search:

1. Items are partitioned by the size of their shingle sets (powers of two). All
   items of a partition get MinHash sketches of one length: the k smallest hash
   values, k = u - ceil(0.8 u) + 1 for the partition's largest size u. A text that
   has 80 % of an item's shingles lacks fewer than k of them, so it has at least
   one sketch value of it, and at least k - floor(0.2 n): no item is missed.
2. The shingles of all texts probe the sketches (an equi-join on the hash value;
   broadcast when the counted sketches are small). Texts with enough sketch values
   of an item are candidates.
3. Candidates are verified on the shingles themselves, not their hashes.

Words are runs of letters and digits, lower-cased. An item with fewer than
``WIDTH`` words is searched as one shingle of that many words. All of it is
built-in column functions.

Edge cases: null, empty and word-less items are found nowhere, null, empty and
word-less texts contain nothing; a null item_id or doc_id is carried along;
repeated rows are reported as often as they occur (equal items once per row of
each); empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agendum.llm.storage import broadcast_if_small, cut

WIDTH = 5
PERCENT = 80
BROADCAST_ROWS = 1_000_000      # sketch rows, or candidate rows: 24 bytes each


def words_of(text: F.Column) -> F.Column:
    """Lower-cased runs of letters and digits; empty for null."""
    flat = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(F.btrim(flat), " "), lambda w: w != "")


def _windows(words: F.Column, width: int, of) -> F.Column:
    last = F.size(words) - width
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), of)).otherwise(F.array())


def shingle_hashes(words: F.Column, width: int) -> F.Column:
    return _windows(words, width, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))


def shingle_texts(words: F.Column, width: int) -> F.Column:
    return F.array_distinct(_windows(words, width, lambda i: F.array_join(F.slice(words, i + 1, F.lit(width)), " ")))


def item_sets(items: DataFrame, width: int) -> DataFrame:
    """item_row, item_id, width, shingles (texts), hashes (one of each shingle), n of every item with words."""
    rows = items.select(F.monotonically_increasing_id().alias("item_row"), "item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    rows = rows.withColumn("width", F.least(F.size("w"), F.lit(width)))
    texts, hashes = F.array().cast("array<string>"), F.array().cast("array<bigint>")
    for k in range(1, width + 1):
        texts = F.when(F.col("width") == k, shingle_texts(F.col("w"), k)).otherwise(texts)
        hashes = F.when(F.col("width") == k, F.array_distinct(shingle_hashes(F.col("w"), k))).otherwise(hashes)
    return rows.select("item_row", "item_id", "width", texts.alias("shingles"), hashes.alias("hashes")).withColumn("n", F.size("shingles"))


def sketches(sets: DataFrame, percent: int) -> DataFrame:
    """width, hash, item_row, enough: the sketch values of every item and how many of them a text needs."""
    upper = F.pow(F.lit(2), F.floor(F.log2("n")) + 1) - 1     # the partition's largest size
    k = F.least(F.col("n"), (upper - F.ceil(upper * percent / 100) + 1).cast("int"))
    spare = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int")
    return (sets.withColumn("k", k).withColumn("enough", F.greatest(F.lit(1), F.col("k") - spare))
            .select("width", F.explode(F.slice(F.array_sort("hashes"), F.lit(1), F.col("k"))).alias("hash"), "item_row", "enough"))


def find_items(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, item_id, n_shingles, n_found, containment of every
    (text, item) with at least ``percent`` % of the item's shingles in the text."""
    sets = cut(item_sets(items, width), "decon-items")
    sketch = cut(sketches(sets, percent), "decon-sketches")
    n_sketch = sketch.count()
    probe = broadcast_if_small(sketch, n_sketch, BROADCAST_ROWS)
    widths = sorted(r.width for r in sets.select("width").distinct().collect())    # at most WIDTH rows

    text_hash = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = None
    for k in widths:
        part = (docs.select("doc_id", text_hash.alias("text_hash"), words_of(F.col("text")).alias("w"))
                .select("doc_id", "text_hash", F.explode(shingle_hashes(F.col("w"), k)).alias("hash"))
                .join(probe.where(F.col("width") == k).drop("width"), "hash"))
        found = part if found is None else found.union(part)
    if found is None:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("item_id", items.schema["item_id"].dataType), ("n_shingles", "long"), ("n_found", "long"), ("containment", "double"))]
        return docs.select("doc_id", text_hash.alias("text_hash"), *none).where("false")
    candidates = cut(found.distinct().groupBy("doc_id", "text_hash", "item_row", "enough").agg(F.count("*").alias("hits"))
                     .where("hits >= enough").select(F.col("doc_id").alias("c_doc"), F.col("text_hash").alias("c_hash"), "item_row"), "decon-candidates")
    rows = candidates.count()

    # Exact shingle containment of the candidates.
    texts = docs.select("doc_id", text_hash.alias("text_hash"), "text").join(
        broadcast_if_small(candidates.select("c_doc", "c_hash").distinct(), rows, BROADCAST_ROWS),
        (F.col("text_hash") == F.col("c_hash")) & F.col("doc_id").eqNullSafe(F.col("c_doc")), "left_semi")
    pairs = (texts.withColumn("w", words_of(F.col("text"))).drop("text")
             .join(broadcast_if_small(candidates, rows, BROADCAST_ROWS), (F.col("text_hash") == F.col("c_hash")) & F.col("doc_id").eqNullSafe(F.col("c_doc")))
             .join(sets.select("item_row", "item_id", "width", "shingles", "n"), "item_row"))
    in_text = F.array().cast("array<string>")
    for k in widths:
        in_text = F.when(F.col("width") == k, shingle_texts(F.col("w"), k)).otherwise(in_text)
    checked = pairs.withColumn("n_found", F.size(F.array_intersect("shingles", in_text)))
    return (checked.where(F.col("n_found") * 100 >= F.col("n") * percent)
            .select("doc_id", "text_hash", "item_id", F.col("n").cast("long").alias("n_shingles"), F.col("n_found").cast("long").alias("n_found"),
                    (F.col("n_found") / F.col("n")).alias("containment")))


def without_leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that contain no test item, columns unchanged."""
    leaks = cut(find_items(docs, items, width, percent).select(F.col("doc_id").alias("_leak_doc"), F.col("text_hash").alias("_leak_hash")).distinct(), "decon-leaks")
    small = broadcast_if_small(leaks, leaks.count(), BROADCAST_ROWS)
    text_hash = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(small, (text_hash == F.col("_leak_hash")) & F.col("doc_id").eqNullSafe(F.col("_leak_doc")), "left_anti")
