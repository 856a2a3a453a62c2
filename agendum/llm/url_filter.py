"""URL filter: rules first, then a blocked Bloom filter over listed canonical URLs
whose possible hits go to an exact hash join.

The filter is a table of blocks of eight 64-bit words. A canonical URL belongs to
one block and sets one bit in each word. It is built by one aggregation
(``bit_or`` per block, combined before the shuffle) and probed by a join on the
block number, broadcast when its counted size is small. URLs that miss a bit are
certainly not listed and go no further; possible hits are joined with the list
itself, so false positives go and the verdicts are exact. Where these joins are
shuffled, rows are dealt over ``SALTS`` copies of the filter and the list, so a URL
that a third of the rows have is no single task; rows without a canonical URL are
dealt by page_id.

All of it is built-in column functions.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits
no rule and is listed nowhere; very long urls are read whole; repeated rows get a verdict each; an empty list
blocks nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agendum.llm.storage import broadcast_if_small, cut

BITS_PER_URL = 16
WORDS, WORD_BITS = 8, 64
BROADCAST_BLOCKS = 250_000      # of 72 bytes: 18 MB
SALTED_URLS = 20_000            # listed URLs beyond which the exact join is salted
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Fixed values: (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
# Host labels whose pages make up the list of the registered query.
LISTED_LABELS = ["spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track", "adult-x"]


def host(url: F.Column) -> F.Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: F.Column) -> F.Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: F.Column) -> F.Column:
    """host/path?query without scheme, www., fragment, tracking parameters and
    closing slash; null for what is no URL."""
    query = F.coalesce(F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1), F.lit(""))
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref)="))), "&")
    base = F.concat(F.regexp_replace(host(url), r"^www\.", ""), F.regexp_replace(path(url), "/+$", ""))
    return F.when(host(url) != "", F.when(kept == "", base).otherwise(F.concat(base, F.lit("?"), kept)))


def _places(url: F.Column, n_blocks: int) -> tuple[F.Column, list[F.Column]]:
    """Block number and the mask of each word."""
    bits = F.xxhash64(url, F.lit("bits"))
    masks = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * w).bitwiseAND(WORD_BITS - 1).cast("int"))
             for w in range(WORDS)]
    return F.pmod(F.xxhash64(url), F.lit(n_blocks)), masks


def bloom_filter(urls: DataFrame, n_urls: int) -> tuple[DataFrame, int]:
    """(blocks with words w0..w7, number of blocks) of a column ``canonical``."""
    n_blocks = max(1, math.ceil(n_urls * BITS_PER_URL / (WORDS * WORD_BITS)))
    block, masks = _places(F.col("canonical"), n_blocks)
    table = urls.select(block.alias("block"), *[m.alias(f"m{w}") for w, m in enumerate(masks)])
    return table.groupBy("block").agg(*[F.bit_or(f"m{w}").alias(f"w{w}") for w in range(WORDS)]), n_blocks


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, canonical, possible_hit of every row.
    ``listed``: blocked URLs in a column ``canonical``."""
    listed = cut(listed.select("canonical").where(F.col("canonical").isNotNull()).distinct(), "url-list")
    n_listed = listed.count()
    blocks, n_blocks = bloom_filter(listed, n_listed)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    blocks, keys = cut(blocks, "url-bloom"), ["block"]
    if n_blocks > BROADCAST_BLOCKS:
        blocks, keys = blocks.withColumn("salt", salts), ["block", "salt"]
    blocks = broadcast_if_small(blocks, n_blocks, BROADCAST_BLOCKS)

    url = F.col("url").cast("string")
    rows = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), canonical(url).alias("canonical"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):   # the longest fitting rule is tested first
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    block, masks = _places(F.col("canonical"), n_blocks)
    none = -1 - F.pmod(F.xxhash64("page_id"), F.lit(4096))
    rows = rows.withColumns({"block": F.when(F.col("canonical").isNull(), none).otherwise(block), "salt": F.pmod(F.spark_partition_id(), F.lit(SALTS))})
    hit = F.lit(True)
    for w, m in enumerate(masks):
        hit &= F.col(f"w{w}").bitwiseAND(m) == m
    probed = cut(rows.join(blocks, keys, "left").withColumn("possible_hit", F.coalesce(hit, F.lit(False)) & F.col("canonical").isNotNull())
                 .select("page_id", "host", "path", "rule", "ruled", "canonical", "possible_hit", "salt"), "url-probed")
    clear = probed.where(~F.col("possible_hit")).withColumn("verdict", F.coalesce("ruled", F.lit("allow")))
    listed, keys = listed.withColumn("is_listed", F.lit(True)), ["canonical"]
    if n_listed > SALTED_URLS:
        listed, keys = listed.withColumn("salt", salts), ["canonical", "salt"]
    hits = (probed.where("possible_hit").join(listed, keys, "left")
            .withColumn("verdict", F.coalesce("ruled", F.when(F.col("is_listed"), "block").otherwise("allow"))))
    cols = ["page_id", "host", "path", "rule", "verdict", "canonical", "possible_hit"]
    return clear.select(*cols).union(hits.select(*cols))


def listed_pages(pages: DataFrame, labels: list[str] = LISTED_LABELS) -> DataFrame:
    """Canonical URLs of the pages on a host with one of the labels."""
    url = F.col("url").cast("string")
    return pages.where(F.arrays_overlap(F.split(host(url), r"\."), F.array(*[F.lit(x) for x in labels]))).select(canonical(url).alias("canonical"))
