"""One query per operator, over the whole tables of ``sf_dir``, and the SQL
that gives the same rows where SQL can express the operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agendum.llm import (decontamination, divergence, license_scan, line_dedup, ngram_join, packing, pii, sharding,
                         suffix_dedup, topk, toxicity, url_filter, whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql.strip()
        return fn
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query("op1_hilbert_packing")
def op1(spark, sf_dir):
    import public_tokenizers
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return pieces.drop("ids")


_WORDS2 = r"list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '')"


@query("op2_minhash_decontamination", sql=f"""
WITH i AS (SELECT row_number() OVER () AS r, item_id, {_WORDS2} AS w FROM benchmark),
     iw AS (SELECT r, item_id, least(len(w), 5) AS k, w FROM i WHERE len(w) > 0),
     s AS (SELECT r, item_id, k, list_distinct(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS g FROM iw),
     st AS (SELECT r, item_id, k, len(g) AS n, unnest(g) AS g FROM s),
     d AS (SELECT row_number() OVER () AS dr, doc_id, {_WORDS2} AS w FROM documents),
     dt AS (SELECT DISTINCT dr, doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS g
            FROM d, (SELECT DISTINCT k FROM s) WHERE len(w) >= k)
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_found, count(*) / n AS containment
FROM dt JOIN st USING (k, g) GROUP BY dr, doc_id, r, item_id, n HAVING count(*) * 100 >= n * 80""")
def op2(spark, sf_dir):
    found = decontamination.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


@query("op3_string_kernel_toxicity")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query("op4_ngram_jaccard_join", sql=f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_AZ}), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
     s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                          ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
     t AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
     p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) + any_value(b.n) AS n
           FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
     e AS (SELECT x, y FROM p WHERE 100 * c >= 80 * (n - c)),
     links AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
     reach(doc_id, k) AS (SELECT doc_id, doc_id FROM documents
                          UNION SELECT links.x, reach.k FROM reach JOIN links ON links.y = reach.doc_id WHERE reach.k < links.x)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, min(k) AS component_id FROM s JOIN reach USING (doc_id) GROUP BY s.doc_id, g""")
def op4(spark, sf_dir):
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


SHARDS = 24


@query("op5_virtual_slot_sharding")
def op5(spark, sf_dir):
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


@query("op6_license_scan")
def op6(spark, sf_dir):
    return license_scan.scan_windows(table(spark, sf_dir, "documents")).drop("matches")


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query("op7_levelled_line_dedup", sql=f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
     x AS (SELECT r, doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM d),
     k AS (SELECT *, translate(trim(line, {_BLANK}), {_AZ}) AS key FROM x),
     c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY r, doc_id""")
def op7(spark, sf_dir):
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
                      F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"))


@query("op8_bootstrapped_pii")
def op8(spark, sf_dir):
    out = pii.find_personal_data(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == F.lit(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return out.select("doc_id", *counts, F.sha2(pii.span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                      pii.span_text(F.col("spans")).alias("spans"))


_LABELS = ", ".join(f"'{x}'" for x in url_filter.LISTED_LABELS)


def _fits(h: str, p: str) -> str:
    return f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"


_RULES = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))


@query("op9_blocked_bloom_urls", sql=f"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), {_AZ}) AS host,
                  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
                  array_to_string(list_sort(list_filter(string_split(coalesce(regexp_extract(url, '://[^?#]*\\?([^#]*)', 1), ''), '&'),
                      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref)='))), '&') AS kept FROM pages),
     c AS (SELECT page_id, host, path, CASE WHEN host <> '' THEN regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '')
                  || CASE WHEN kept = '' THEN '' ELSE '?' || kept END END AS canonical FROM u),
     listed AS (SELECT DISTINCT canonical FROM c WHERE list_has_any(string_split(host, '.'), [{_LABELS}])),
     j AS (SELECT c.*, listed.canonical IS NOT NULL AS is_listed FROM c LEFT JOIN listed ON c.canonical = listed.canonical)
SELECT page_id, host, path,
       CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for _, h, p in _RULES)} END AS rule,
       CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{v}'" for v, h, p in _RULES)} WHEN is_listed THEN 'block' ELSE 'allow' END AS verdict,
       canonical FROM j""")
def op9(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.listed_pages(pages)).drop("possible_hit")


@query("op10_impact_ordered_topk", sql="""
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
     r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op10(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def _share_sql(count: str, total: str) -> str:
    return f"CASE WHEN v > 0 THEN CAST(1 + (1000000000::HUGEINT * ({count} + 5)) // greatest({total} + 5 * v, 1) AS BIGINT) ELSE 0 END"


@query("op11_divergence_skyband", sql=f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
     t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
     k AS (SELECT lang, term, count(*) AS lc FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
     c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
     l AS (SELECT lang, sum(lc) AS nl, count(*) AS v FROM k GROUP BY lang),
     g AS (SELECT DISTINCT lang, source FROM d),
     gt AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS ng FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
     gl AS (SELECT gt.*, coalesce(nl, 0) AS nl, coalesce(v, 0) AS v FROM gt LEFT JOIN l USING (lang)),
     p AS (SELECT gl.lang, gl.source, k.term, c.n, {_share_sql("coalesce(c.n, 0)", "ng")} AS p, {_share_sql("lc", "nl")} AS q
           FROM gl JOIN k ON gl.lang = k.lang LEFT JOIN c ON c.lang = gl.lang AND c.source = gl.source AND c.term = k.term),
     s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
     pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
     tr AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
           FROM (SELECT * FROM pr UNION ALL SELECT * FROM tr))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50""")
def op11(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


@query("op12_suffix_doubling_dedup", sql="""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
     s AS (SELECT r, doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 100) AS g FROM (SELECT r, doc_id, h, unnest(range(n - 49)) AS i FROM d WHERE n >= 50)),
     f AS (SELECT g, min(doc_id) AS first FROM s GROUP BY g HAVING min(doc_id) < max(doc_id)),
     b AS (SELECT r, i, CASE WHEN i <= lag(i) OVER w + 50 THEN 0 ELSE 1 END AS new FROM s JOIN f USING (g) WHERE doc_id > first WINDOW w AS (PARTITION BY r ORDER BY i)),
     u AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM b),
     x AS (SELECT r, run, min(i) AS lo, max(i) + 50 AS hi FROM u GROUP BY ALL),
     y AS (SELECT r, run, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS before FROM x),
     z AS (SELECT r, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last FROM y GROUP BY r),
     k AS (SELECT r, string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (lo - before) AS BIGINT)), '' ORDER BY lo) AS pieces FROM y JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(pieces, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN z USING (r) LEFT JOIN k USING (r)""")
def op12(spark, sf_dir):
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), with_kept=False)
    return out.select("doc_id", *[F.col(f"_{c}").alias(c) for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")])


@query("op13_jacobi_davidson_whitening")
def op13(spark, sf_dir):
    out = whitening.by_component(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))
