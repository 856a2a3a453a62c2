from __future__ import annotations

import random
import re

from agendum.llm import url_filter as U
from pyspark.sql import functions as F
from tests.llm.helpers import AZ


def parts(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    return (m.group(1).translate(AZ), m.group(2)) if m else ("", "")


def rule_of(host, path):
    fits = [(len(h + p), v, h + p) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def pages_of(spark, urls):
    return spark.createDataFrame([(i, u, "<p>", "x", 1) for i, u in enumerate(urls)], "page_id long, url string, html string, canonical string, block int")


URLS = [None, "", "no scheme", "http://", "http://Example.NET", "https://a.example.net/en/1", "https://example.net/en", "http://xnet/", "http://b.NET/x?y#z", "http://example.com/de/1",
        "http://w.example.com/de/", "http://notexample.com/de/", "http://org/fr/", "https://k.org/fr/a://b", "https://k.org/en/", "ftp://h?q://x/", "http://spam-farm.example.org/en/1",
        "https://www.spam-farm.example.org/en/1/?utm_source=a#t", "http://other.example.org/en/1?b=2&a=1", "http://other.example.org/en/1?a=1&ref=x&b=2", "http://x.org/a b\nc?d"]


def test_rules_equal_brute_force(spark):
    rng = random.Random(12)
    hosts = ["net", "org", "com", "example.net", "a.Example.net", "example.com", "c.example.com", "k.org", "spam-farm.example.org"]
    urls = URLS + [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/de/x', '/fr/y', '/EN/'])}{rng.choice(['', '?a=1', '#f'])}" for _ in range(200)]
    pages = pages_of(spark, urls)
    rows = {r.page_id: r for r in U.judge(pages, U.listed_pages(pages)).collect()}
    assert len(rows) == len(urls)
    listed = {rows[i].canonical for i, u in enumerate(urls) if set(parts(u)[0].split(".")) & set(U.LISTED_LABELS)}
    for i, u in enumerate(urls):
        host, path = parts(u)
        verdict, rule = rule_of(host, path)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule)
        assert rows[i].verdict == (verdict or ("block" if rows[i].canonical in listed else "allow"))


def test_same_page_has_one_canonical_url(spark):
    pages = pages_of(spark, URLS)
    c = {r.page_id: r.c for r in pages.select("page_id", U.canonical(pages.url).alias("c")).collect()}
    assert c[16] == c[17] == "spam-farm.example.org/en/1" and c[18] == c[19] and c[0] is None and c[2] is None


def test_filter_has_no_false_negative_and_few_false_positives(spark):
    listed = spark.range(3000).selectExpr("concat('h', id, '.org/x') as canonical")
    pages = spark.range(6000).selectExpr("id as page_id", "concat('http://h', id, '.org/x') as url")
    rows = U.judge(pages, listed, rules=[]).collect()
    assert {r.page_id for r in rows if r.verdict == "block"} == set(range(3000))
    assert all(r.possible_hit for r in rows if r.page_id < 3000)
    assert sum(r.possible_hit for r in rows if r.page_id >= 3000) < 100


def test_empty_list_empty_table_and_shuffled_filter(spark, monkeypatch):
    none = spark.createDataFrame([], "canonical string")
    assert {r.verdict for r in U.judge(pages_of(spark, ["http://a.com/", None]), none).collect()} == {"allow"}
    assert U.judge(pages_of(spark, ["x"]).limit(0), none).count() == 0
    monkeypatch.setattr(U, "BROADCAST_BLOCKS", 0)
    test_filter_has_no_false_negative_and_few_false_positives(spark)


def test_plans_stay_native(spark):
    pages = pages_of(spark, URLS)
    plan = U.judge(pages, U.listed_pages(pages))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_hot_urls_and_rows_without_one_are_dealt_over_salts(spark, monkeypatch):
    """A filter too large to broadcast: a hot URL and rows without one are many keys of the joins."""
    monkeypatch.setattr(U, "BROADCAST_BLOCKS", 0)
    monkeypatch.setattr(U, "SALTED_URLS", 0)
    rows = [(i, "https://hot.example.io/x" if i % 3 == 0 else None if i % 3 == 1 else f"https://h{i}.example.io/y") for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(20)
    listed = spark.createDataFrame([("hot.example.io/x",), ("h2.example.io/y",), (None,)], "canonical string")
    out = U.judge(pages, listed).collect()
    assert sorted((r.page_id, r.verdict) for r in out) == sorted((i, "block" if i % 3 == 0 or i == 2 else "allow") for i, _ in rows)
    hot = pages.where(F.col("page_id") % 3 == 0).select(F.spark_partition_id() % U.SALTS).distinct().count()
    assert hot > 8
